"""Column functions and text extractors."""
