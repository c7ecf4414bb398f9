"""Readers and writers of facts, files and configurations."""
