"""Change plans: proposals, checks, diffs and their execution."""
