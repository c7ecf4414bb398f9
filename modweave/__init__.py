"""Dependency-graph analytics over DataFrames."""
