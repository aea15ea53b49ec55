"""Operators: DataFrames in, one DataFrame out, nothing collected."""
