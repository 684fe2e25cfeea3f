"""Operators: each takes DataFrames and returns DataFrames; none keeps state of its own."""
