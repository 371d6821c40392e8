"""Operators over dependency graphs, each a function from DataFrames to a DataFrame."""
