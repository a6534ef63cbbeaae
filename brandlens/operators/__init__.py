"""Relational and domain operators, each a function from DataFrames to a DataFrame."""
