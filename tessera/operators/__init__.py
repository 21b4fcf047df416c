"""Relational building blocks as functions from DataFrames to DataFrames."""
