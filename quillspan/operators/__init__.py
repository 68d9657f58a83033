"""Operators over DataFrames: parse, windows, urls, reduce, rank, checks."""
