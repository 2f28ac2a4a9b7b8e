"""Operators of multi-view reconstruction: DataFrames in, DataFrames out."""
