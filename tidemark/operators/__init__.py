"""Engagement operators: DataFrames in, DataFrames out."""
