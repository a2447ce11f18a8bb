"""Relational and graph operators: DataFrames in, lazy DataFrames out."""
