"""Operators: DataFrames in, DataFrames out; ``run`` partitions every table."""
