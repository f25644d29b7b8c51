"""Nearest-neighbour search over Spark DataFrames, and operators for training-data pipelines."""
