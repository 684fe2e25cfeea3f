"""Numpy kernels for one group of marks or texts; nothing here imports Spark."""
