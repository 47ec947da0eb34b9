"""NumPy kernels, free of Spark."""
