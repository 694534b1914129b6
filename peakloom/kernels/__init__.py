"""NumPy kernels of the steps that are sequential by nature. Nothing here imports Spark."""
