"""Numeric kernels of variant calling, on numpy arrays of one region. They know nothing of Spark."""
