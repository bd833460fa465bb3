"""Spark jobs for leakage-free evaluation of window-level anomaly scores."""
