"""Detection, repair and verification of regularly sampled time series as Spark jobs."""
