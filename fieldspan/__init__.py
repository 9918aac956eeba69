"""Field time-series analytics on Spark."""
