"""Media content analytics on Spark."""
