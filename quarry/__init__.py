"""Record search and index analytics on Spark."""
