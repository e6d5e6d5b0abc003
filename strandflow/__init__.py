"""Signal-to-sequence analytics on Spark."""
