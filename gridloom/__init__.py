"""Table-aware document analytics on Spark."""
