"""Property-listing analytics as Spark DataFrame functions."""
