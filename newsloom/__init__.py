"""News-event analytics as Spark DataFrame functions."""
