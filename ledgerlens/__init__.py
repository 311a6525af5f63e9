"""Transaction analytics and fraud features as plain Spark DataFrame functions."""
