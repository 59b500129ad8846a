"""A log-structured key-value engine expressed as Spark DataFrame computations."""
