"""Point-in-time engagement analytics as Spark DataFrame operators."""
