"""Point-in-time market analytics as composable Spark DataFrame operators."""
