"""Multi-view geometry analytics as Spark DataFrame operators."""
