"""copse: tree-ensemble analytics as Spark DataFrame jobs over plain model tables."""
