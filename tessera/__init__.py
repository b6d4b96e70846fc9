"""Document retrieval and query-log analytics as Spark DataFrame operators."""
