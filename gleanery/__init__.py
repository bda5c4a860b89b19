"""A Spark-first engine for building and querying text search indexes."""
