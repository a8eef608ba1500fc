"""tracewell: a Spark-first analytics engine for recorded website evidence."""
