"""A Spark-first engine for a small SQL dialect and row-ordered event processing."""
