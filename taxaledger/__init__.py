"""Species-list standardization and verification as Spark DataFrame jobs."""
