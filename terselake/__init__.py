"""A Spark-first engine for compressing and analysing tool-output text."""
