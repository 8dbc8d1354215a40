"""Operators for training-data pipelines, their queries and SQL. Nothing outside this package imports it."""
