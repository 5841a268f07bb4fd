"""Corpus preparation, retrieval, query-log and feedback analytics as PySpark DataFrame jobs."""
