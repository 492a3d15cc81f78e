"""Retrieval, answer-context and evaluation analytics over paged documents, on PySpark."""
