"""Registered queries over the driver's tables."""

from . import document_queries, evaluation_queries, ingest_queries, search_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
