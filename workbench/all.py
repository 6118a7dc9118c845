"""Imports every query module, in the order the queries are listed."""

from . import scalars, rollups, records_queries, evidence_queries, review_queries, io_queries, job_queries  # noqa: F401, I001
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
