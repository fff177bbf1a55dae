"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.plans import basics, calling_queries, duplicate_queries, file_queries, recalibration_queries

_PARTS = (basics, duplicate_queries, recalibration_queries, calling_queries, file_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL: dict[str, str] = {k: v for p in _PARTS for k, v in p.SQL.items()}
