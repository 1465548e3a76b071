"""Every registered query of the engine and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.plans import box_queries, latency_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = latency_queries.QUERIES | text_queries.QUERIES | box_queries.QUERIES
ORACLES: dict[str, str] = latency_queries.ORACLES | text_queries.ORACLES | box_queries.ORACLES
