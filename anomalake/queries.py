"""The registered queries and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from anomalake.plans import knn_queries, metric_queries, projection_queries, source_queries, table_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = knn_queries.Q | metric_queries.Q | table_queries.Q | source_queries.Q | projection_queries.Q
ORACLE: dict[str, str] = knn_queries.SQL | metric_queries.SQL | table_queries.SQL | source_queries.SQL | projection_queries.SQL
