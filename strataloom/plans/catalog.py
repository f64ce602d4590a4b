"""Registered queries over the test tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataloom.plans import graph_queries, source_queries, table_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**graph_queries.QUERIES, **table_queries.QUERIES, **source_queries.QUERIES}
ORACLES: dict[str, str] = {**graph_queries.ORACLES, **table_queries.ORACLES, **source_queries.ORACLES}
