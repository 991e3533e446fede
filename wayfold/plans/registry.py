"""All queries of the library but for those of the optional subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.plans import report_queries, scalar_queries, series_queries, source_queries, state_queries, track_queries, training_queries

#: Of two queries with one name the later part's holds.
_PARTS = (scalar_queries, series_queries, source_queries, state_queries, report_queries, training_queries, track_queries)


def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_queries.agg_14_path_length(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for part in _PARTS for k, v in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.oracle_sql().items()}
