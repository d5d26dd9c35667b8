"""All queries over the driver's tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annotation_queries, document_queries, evaluation_queries, file_queries, overlap_queries, pixel_queries

_PLANS = (pixel_queries, evaluation_queries, annotation_queries, document_queries, file_queries, overlap_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_queries.page_boxes(spark, sf_dir)
