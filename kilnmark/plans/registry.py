"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive, evaluation, events, learning, pqueries, series, small, storage

PARTS = (events.q, series.q, archive.q, evaluation.q, storage.q, learning.q, small.q)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**pqueries.QUERIES, **{k: f for p in PARTS for k, f in p.queries.items()}}
SQL: dict[str, str] = {**pqueries.SQL, **{k: s for p in PARTS for k, s in p.sql.items()}}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.flagship(spark, sf_dir)
