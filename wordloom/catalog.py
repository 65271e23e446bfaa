"""Every query of the engine with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import evidence_queries, mining_queries, readout_queries, selection_queries, series_queries, source_queries

PLANS = (series_queries, mining_queries, evidence_queries, source_queries, readout_queries, selection_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most novel points of the event series."""
    return mining_queries.z_points(spark, sf_dir).orderBy(F.desc("z"), "series", "t").limit(20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for p in PLANS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in PLANS for k, s in p.SQL.items()}
