"""All registered queries, gathered from their modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colgauge.plans import linkage_queries, model_queries, rank_queries, table_queries  # noqa: F401
from colgauge.plans.registry import QUERIES, SQL, Query


def registered_queries() -> dict[str, Query]:
    return dict(QUERIES)


def registered_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["agg_per_id_90d"](spark, folder)
