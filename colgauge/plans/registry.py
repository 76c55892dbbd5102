"""The book of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, read when they are first named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(self.path(name))
        setattr(self, name, table)
        return table


def query(name: str, sql: str | None = None):
    """Registers a function of :class:`Tables` under a name, with its SQL if it has one."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        QUERIES[name].__name__ = name
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def rnd(value: str | Column, places: int = 6) -> Column:
    """Rounded for comparison; never a negative zero."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c.cast("double"), places) + F.lit(0.0)


def day_text(value: str | Column) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.date_format(c, "yyyy-MM-dd")


def time_text(value: str | Column) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def model_rows(t: Tables) -> DataFrame:
    """Orders as model rows: id, key, as-of date, outcome, split and incumbents."""
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("key"),
        F.col("o_orderdate").alias("as_of"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), "train")
        .when(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"), "valid")
        .otherwise("test")
        .alias("split"),
        F.col("o_totalprice").alias("price"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
    )


def history(t: Tables) -> DataFrame:
    """The same orders as an event source: key, event time, measure, category."""
    return t.orders.select(
        F.col("o_custkey").alias("key"),
        F.col("o_orderdate").alias("event_time"),
        F.col("o_orderkey").alias("event_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("category"),
    )


MODEL_SQL = """model AS (
  SELECT o_orderkey AS id, o_custkey AS key, o_orderdate AS as_of,
         CAST(o_orderstatus = 'F' AS INTEGER) AS y,
         CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train'
              WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'valid' ELSE 'test' END AS split,
         o_totalprice AS price, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority
  FROM orders)"""
HISTORY_SQL = """hist AS (
  SELECT o_custkey AS key, o_orderdate AS event_time, o_orderkey AS event_id,
         o_totalprice AS amount, o_orderpriority AS category
  FROM orders)"""
BASE_SQL = f"WITH {MODEL_SQL}, {HISTORY_SQL}"
