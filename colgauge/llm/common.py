"""What several operators share: tables, folds, the book of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colgauge.operators.order import attach_by_value

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``build(spark, folder)`` under a name, with its SQL if it has one."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fold(id_col: str | Column, parts: int) -> Column:
    """The fold of an id: crc32 of its text, modulo ``parts``; 0 for a NULL id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % F.lit(parts), F.lit(0)).cast("int")


def whole_text(text: str | Column) -> Column:
    """The text, NULL as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c, F.lit(""))


GUESSED = 1 << 50     # bytes; a plan over rows that are in no file says more than this


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files behind ``df`` as the plan knows them, counted where it only guesses; what sizes of groups follow."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < GUESSED:
        return known
    sizes = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns]
    return int(df.agg(F.sum(sum(sizes, F.lit(0)).cast("long"))).first()[0] or 0)


def groups_for(df: DataFrame, each: int = 8 << 20, least: int = 8) -> int:
    """A number of groups that grows with the input, so that one group never does."""
    return max(least, -(-input_bytes(df) // each))


def held_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, n_total): how many rows hold each key."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("n_total", F.lit(rows.count()))


def look_up(rows: DataFrame, keys: list[str], known: DataFrame, take: str, spread: str, held: DataFrame | None = None) -> DataFrame:
    """Adds ``take`` from ``known`` (unique keys, none NULL) to ``rows``, which are read three times; NULL where nothing is known.

    ``held``, if given, is what :func:`held_by` finds.

    Keys that hold a thousandth of the rows, so at most a thousand, are sent to every task, the others meet by a
    shuffle that ``spread`` deals the rows of the first ones over. ``take`` is a small value.
    """
    counted = (held_by(rows, keys) if held is None else held).join(known.select(*keys, take), keys)
    return attach_by_value(rows, counted, keys, take, F.col(spread))
