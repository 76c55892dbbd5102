"""Summaries of events: per id, per period, and the checks on their grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colgauge.functions.scalars import col, safe_ratio
from colgauge.operators.linkage import before_as_of, cut_window

PERIOD_END = "period_end"


def aggregate_per_id(
    linked: DataFrame,
    aggregates: Sequence[Column],
    *,
    time: str,
    id_col: str = "id",
    as_of: str = "as_of",
    days: int | None = None,
    rule: str = "strict",
) -> DataFrame:
    """Each id's events in its window, as one row per id.

    A linked row on or after its as-of date stops the run: the link let it through.
    """
    on_time = F.when(before_as_of(time, as_of, rule), F.lit(True)).otherwise(
        F.raise_error(F.lit("a linked row is on or after its as-of date")).cast("boolean")
    )
    rows = linked.filter(on_time)
    if days is not None:
        rows = cut_window(rows, time, as_of, days)
    return rows.groupBy(id_col).agg(*aggregates)


def period_end(time: str | Column, period: str) -> Column:
    """The last day of the event's day, week (to Sunday) or month."""
    day = F.to_date(col(time))
    ends = {"day": day, "week": F.next_day(F.date_sub(day, 1), "Sun"), "month": F.last_day(day)}
    if period not in ends:
        raise ValueError(f"period must be one of {sorted(ends)}, got {period!r}")
    return ends[period]


def add_period_end(df: DataFrame, time: str, period: str) -> DataFrame:
    return df.withColumn(PERIOD_END, period_end(time, period).cast("timestamp"))


def aggregate_by_period(
    source: DataFrame, key: str | Sequence[str], time: str, period: str, aggregates: Sequence[Column]
) -> DataFrame:
    """One row per key and period, events without a readable time left out."""
    keys = [key] if isinstance(key, str) else list(key)
    return (
        add_period_end(source.filter(col(time).isNotNull()), time, period)
        .groupBy(*keys, PERIOD_END)
        .agg(*aggregates)
    )


def grain_violations(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """One row: grains that repeat, their rows, and per other text column the grains it splits."""
    texts = [n for n, t in df.dtypes if t == "string" and n not in grain]
    per_grain = df.groupBy(*grain).agg(
        F.count(F.lit(1)).alias("_n"),
        *[(F.min(col(c)) != F.max(col(c))).alias(f"_split_{c}") for c in texts],
    )
    repeated = F.col("_n") > 1
    return per_grain.agg(
        F.count(F.lit(1)).alias("n_grains"),
        F.count_if(repeated).alias("repeated_grains"),
        F.coalesce(F.sum(F.when(repeated, F.col("_n"))), F.lit(0)).alias("repeated_rows"),
        *[F.count_if(F.col(f"_split_{c}")).alias(f"split_by_{c}") for c in texts],
    )


def moved_periods(aggregate: DataFrame, source: DataFrame, time: str, period: str) -> DataFrame:
    """Aggregate rows whose period_end no event of the source has."""
    real = add_period_end(source, time, period).select(PERIOD_END).distinct()
    return aggregate.join(real, PERIOD_END, "left_anti")


def trend_slope(df: DataFrame, id_col: str, t: str | Column, y: str | Column, name: str = "slope") -> DataFrame:
    """The slope of y over t per id; NULL for a single point in time."""
    return df.groupBy(id_col).agg(F.regr_slope(col(y).cast("double"), col(t).cast("double")).alias(name))


def recent_vs_before(
    linked: DataFrame, measure: str, age: Column, recent: int, before: int, id_col: str = "id"
) -> DataFrame:
    """Mean of the latest ``recent`` periods over the mean of the ``before`` ones preceding them.

    ``age`` counts periods back from the as-of date, the latest being 1.
    """
    value = col(measure)
    new, old = age.between(1, recent), age.between(recent + 1, recent + before)
    return (
        linked.groupBy(id_col)
        .agg(F.avg(F.when(new, value)).alias("recent_mean"), F.avg(F.when(old, value)).alias("before_mean"))
        .withColumn("recent_ratio", safe_ratio("recent_mean", "before_mean"))
    )
