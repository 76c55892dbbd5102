"""Cases followed through time: who flags a case first."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from colgauge.functions.scalars import col, micros
from colgauge.operators.order import carry_in, positions, time_bucket

OUTCOMES = ("earlier", "same", "later", "only_variant", "only_base", "neither")
DAY = 86_400


def sequence_cases(rows: DataFrame, case: str, time: str, tie: str, width: int = 30 * DAY) -> DataFrame:
    """Adds ``_t``: 1, 2, ... along each case by (time, tie). Rows without a case are left out."""
    kept = rows.filter(col(case).isNotNull())
    order = [col(time).asc_nulls_first(), col(tie).asc()]
    bucket = F.coalesce(time_bucket(time, width), F.lit(-(2**62)))
    return positions(kept, [case], order, bucket, "_t")


def first_flags(
    cases: DataFrame, case: str, time: str, flags: Mapping[str, Column], target: str | None = None
) -> DataFrame:
    """Per case: its rows and, for each named flag, the first position and time it holds."""
    firsts = [F.min(F.when(flag, F.struct(F.col("_t"), col(time).alias("time")))).alias(f"_f_{n}") for n, flag in flags.items()]
    outcome = [F.max(col(target)).alias("defaulted")] if target else []
    per_case = cases.groupBy(case).agg(F.count(F.lit(1)).alias("n_rows"), *firsts, *outcome)
    return per_case.select(
        case, "n_rows",
        *[c for n in flags for c in (F.col(f"_f_{n}._t").alias(f"first_{n}"), F.col(f"_f_{n}.time").alias(f"time_{n}"))],
        *(["defaulted"] if target else []),
    )


def flag_outcomes(firsts: DataFrame) -> DataFrame:
    """Adds the outcome of base against variant, and how many rows and days sooner."""
    b, v = F.col("first_base"), F.col("first_variant")
    outcome = (
        F.when(b.isNull() & v.isNull(), "neither").when(b.isNull(), "only_variant").when(v.isNull(), "only_base")
        .when(v < b, "earlier").when(v > b, "later").otherwise("same")
    )
    days = F.floor((micros("time_base") - micros("time_variant")) / F.lit(DAY * 1_000_000))
    return firsts.withColumns({"outcome": outcome, "rows_sooner": b - v, "days_sooner": days})


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """One row: the cases and how many had each outcome."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("cases"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    )


def event_gaps(events: DataFrame, key: str, time: str, tie: str, width: int = 30 * DAY) -> DataFrame:
    """Adds the key's previous event time and the elapsed days since it.

    Inside a time bucket the previous row is looked up; the first row of a bucket
    takes the latest time of the buckets before it.
    """
    kept = events.filter(col(key).isNotNull() & col(time).isNotNull())
    b = carry_in(kept.withColumn("_bucket", time_bucket(time, width)), [key], "_bucket", maxima={"_last": col(time)})
    inside = Window.partitionBy(key, "_bucket").orderBy(col(time), col(tie))
    previous = F.coalesce(F.lag(col(time)).over(inside), F.col("_last_carry"))
    gap = (micros(time) - micros("previous_time")) / F.lit(DAY * 1_000_000.0)
    return b.withColumn("previous_time", previous).withColumn("gap_days", gap).drop("_bucket", "_last_carry")


def gap_summary(gaps: DataFrame, key: str) -> DataFrame:
    return gaps.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("gap_days").alias("mean_gap"), F.max("gap_days").alias("max_gap")
    )


def failures_before_success(
    attempts: DataFrame, run: str, time: str, tie: str, success: Column, width: int = 30 * DAY
) -> DataFrame:
    """For each success, the failed attempts right before it in its run: adds ``failed_before``.

    A success at position p follows p - 1 - (position of the previous success) failures.
    """
    numbered = sequence_cases(attempts, run, time, tie, width)
    hits = numbered.filter(success)
    b = carry_in(
        hits.withColumn("_bucket", F.coalesce(time_bucket(time, width), F.lit(-(2**62)))), [run], "_bucket",
        maxima={"_p": F.col("_t")},
    )
    inside = Window.partitionBy(run, "_bucket").orderBy("_t")
    before = F.coalesce(F.lag("_t").over(inside), F.col("_p_carry"), F.lit(0))
    return b.withColumn("failed_before", F.col("_t") - 1 - before).drop("_bucket", "_p_carry", "_t")
