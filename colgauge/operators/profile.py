"""What a table holds: missing rates, distinct counts, examples, class mix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from colgauge.functions.scalars import col


def _text_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """(feature, dtype, n_rows, missing_rate, n_unique) for each column.

    Distinct values are counted in two steps, so a value that fills a third of the
    rows is one row before it is shuffled; ``exact=False`` uses a sketch instead.
    """
    columns = list(columns or df.columns)
    dtypes = F.create_map(*[x for n, t in df.dtypes if n in set(columns) for x in (F.lit(n), F.lit(t))])
    if exact:
        values = _text_long(df, columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        out = values.groupBy("feature").agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("_missing"),
            F.count("value").alias("n_unique"),
        )
    else:
        row = df.agg(*[F.struct(
            F.lit(c).alias("feature"), F.count(F.lit(1)).alias("n_rows"), F.count_if(col(c).isNull()).alias("_missing"),
            F.approx_count_distinct(col(c)).alias("n_unique")).alias(f"_{i}") for i, c in enumerate(columns)])
        out = row.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))
    return out.select(
        "feature", dtypes[F.col("feature")].alias("dtype"), "n_rows",
        F.try_divide(F.col("_missing"), F.col("n_rows")).alias("missing_rate"), "n_unique",
    )


def column_examples(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """(feature, low, high, examples): the range and the first ``n`` values in text order.

    Values reduce to their distinct ones, and those to ``n`` per column, before they meet.
    """
    from pyspark.sql import Window

    values = _text_long(df, columns).filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.lit(1).alias("_"))
    ranked = values.withColumn("_rn", F.row_number().over(Window.partitionBy("feature").orderBy("value"))).filter(F.col("_rn") <= n)
    examples = ranked.groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    ranges = df.agg(*[F.struct(
        F.lit(c).alias("feature"), F.min(col(c)).cast("string").alias("low"), F.max(col(c)).cast("string").alias("high")
    ).alias(f"_{i}") for i, c in enumerate(columns)])
    ranges = ranges.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))
    return ranges.join(examples, "feature", "left")


def low_variation(df: DataFrame, columns: Sequence[str], threshold: float = 0.05) -> DataFrame:
    """Columns whose spread is under ``threshold`` of their mean: (feature, variation)."""
    stats = df.agg(*[F.struct(
        F.lit(c).alias("feature"), F.stddev_samp(col(c)).alias("_sd"), F.avg(col(c)).alias("_mean"), F.count(col(c)).alias("_n")
    ).alias(f"_{i}") for i, c in enumerate(columns)])
    long = stats.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))
    ratio = F.when((F.col("_n") >= 2) & (F.col("_mean") != 0), F.col("_sd") / F.abs("_mean"))
    return long.select("feature", ratio.alias("variation")).filter(F.col("variation") < threshold)


def class_mix(df: DataFrame, target: str, by: str) -> DataFrame:
    """Rows, positives and their rate per split or batch."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(col(target) == 1).alias("positives"),
        F.avg((col(target) == 1).cast("double")).alias("rate"),
    )


def coverage(feature: DataFrame, ids: DataFrame, name: str, id_col: str = "id") -> DataFrame:
    """One row: the ids and the share of them the feature has a value for."""
    known = feature.filter(col(name).isNotNull()).select(id_col).distinct().withColumn("_has", F.lit(1))
    return ids.select(id_col).join(known, id_col, "left").agg(
        F.count(F.lit(1)).alias("n_ids"), F.avg(F.coalesce("_has", F.lit(0)).cast("double")).alias("coverage")
    )
