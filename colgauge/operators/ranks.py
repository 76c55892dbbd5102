"""Rank statistics over columns: ranks, three Spearman conventions, variable Gini.

The three conventions answer different questions and are kept apart:

* :func:`spearman_pairs` ranks each column over all its rows, then correlates the
  rows where both are present;
* :func:`same_values` drops rows missing in either first and ranks what is left;
* :func:`nearest_column` puts a missing value at the centre of the ranks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colgauge.functions.scalars import col
from colgauge.operators.order import attach_by_value, melt, quantiles, running_totals, value_counts
from colgauge.session import materialise

MIN_ROWS = 3
SAME_MIN_ROWS = 50
REBUILT = 0.99


def rank_table(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """The average rank of each distinct value: (group, value, n, n_total, avg_rank)."""
    blocks = running_totals(value_counts(long, group), group, "value", ["n"])
    return blocks.select(
        *group, "value", "n", "n_total", (F.col("n_before") + (F.col("n") + 1) / 2).alias("avg_rank")
    )


def average_rank(
    df: DataFrame, id_col: str, columns: Sequence[str], by: Sequence[str] = (), table: DataFrame | None = None
) -> DataFrame:
    """Average ranks as rows: (id, by, feature, value, n_total, avg_rank); a missing value has no rank.

    ``table``, if given, is the :func:`rank_table` of the columns.
    """
    long = melt(df, [id_col, *by], columns)
    group = [*by, "feature"]
    table = rank_table(long, group) if table is None else table
    totals = table.groupBy(*group).agg(F.max("n_total").alias("n_total"))
    ranked = attach_by_value(long, table, [*group, "value"], "avg_rank", col(id_col))
    return ranked.join(F.broadcast(totals), group)


def rank_columns(df: DataFrame, id_col: str, columns: Sequence[str], table: DataFrame | None = None) -> DataFrame:
    """One row per id with each column's centred rank, scaled to -0.5..0.5.

    Scaling leaves every correlation as it is and keeps sums of squares small.
    """
    long = average_rank(df, id_col, columns, table=table)
    centred = (F.col("avg_rank") - (F.col("n_total") + 1) / 2) / F.col("n_total")
    return long.groupBy(id_col).agg(
        *[F.max(F.when(F.col("feature") == c, centred)).alias(c) for c in columns]
    )


def _clipped(rho: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))


def correlate(wide: DataFrame, pairs: Sequence[tuple[str, str]], method: str = "blocks") -> DataFrame:
    """Pairwise-complete Pearson correlation: (feature, other, rho, n).

    Sums are taken as blocks, one matrix product per batch of rows, or on request as
    plain aggregates. NULL below three common rows or without spread.
    """
    sums = _block_sums(wide, pairs) if method == "blocks" else _pair_sums(wide, pairs)
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    cov = F.col("sxy") - sx * sy / n
    spread_x, spread_y = F.col("sxx") - sx * sx / n, F.col("syy") - sy * sy / n
    floor = F.lit(1e-12) * n
    usable = (n >= MIN_ROWS) & (spread_x > floor * 1e-3) & (spread_y > floor * 1e-3)
    rho = F.when(usable, _clipped(cov / F.sqrt(spread_x * spread_y)))
    return sums.select("feature", "other", rho.alias("rho"), n.cast("bigint").alias("n"))


def _pair_sums(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        both = col(a).isNotNull() & col(b).isNotNull()
        x, y = F.when(both, col(a)), F.when(both, col(b))
        aggregates.append(F.struct(
            F.lit(a).alias("feature"), F.lit(b).alias("other"),
            F.count(F.when(both, F.lit(1))).cast("double").alias("n"),
            *[F.coalesce(F.sum(e), F.lit(0.0)).alias(name) for name, e in
              (("sx", x), ("sy", y), ("sxy", x * y), ("sxx", x * x), ("syy", y * y))],
        ).alias(f"_p{i}"))
    return wide.agg(F.array(*aggregates).alias("_all")).select(F.inline("_all"))


def _block_sums(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    left = sorted({a for a, _ in pairs})
    right = sorted({b for _, b in pairs})
    wanted = set(pairs)
    columns = sorted(set(left) | set(right))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, len(left), len(right)))
        for batch in batches:
            x, y = batch[left].to_numpy(dtype=float), batch[right].to_numpy(dtype=float)
            mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
            zx, zy = np.nan_to_num(x), np.nan_to_num(y)
            total += np.stack([mx.T @ my, zx.T @ my, mx.T @ zy, zx.T @ zy, (zx * zx).T @ my, mx.T @ (zy * zy)])
        rows = [
            (a, b, *total[:, i, j])
            for i, a in enumerate(left) for j, b in enumerate(right) if (a, b) in wanted
        ]
        yield pd.DataFrame(rows, columns=["feature", "other", "n", "sx", "sy", "sxy", "sxx", "syy"])

    schema = "feature string, other string, n double, sx double, sy double, sxy double, sxx double, syy double"
    parts = wide.select(*[col(c) for c in columns]).mapInPandas(partial, schema)
    return parts.groupBy("feature", "other").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")]
    )


def spearman_pairs(
    df: DataFrame, id_col: str, pairs: Sequence[tuple[str, str]], method: str = "blocks", table: DataFrame | None = None
) -> DataFrame:
    """Rank correlation over ranks of the whole column: (feature, other, rho, n); ``table`` as in :func:`average_rank`."""
    columns = list(dict.fromkeys(name for pair in pairs for name in pair))
    return correlate(rank_columns(df, id_col, columns, table), pairs, method)


def spearman_target(df: DataFrame, id_col: str, features: Sequence[str], target: str) -> DataFrame:
    return spearman_pairs(df, id_col, [(f, target) for f in features])


def same_values(
    df: DataFrame, id_col: str, a: str, b: str, limit: float = REBUILT, min_rows: int = SAME_MIN_ROWS
) -> DataFrame:
    """Whether two columns rank the rows they share alike: n, rho, same.

    Rows missing in either are dropped before ranking. NULL with fewer than
    ``min_rows`` rows or a constant side.
    """
    both = df.filter(col(a).isNotNull() & col(b).isNotNull()).select(
        col(id_col), col(a).cast("double").alias("a"), col(b).cast("double").alias("b")
    )
    out = correlate(rank_columns(both, id_col, ["a", "b"]), [("a", "b")])
    rho = F.when(F.col("n") >= min_rows, F.col("rho"))
    return out.select(
        F.lit(a).alias("feature"), F.lit(b).alias("other"), "n", rho.alias("rho"),
        F.coalesce((F.abs(rho) >= limit).cast("int"), F.lit(0)).alias("same"),
    )


def nearest_column(df: DataFrame, id_col: str, features: Sequence[str], base: Sequence[str]) -> DataFrame:
    """The base column each feature moves with most: (feature, nearest, nearest_rho, max_abs_rho).

    A missing value sits at the centre of the ranks. A constant feature has no row.
    """
    ranks = rank_columns(df, id_col, [*features, *base])
    columns = [c for c in ranks.columns if c != id_col]
    # Ids with no value at all drop out of the ranks, and a centred 0 changes no sum
    # but the row count, which the correlation of centred ranks does not need.
    centred = ranks.select(*[F.coalesce(col(c), F.lit(0.0)).alias(c) for c in columns])
    pairs = [(f, b) for f in features for b in base if f != b]
    sums = _block_sums(centred, pairs)
    rho = F.when(
        (F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))
    )
    scored = sums.select("feature", "other", rho.alias("rho")).filter(F.col("rho").isNotNull())
    best = F.max(F.struct(F.abs("rho").alias("size"), F.col("other"), F.col("rho"))).alias("_best")
    return scored.groupBy("feature").agg(best).select(
        "feature", F.col("_best.other").alias("nearest"), F.col("_best.rho").alias("nearest_rho"),
        F.col("_best.size").alias("max_abs_rho"),
    )


def residual_rho(df: DataFrame, id_col: str, features: Sequence[str], target: str, prediction: str) -> DataFrame:
    """Centre-filled rank correlation of each feature with what a prediction misses: (feature, residual_rho)."""
    rows = df.withColumn("_residual", col(target).cast("double") - col(prediction).cast("double"))
    near = nearest_column(rows, id_col, features, ["_residual"])
    return near.select("feature", F.col("nearest_rho").alias("residual_rho"))


def variable_gini(
    df: DataFrame, columns: Sequence[str], target: str, by: Sequence[str] = ()
) -> DataFrame:
    """Each column alone as a score for a 0/1 target: (by, feature, variable_gini).

    |2 AUC - 1| with ties shared and a missing value at the median. NULL for a
    constant column or a single class. ``df`` is summed to distinct values first.
    """
    group = [*by, "feature"]
    medians = quantiles(df, columns, [0.5], by).select(*group, F.col("values")[0].alias("_median"))
    long = melt(df.withColumn("_y", (col(target) == 1).cast("int")), [*by, "_y"], columns, keep_null=True)
    counted = value_counts(long, group, {"pos": F.coalesce(F.col("_y"), F.lit(0))})
    filled = (
        counted.join(F.broadcast(medians), group)   # one row for each group: the blocks of a group stay apart
        .withColumn("value", F.coalesce("value", "_median"))
        .groupBy(*group, "value")
        .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    )
    blocks = running_totals(filled, group, "value", ["n", "pos"])
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    sums = blocks.groupBy(*group).agg(
        F.sum(F.col("pos") * rank).alias("_ranks"), F.max("pos_total").cast("double").alias("_n1"),
        F.max("n_total").cast("double").alias("_n"), F.count(F.lit(1)).alias("_levels"),
    )
    n1, n0 = F.col("_n1"), F.col("_n") - F.col("_n1")
    auc = (F.col("_ranks") - n1 * (n1 + 1) / 2) / (n1 * n0)
    usable = (F.col("_levels") > 1) & (n1 > 0) & (n0 > 0)
    return sums.select(*group, F.when(usable, F.abs(2 * auc - 1)).alias("variable_gini"))


def no_signal_reason(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Why a column cannot be judged on test: (feature, reason), only for such columns."""
    long = melt(df, [split], columns, keep_null=True)
    states = long.groupBy("feature", split).agg(
        F.count("value").alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi")
    )
    state = F.when(F.col("_n") == 0, F.lit("empty")).when(
        F.col("_lo") == F.col("_hi"), F.concat(F.lit("one value ("), F.call_function("format_number", F.col("_lo"), F.lit("0.######")), F.lit(")"))
    )
    per_feature = states.withColumn("_state", state).groupBy("feature").agg(
        F.max(F.when(F.col(split) == "valid", F.col("_state"))).alias("_valid"),
        F.max(F.when(F.col(split) == "test", F.col("_state"))).alias("_test"),
        F.max(F.when((F.col(split) == "train") & (F.col("_lo") != F.col("_hi")), F.lit(1))).alias("_varied"),
    )
    where = F.when(F.col("_valid").isNotNull(), F.lit(" on valid and test")).otherwise(F.lit(" on test"))
    hint = F.when(
        F.col("_varied") == 1, F.lit("; it does vary on train, so its source may end too early")
    ).otherwise(F.lit(""))
    return per_feature.filter(F.col("_test").isNotNull()).select(
        "feature", F.concat(F.col("_test"), where, hint).alias("reason")
    )


def feature_stats(
    df: DataFrame, id_col: str, features: Sequence[str], base: Sequence[str], target: str, split: str = "split"
) -> DataFrame:
    """Per feature: missing rate over all rows, nearest base column on train, variable Gini on test or why it has none.

    ``df`` is read once: what is asked of it here is written first.
    """
    df = materialise(df.select(*[col(c) for c in dict.fromkeys([id_col, split, target, *features, *base])]), "feature-rows")
    long = df.agg(*[
        F.avg(col(f).isNull().cast("double")).alias(f) for f in features
    ]).unpivot([], list(features), "feature", "missing_rate")
    train = df.filter(col(split) == "train")
    pairs = [(f, b) for f in features for b in base if f != b]
    best = (
        spearman_pairs(train, id_col, pairs)
        .filter(F.col("rho").isNotNull())
        .groupBy("feature")
        .agg(F.max(F.struct(F.abs("rho").alias("size"), F.col("other"))).alias("_b"))
        .select("feature", F.col("_b.size").alias("max_corr"), F.col("_b.other").alias("max_corr_with"))
    )
    gini = variable_gini(df.filter(col(split) == "test"), features, target)
    why = no_signal_reason(df, features, split).withColumnRenamed("reason", "_why")
    note = F.when(F.col("variable_gini").isNull(), F.coalesce("_why", F.lit("no signal on test")))
    return (
        long.join(best, "feature", "left").join(gini, "feature", "left").join(why, "feature", "left")
        .withColumn("variable_gini_note", note).drop("_why")
    )
