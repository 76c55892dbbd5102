"""Quantile codes, mutual information and population stability."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colgauge.functions.scalars import col
from colgauge.operators.order import quantiles
from colgauge.session import materialise


def interior(bins: int) -> list[float]:
    """The interior probabilities of ``bins`` equal shares."""
    return [i / bins for i in range(1, bins)]


def quantile_edges(
    df: DataFrame, columns: Sequence[str], bins: int, accuracy: int | None = None
) -> dict[str, list[float]]:
    """Sorted unique interior quantile edges per column, as plain numbers.

    One short list per column reaches the driver. Exact unless ``accuracy`` asks for
    the sketch of ``percentile_approx``, with a rank error of 1/accuracy.
    """
    if accuracy is not None:
        row = df.agg(*[
            F.percentile_approx(col(c).cast("double"), interior(bins), accuracy).alias(c) for c in columns
        ]).first()
        found = {c: row[c] or [] for c in columns}
    else:
        found = {r["feature"]: r["values"] for r in quantiles(df, columns, interior(bins)).collect()}
    return {c: sorted(set(found.get(c, []))) for c in columns}


def code(value: str | Column, edges: Sequence[float]) -> Column:
    """How many edges are at most the value; a missing value has a code of its own."""
    v = col(value).cast("double")
    if not edges:
        return F.when(v.isNull(), F.lit(1)).otherwise(F.lit(0))
    points = F.array(*[F.lit(float(e)) for e in edges])
    below = F.size(F.filter(points, lambda e: e <= v))
    return F.when(v.isNull(), F.lit(len(edges) + 1)).otherwise(below)


def quantile_codes(
    df: DataFrame, keep: Sequence[str], edges: Mapping[str, Sequence[float]]
) -> DataFrame:
    """``keep`` plus each column's bucket code."""
    return df.select(*[col(k) for k in keep], *[code(c, e).alias(c) for c, e in edges.items()])


def mutual_info_pairs(codes: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Mutual information of coded columns: (feature, other, mi, nmi).

    Natural logarithms, floored at 0; ``nmi`` divides by the smaller entropy and is
    NULL when that is 0. Rows reduce to joint counts before any shuffle, which are written.
    """
    # A few hundred counts a pair, read several times; the rows are counted once.
    return _mi_from_joint(materialise(joint_counts(codes, pairs), "joint"), ["feature", "other"])


def joint_counts(codes: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(feature, other, a, b, n): how often two codes meet, counted as arrays batch by batch.

    No row is repeated for its pairs: a task adds up one table of counts for each pair
    and gives out what is in it once, at its end. NULL is a code like any other.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, dict] = {c: {} for c in columns}
        tables = [np.zeros((1, 1), np.int64) for _ in pairs]
        for batch in batches:
            places = {}
            for c in columns:
                values, inverse = np.unique(batch[c].to_numpy(float, na_value=np.nan), return_inverse=True)
                places[c] = np.array([seen[c].setdefault(None if np.isnan(v) else int(v), len(seen[c])) for v in values], np.int64)[inverse]
            for k, (a, b) in enumerate(pairs):
                shape = len(seen[a]), len(seen[b])
                counted = np.bincount(places[a] * shape[1] + places[b], minlength=shape[0] * shape[1]).reshape(shape)
                counted[: tables[k].shape[0], : tables[k].shape[1]] += tables[k]
                tables[k] = counted
        for (a, b), held in zip(pairs, tables):
            i, j = np.nonzero(held)
            left, right = list(seen[a]), list(seen[b])
            yield pd.DataFrame({
                "feature": a, "other": b, "a": pd.array([left[x] for x in i], dtype="Int32"),
                "b": pd.array([right[x] for x in j], dtype="Int32"), "n": held[i, j]})

    parts = codes.select(*[col(c).cast("int").alias(c) for c in columns]).mapInPandas(count, "feature string, other string, a int, b int, n long")
    return parts.groupBy("feature", "other", "a", "b").agg(F.sum("n").alias("n"))


def _mi_from_joint(joint: DataFrame, pair: Sequence[str]) -> DataFrame:
    pa = joint.groupBy(*pair, "a").agg(F.sum("n").alias("na"))
    pb = joint.groupBy(*pair, "b").agg(F.sum("n").alias("nb"))
    total = joint.groupBy(*pair).agg(F.sum("n").cast("double").alias("t"))
    entropy = lambda side, n: (
        side.join(total, list(pair)).groupBy(*pair).agg((-F.sum(F.col(n) / F.col("t") * F.ln(F.col(n) / F.col("t")))).alias(f"h_{n}"))
    )
    p = F.col("n") / F.col("t")
    mi = (
        joint.join(pa, [*pair, "a"]).join(pb, [*pair, "b"]).join(total, list(pair))
        .groupBy(*pair)
        .agg(F.sum(p * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    )
    floor = F.greatest(F.col("mi"), F.lit(0.0))
    smaller = F.least("h_na", "h_nb")
    return (
        mi.join(entropy(pa, "na"), list(pair)).join(entropy(pb, "nb"), list(pair))
        .select(*pair, floor.alias("mi"), F.when(smaller > 0, floor / smaller).alias("nmi"))
    )


def target_mi(
    df: DataFrame, features: Sequence[str], target: str, bins: int, task: str = "binary",
    edges: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """Mutual information with the outcome: (feature, mi_target, nmi_target).

    A binary outcome is used as its classes, any other as its own quantile codes.
    """
    numeric = [*features] if task == "binary" else [*features, target]
    edges = edges or quantile_edges(df, numeric, bins)
    coded = quantile_codes(df, [target] if task == "binary" else [], {c: edges[c] for c in numeric})
    out = mutual_info_pairs(coded, [(f, target) for f in features])
    return out.select("feature", F.col("mi").alias("mi_target"), F.col("nmi").alias("nmi_target"))


def _bucket_shares(coded: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Counts per (by, feature, code)."""
    stacked = coded.select(by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), col(c).cast("int").alias("code")) for c in columns
    ])).alias("_p")).select(by, "_p.*")
    return stacked.groupBy("feature", by, "code").agg(F.count(F.lit(1)).alias("n"))


def psi(
    df: DataFrame, columns: Sequence[str], by: str, reference: str, bins: int = 10,
    accuracy: int | None = None,
) -> DataFrame:
    """Stability of each column in every other part against the reference part: (feature, by, psi).

    Buckets are the reference's quantiles plus one for missing values; a share is
    never below half an observation. NULL when the reference is all missing.
    """
    edges = quantile_edges(df.filter(col(by) == reference), columns, bins, accuracy)
    coded = quantile_codes(df, [by], edges)
    counts = _bucket_shares(coded, by, columns)
    return stability(counts, edges, by, reference)


def stability(counts: DataFrame, edges: Mapping[str, Sequence[float]], by: str, reference: str) -> DataFrame:
    """:func:`psi` from rows counted by (feature, by, code)."""
    levels = F.create_map(*[x for c in edges for x in (F.lit(c), F.lit(len(edges[c]) + 2 if edges[c] else 0))])
    totals = counts.groupBy("feature", by).agg(F.sum("n").alias("t"))
    grid = totals.withColumn("code", F.explode(F.sequence(F.lit(0), F.greatest(levels[F.col("feature")] - 1, F.lit(0)))))
    full = grid.join(counts, ["feature", by, "code"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.greatest(F.col("n") / F.col("t"), F.lit(0.5) / F.col("t"))
    shares = full.select("feature", by, "code", share.alias("p"))
    ref = shares.filter(col(by) == reference).select("feature", "code", F.col("p").alias("pa"))
    other = shares.filter(col(by) != reference).withColumnRenamed("p", "pb")
    out = other.join(ref, ["feature", "code"]).groupBy("feature", by).agg(
        F.sum((F.col("pa") - F.col("pb")) * F.ln(F.col("pa") / F.col("pb"))).alias("psi")
    )
    usable = levels[F.col("feature")] > 0
    return out.select("feature", by, F.when(usable, F.col("psi")).alias("psi"))


def distribution_check(
    df: DataFrame, columns: Sequence[str], reference: str = "train", others: Sequence[str] = ("valid", "test"),
    split: str = "split", bins: int = 10, stabilities: DataFrame | None = None,
) -> DataFrame:
    """One row per column: psi_{split} for each other split, psi_max and psi_worst_split.

    ``stabilities``, if given, is what :func:`psi` would find.
    """
    long = psi(df, columns, split, reference, bins) if stabilities is None else stabilities
    named = [F.max(F.when(col(split) == s, F.col("psi"))).alias(f"psi_{s}") for s in others]
    worst = F.max(F.when(
        F.col("psi").isNotNull(),
        F.struct(F.col("psi"), -F.array_position(F.array(*[F.lit(s) for s in others]), col(split)), col(split).alias("s")),
    )).alias("_w")
    wide = long.filter(col(split).isin(*others)).groupBy("feature").agg(*named, worst)
    return wide.select(
        "feature", *[f"psi_{s}" for s in others], F.col("_w.psi").alias("psi_max"),
        F.coalesce(F.col("_w.s"), F.lit("")).alias("psi_worst_split"),
    )


def stability_by_period(
    df: DataFrame, columns: Sequence[str], period: str, reference: str, bins: int = 10
) -> DataFrame:
    """Stability of each column in each period against a reference period."""
    return psi(df.withColumn(period, col(period).cast("string")), columns, period, str(reference), bins)

