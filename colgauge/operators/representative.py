"""Rows that stand for a table: encoded, clustered per class, the closest of each cluster picked."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from colgauge.functions.scalars import col, finite
from colgauge.operators.order import quantiles
from colgauge.session import materialise

MISSING_LEVEL = "__MISSING__"
CANDIDATES = 20     # rows of a class, for each centre, that starting centres are drawn among


def encode_for_clustering(
    df: DataFrame, id_col: str, continuous: Sequence[str], categorical: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """(id, keep, encoded): medians for gaps, values clipped to their 0.5 and 99.5 percentiles,
    standardised; categories one-hot with a level for missing."""
    if not continuous and not categorical:
        raise ValueError("no columns to cluster on")
    rows = df.select(
        col(id_col), *[col(k) for k in keep], *[finite(c).alias(c) for c in continuous],
        *[F.coalesce(col(c).cast("string"), F.lit(MISSING_LEVEL)).alias(c) for c in categorical],
    )
    parts = []
    if continuous:
        median = {r.feature: r["values"][0] for r in quantiles(rows, continuous, [0.5]).collect()}
        rows = rows.withColumns({c: F.coalesce(col(c), F.lit(median.get(c, 0.0))) for c in continuous})
        bounds = {r.feature: r["values"] for r in quantiles(rows, continuous, [0.005, 0.995]).collect()}
        rows = rows.withColumns({
            c: F.least(F.greatest(col(c), F.lit(bounds[c][0])), F.lit(bounds[c][1])) for c in continuous
        })
        stats = rows.agg(*[F.struct(F.avg(col(c)).alias("m"), F.stddev_pop(col(c)).alias("s")).alias(c) for c in continuous]).first()
        rows = rows.withColumns({c: (col(c) - F.lit(stats[c].m)) / F.lit(stats[c].s or 1.0) for c in continuous})
        parts += list(continuous)
    if categorical:
        indexed = [f"_index_{c}" for c in categorical]
        hot = [f"_hot_{c}" for c in categorical]
        rows = StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep").fit(rows).transform(rows)
        rows = OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=False).fit(rows).transform(rows)
        parts += hot
    return VectorAssembler(inputCols=parts, outputCol="encoded").transform(rows).select(id_col, *keep, "encoded")


def seed_centres(rows: DataFrame, id_col: str, target: str, k: int, seed: int = 42) -> DataFrame:
    """(target, cluster, centre): k starting rows of each class, each drawn the likelier the farther it lies from those before it.

    They are drawn among ``CANDIDATES`` times k rows of a class, those first in a seeded hash order, which each task cuts before it shuffles.
    """
    first = Window.partitionBy(target).orderBy(F.xxhash64(col(id_col), F.lit(seed)), id_col)
    few = rows.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= CANDIDATES * k)

    def draw(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(part.sort_values("_place")["_x"].to_numpy())
        rng, taken = np.random.default_rng(seed), [0]
        gap = ((x - x[0]) ** 2).sum(axis=1)
        while len(taken) < min(k, len(x)):
            # Rows that equal a centre have no weight; where all do, the next ones in hash order serve.
            free = np.setdiff1d(np.arange(len(x)), taken)
            taken.append(int(rng.choice(len(x), p=gap / gap.sum()) if gap.sum() > 0 else free[0]))
            gap = np.minimum(gap, ((x - x[taken[-1]]) ** 2).sum(axis=1))
        return pd.DataFrame({target: [key[0]] * len(taken), "cluster": range(len(taken)), "centre": [x[i].tolist() for i in taken]})

    kind = rows.schema[target].dataType.simpleString()
    return few.select(col(target), "_place", vector_to_array("encoded").alias("_x")).groupBy(target).applyInPandas(
        draw, f"`{target}` {kind}, cluster int, centre array<double>")


def nearest_centres(rows: DataFrame, target: str, centres: DataFrame) -> DataFrame:
    """``rows`` with ``cluster`` and ``distance``: the nearest centre of their class, ties to the lower one, and the square of the way."""
    listed = centres.groupBy(target).agg(F.collect_list(F.struct("cluster", "centre")).alias("_centres"))  # k of a class

    def to(c):
        square = F.zip_with("_x", c["centre"], lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(square, F.lit(0.0), lambda total, v: total + v).alias("distance"), c["cluster"].alias("cluster"))

    best = F.array_min(F.transform("_centres", to))
    found = rows.withColumn("_x", vector_to_array("encoded")).join(listed, target).withColumn("_best", best)
    return found.select(*rows.columns, F.col("_best.cluster").alias("cluster"), F.col("_best.distance").alias("distance"))


def grouped_kmeans(rows: DataFrame, target: str, centres: DataFrame, rounds: int = 20, close: float = 1e-4) -> DataFrame:
    """(target, cluster, centre): Lloyd's rounds from ``centres`` in all classes at once.

    A round is one job whatever the number of classes: rows meet the few centres of their class, and vectors are summed
    by (class, cluster) in each task before they are shuffled. A centre without rows stays. Rounds end
    once no centre moves farther than ``close``.
    """
    centres = materialise(centres, "centres")
    for _ in range(rounds):
        means = nearest_centres(rows, target, centres).groupBy(target, "cluster").agg(
            vector_to_array(Summarizer.mean(F.col("encoded"))).alias("_mean"))
        shift = F.aggregate(F.zip_with("centre", "_next", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, v: total + v)
        moved = materialise(centres.join(means, [target, "cluster"], "left").withColumn("_next", F.coalesce("_mean", "centre")).select(
            target, "cluster", F.col("_next").alias("centre"), shift.alias("_shift")), "centres")
        centres = moved.drop("_shift")
        if (moved.agg(F.max("_shift")).first()[0] or 0.0) <= close * close:
            break
    return centres


def representative_rows(
    encoded: DataFrame, id_col: str, target: str, shots: int, batches: int, seed: int = 42, rounds: int = 20
) -> DataFrame:
    """(id, target, cluster, batch, distance): per class, shots/classes clusters; batch b holds
    the b-th closest row of every cluster, starting over where a cluster is shorter.

    A class with no more rows than clusters is shown whole, each row its own cluster. Rows without a class are left out.
    """
    encoded = materialise(encoded.select(id_col, target, "encoded").filter(col(target).isNotNull()), "encoded")
    sizes = materialise(encoded.groupBy(target).agg(F.count(F.lit(1)).alias("_n")), "classes")
    per_class = max(1, shots // max(1, sizes.count()))
    whole = encoded.join(sizes.filter(F.col("_n") <= per_class).select(target), target, "left_semi")
    large = encoded.join(sizes.filter(F.col("_n") > per_class).select(target), target, "left_semi")
    centres = grouped_kmeans(large, target, seed_centres(large, id_col, target, per_class, seed), rounds)
    clustered = nearest_centres(large, target, centres)
    out = clustered.select(col(id_col), col(target), F.col("cluster").cast("bigint").alias("cluster"), "distance").unionByName(
        whole.select(col(id_col), col(target), F.xxhash64(id_col).alias("cluster"), F.lit(0.0).alias("distance")))
    by = Window.partitionBy(target, "cluster").orderBy("distance", id_col)
    closest = out.withColumn("_place", F.row_number().over(by)).filter(F.col("_place") <= batches)
    found = Window.partitionBy(target, "cluster")
    listed = closest.withColumn("_size", F.count(F.lit(1)).over(found))
    # Place p of a cluster of s rows serves batches p-1, p-1+s, p-1+2s, ...
    served = F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(batches - 1)), lambda b: F.pmod(b, F.col("_size")) == F.col("_place") - 1))
    return listed.select(id_col, target, "cluster", served.alias("batch"), "distance")
