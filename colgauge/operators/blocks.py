"""One table of value blocks that a whole run reads.

Profiles, quantile edges, drift, ranks and Gini all need the rows of each column by
value. Here they are summed once to (split, feature, value) with ``n`` rows and ``pos`` rows
of the outcome's class 1, a missing value as a block of its own, cut into ordered buckets and written; what
follows aggregates the blocks and never reads the rows again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from colgauge.functions.scalars import col
from colgauge.operators.binning import interior, stability
from colgauge.operators.order import block_quantiles, melt, range_buckets, running_totals, value_counts


def value_blocks(df: DataFrame, columns: Sequence[str], split: str = "split", target: str | None = None) -> DataFrame:
    """The written blocks: (split, feature, value, n, pos, _bucket)."""
    marked = df.withColumn("_y", (col(target) == 1).cast("int") if target else F.lit(0))
    long = melt(marked, [split, "_y"], columns, keep_null=True)
    counted = value_counts(long, [split, "feature"], {"pos": F.coalesce(F.col("_y"), F.lit(0))})
    return range_buckets(counted, [split, "feature"], "value")


def of_split(blocks: DataFrame, name: str, split: str = "split") -> DataFrame:
    """The blocks of one split, missing values left out: (feature, value, n, pos, _bucket)."""
    return blocks.filter((col(split) == name) & F.col("value").isNotNull()).drop(split)


def profile_blocks(blocks: DataFrame, dtypes: Mapping[str, str], name: str = "train", split: str = "split") -> DataFrame:
    """(feature, dtype, n_rows, missing_rate, n_unique) of one split."""
    types = F.create_map(*[F.lit(x) for kv in dtypes.items() for x in kv])
    sums = blocks.filter((col(split) == name) & F.col("feature").isin(*dtypes)).groupBy("feature").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("_missing"),
        F.count("value").alias("n_unique"))
    return sums.select("feature", types[F.col("feature")].alias("dtype"), "n_rows",
                       F.try_divide(F.col("_missing"), F.col("n_rows")).alias("missing_rate"), "n_unique")


def block_edges(blocks: DataFrame, columns: Sequence[str], bins: int, name: str = "train", split: str = "split") -> dict[str, list[float]]:
    """Sorted unique interior quantile edges of each column; one short list per column reaches the driver."""
    chosen = of_split(blocks, name, split).filter(F.col("feature").isin(*columns))
    found = {r["feature"]: r["values"] for r in block_quantiles(chosen, ["feature"], interior(bins)).collect()}
    return {c: sorted(set(found.get(c, []))) for c in columns}


def block_psi(blocks: DataFrame, columns: Sequence[str], by: str, reference: str, bins: int = 10) -> DataFrame:
    """Stability of each column in every other split against the reference: (feature, by, psi)."""
    edges = block_edges(blocks, columns, bins, reference, by)
    spark = blocks.sparkSession
    # One row for each column.
    known = spark.createDataFrame(list(edges.items()), "feature string, _edges array<double>")
    below = F.size(F.filter("_edges", lambda e: e <= F.col("value")))
    beyond = F.size("_edges")
    coded = blocks.join(F.broadcast(known), "feature").withColumn(
        "code", F.when(F.col("value").isNull(), F.when(beyond == 0, 1).otherwise(beyond + 1)).otherwise(below))
    return stability(coded.groupBy("feature", by, "code").agg(F.sum("n").alias("n")), edges, by, reference)


def block_ranks(blocks: DataFrame, columns: Sequence[str], name: str = "train", split: str = "split") -> DataFrame:
    """The average rank of each distinct value in one split: (feature, value, n, n_total, avg_rank)."""
    chosen = of_split(blocks, name, split).filter(F.col("feature").isin(*columns))
    placed = running_totals(chosen, ["feature"], "value", ["n"])
    return placed.select("feature", "value", "n", "n_total", (F.col("n_before") + (F.col("n") + 1) / 2).alias("avg_rank"))
