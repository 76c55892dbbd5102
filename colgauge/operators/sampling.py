"""Splits and samples drawn by a seeded hash order: exact sizes, the same rows every time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from colgauge.functions.scalars import col
from colgauge.operators.order import hash_order
from colgauge.session import materialise


_TOP = 48   # bits below the hash ranges that are counted first


def _class_cuts(rows: DataFrame, cuts: Mapping[str, Column]) -> DataFrame:
    """Per group the hash each cut falls on: the k-th smallest; NULL for k = 0.

    ``cuts`` gives k by name and may use ``n_total``, the rows of the group. Rows are counted by
    the leading bits of their hash, at most 65,536 counts for a group; only the rows of the one
    range that a cut falls in are put in order. The result has a row for each group.
    """
    place = F.shiftright("_hash", _TOP)
    counts = rows.groupBy("_group", place.alias("_range")).agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("_group").orderBy("_range")
    run = counts.withColumns({
        "_upto": F.sum("n").over(along), "n_total": F.sum("n").over(Window.partitionBy("_group"))})
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("cut"), k.cast("bigint").alias("k")) for name, k in cuts.items()]))
    asked = run.select("_group", "_range", "_upto", "n", wanted.alias("_w")).select("*", "_w.cut", "_w.k")
    edges = materialise(asked.filter((F.col("k") <= F.col("_upto")) & (F.col("k") > F.col("_upto") - F.col("n"))).select(
        "_group", "_range", "cut", (F.col("k") - F.col("_upto") + F.col("n")).alias("_nth")), "cut-ranges")
    inside = rows.select("_group", "_hash", place.alias("_range")).join(edges, ["_group", "_range"])
    order = Window.partitionBy("_group", "cut").orderBy("_hash")
    found = inside.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == F.col("_nth"))
    # Written, so that what joins it knows how small it is.
    return materialise(found.groupBy("_group").agg(*[F.max(F.when(F.col("cut") == n, F.col("_hash"))).alias(n) for n in cuts]), "cuts")


def _hashed(df: DataFrame, ids: Sequence[str], seed: int, group: Column) -> DataFrame:
    return df.withColumns({"_hash": hash_order(ids, seed), "_group": F.coalesce(group.cast("string"), F.lit(""))})


def stratified_split(
    df: DataFrame, target: str, id_cols: Sequence[str], valid: float = 0.2, test: float = 0.2, seed: int = 42,
    name: str = "split",
) -> DataFrame:
    """Adds train/valid/test, cutting each class in hash order by its rounded sizes.

    Only the two cut points of each class are computed; rows are then labelled
    where they are. Rows sharing a 64-bit hash go the same way.
    """
    rows = _hashed(df, id_cols, seed, col(target))
    n_test = F.round(F.col("n_total") * test)
    n_valid = F.round(F.col("n_total") * valid)
    cuts = _class_cuts(rows, {"_t": n_test, "_v": n_test + n_valid})
    label = F.when(F.col("_hash") <= F.col("_t"), "test").when(F.col("_hash") <= F.col("_v"), "valid").otherwise("train")
    return rows.join(cuts, "_group", "left").withColumn(name, label).drop("_hash", "_group", "_t", "_v")


def balanced_sample(df: DataFrame, target: str, id_cols: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """Up to size/classes rows of each class, in hash order."""
    rows = _hashed(df, id_cols, seed, col(target))
    classes = max(1, rows.select("_group").distinct().count())
    cuts = _class_cuts(rows, {"_c": F.least(F.lit(max(1, size // classes)), F.col("n_total"))})
    return rows.join(cuts, "_group").filter(F.col("_hash") <= F.col("_c")).drop("_hash", "_group", "_c")


def uniform_sample(df: DataFrame, id_cols: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """``size`` rows of all, in hash order: one cut, and a filter where the rows are."""
    rows = _hashed(df, id_cols, seed, F.lit("all"))
    cut = _class_cuts(rows, {"_c": F.least(F.lit(size), F.col("n_total"))}).first()
    if cut is None or cut["_c"] is None:
        return df.limit(0)
    return df.filter(hash_order(id_cols, seed) <= F.lit(cut["_c"]))


def split_by_time(df: DataFrame, time: str, valid_from: Column, test_from: Column, name: str = "split") -> DataFrame:
    """An out-of-time split at two dates."""
    return df.withColumn(
        name, F.when(col(time) < valid_from, "train").when(col(time) < test_from, "valid").otherwise("test")
    )


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each group; every task keeps only its own k before they meet."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, place).filter(F.col(name) <= k)


def head_report(rows: DataFrame, id_col: str, order: Sequence[Column], n: int, pinned: Column) -> DataFrame:
    """The first ``n`` rows, and every pinned row that would have fallen off the end.

    Only the head is ever sorted; rows of a repeated id come in together.
    """
    head = rows.orderBy(*order).limit(n)
    below = rows.filter(pinned).join(head.select(id_col), id_col, "left_anti").select(*rows.columns)
    return head.union(below)


def rotate_batches(rows: DataFrame, place: str, size: int, round_number: int) -> DataFrame:
    """The batch of a numbered list that a round shows: row n is in batch n div size."""
    last = rows.agg(F.max(place)).scalar()
    batches = F.floor(last / F.lit(size)) + 1
    return rows.withColumn("batch", F.floor(col(place) / F.lit(size))).filter(
        F.col("batch") == F.pmod(F.lit(round_number), batches)
    )
