"""Global order without one long sorted group.

Ranks, quantiles, Gini and capture rates all need positions in one long order, and
one group (a split, a model variant, a busy key) may hold most of the rows. A window
over the whole group would put it in one task. Instead:

1. rows are summed to one block per distinct value (partial aggregation shrinks
   repeated values before the shuffle),
2. the blocks are range-partitioned by group and value and written with the number of
   their partition, their bucket: the cuts follow the blocks themselves, so a cluster of
   values within a hair's breadth fills as many buckets as any others; while a bucket is
   written, each of its blocks notes what came before it inside,
3. the small table of bucket totals is summed in bucket order, and each block adds what the
   earlier buckets hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from colgauge.functions.scalars import col, seconds
from colgauge.session import materialise

BUCKET_BYTES = 32 << 10   # of small tables; larger ones have as many buckets as the session shuffles into
LEAST_BUCKETS = 128       # but no fewer than these
SENT = 50_000             # bucket totals that are sent to every task
HELD = 1 << 20            # rows a task holds while it adds up what it reads


def buckets_for(df: DataFrame) -> int:
    """How many buckets to cut a table into, by its size as the plan knows it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = max(LEAST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(most, size // BUCKET_BYTES))


def range_buckets(blocks: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """``blocks`` written with ``_bucket``, a number that never decreases along ``order`` within a group.

    A bucket is a partition of Spark's range partitioning, each with about as many
    blocks. The table is written: both uses of the running totals, and every task that is run again,
    see the same cuts. NULL sorts lowest.
    """
    cut = blocks.repartitionByRange(buckets_for(blocks), *[col(g) for g in group], col(order))
    return materialise(cut.withColumn("_bucket", F.spark_partition_id().cast("bigint")), "ordered-blocks")


def time_bucket(time: str | Column, width: int = 86_400) -> Column:
    """The number of the ``width``-second interval a time falls in."""
    return F.floor(seconds(time) / F.lit(width))


def carry_in(
    df: DataFrame,
    group: Sequence[str],
    bucket: str,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    totals: bool = False,
) -> DataFrame:
    """Adds what the earlier buckets of the row's group hold.

    ``{name}_carry`` is the sum (or maximum) over every earlier bucket, and with
    ``totals`` ``{name}_total`` is the sum over the whole group. Only the table of
    bucket totals is sorted. Rows without a group are left out.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    # Said before both uses of ``df``, so that the join adds no condition to one side
    # only and the shuffle that made ``df`` is run once and read twice.
    for g in group:
        df = df.filter(col(g).isNotNull())
    per_bucket = df.groupBy(*group, bucket).agg(
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_m_{n}") for n, c in maxima.items()],
    )
    return df.join(_offsets(per_bucket, group, bucket, sums, maxima, totals), [*group, bucket], "left")


def _offsets(per_bucket: DataFrame, group: Sequence[str], bucket: str, sums: Sequence[str], maxima: Sequence[str], totals: bool) -> DataFrame:
    """What the earlier buckets of each bucket's group hold, from the table of bucket totals."""
    whole = Window.partitionBy(*group)
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select(
        *group,
        bucket,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"{n}_carry") for n in sums],
        *[F.max(f"_m_{n}").over(before).alias(f"{n}_carry") for n in maxima],
        *([F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in sums] if totals else []),
    )


def _changes(column: pa.Array) -> np.ndarray:
    """Where a column's value is another than in the row before; NULL equals NULL and NaN equals NaN."""
    coded = np.asarray(column.dictionary_encode("encode").indices if not pa.types.is_floating(column.type) else column.fill_null(0.0))
    other = np.ones(len(coded), bool)
    other[1:] = coded[1:] != coded[:-1]
    if pa.types.is_floating(column.type):
        missing, odd = np.asarray(column.is_null()), np.isnan(coded)
        other[1:] = (other[1:] & ~(odd[1:] & odd[:-1])) | (missing[1:] != missing[:-1])
    return other


def _last_known(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches that hold rows, and whether each is the last."""
    held = None
    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield held, False
            held = batch
    if held is not None:
        yield held, True


def _inside(group: Sequence[str], order: str, sums: Sequence[str], merge: bool):
    """Rows of one bucket in order, each with the sums over the rows of its group before it; on request equal rows as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, carried, rest = None, None, None
        for batch, last in _last_known(batches):
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
                rest = None
            if merge:
                starts = np.flatnonzero(np.logical_or.reduce([_changes(batch.column(c)) for c in [*group, order]]))
                if not last:        # more of the last one may follow
                    rest, batch = batch.slice(starts[-1]), batch.slice(0, starts[-1])
                    starts = starts[:-1]
                    if not len(starts):
                        continue
                added = {c: np.add.reduceat(np.asarray(batch.column(c)), starts) for c in sums}
                first = batch.take(pa.array(starts))
                batch = pa.RecordBatch.from_arrays(
                    [pa.array(added[c]) if c in added else first.column(c) for c in first.schema.names], names=first.schema.names)
            values = [np.asarray(batch.column(c).fill_null(0)) for c in sums]
            cuts = np.flatnonzero(np.logical_or.reduce([_changes(batch.column(c)) for c in group]))
            before = [np.empty(len(v), v.dtype) for v in values]
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                here = tuple(batch.column(c)[int(a)].as_py() for c in group)
                if here != name:
                    name, carried = here, [v.dtype.type(0) for v in values]
                for k, v in enumerate(values):
                    run_ = np.cumsum(np.concatenate([[carried[k]], v[a:b]]), dtype=v.dtype)
                    before[k][a:b] = run_[:-1]
                    carried[k] = run_[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, before)], names=[*batch.schema.names, *[f"{c}_inside" for c in sums]])
    return run


def running_totals(
    blocks: DataFrame,
    group: Sequence[str],
    order: str,
    sums: Sequence[str],
    *,
    descending: bool = False,
    bucket: Column | None = None,
    merge: bool = False,
) -> DataFrame:
    """Adds ``{name}_before`` and ``{name}_total`` to blocks of unique (group, order).

    ``{name}_before`` sums the column over the blocks that come earlier in the
    order. NULL order values come first, or last when descending. Blocks that come from
    :func:`range_buckets` keep its cuts. With ``merge`` the blocks are (group, order, sums) alone, may
    repeat a few times each, and are added up.
    """
    if bucket is None and "_bucket" not in blocks.columns and all(
            isinstance(blocks.schema[n].dataType, (T.LongType, T.DoubleType)) for n in sums):
        return _totals_in_place(blocks, group, order, sums, descending, merge)
    if bucket is None:
        b = blocks if "_bucket" in blocks.columns else range_buckets(blocks, group, order)
        if descending:
            b = b.withColumn("_bucket", -F.col("_bucket"))
    else:
        b = blocks.withColumn("_bucket", -bucket if descending else bucket)
    b = carry_in(b, group, "_bucket", {n: F.col(n) for n in sums}, totals=True)
    key = col(order).desc_nulls_last() if descending else col(order).asc_nulls_first()
    inside = (
        Window.partitionBy(*group, "_bucket")
        .orderBy(key)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return b.select(
        *[c for c in blocks.columns if c != "_bucket"],
        *[(F.col(f"{n}_carry") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before") for n in sums],
        *[f"{n}_total" for n in sums],
    )


def _totals_in_place(blocks: DataFrame, group: Sequence[str], order: str, sums: Sequence[str], descending: bool, merge: bool) -> DataFrame:
    """:func:`running_totals` of whole or double sums: a bucket's blocks are summed in order by the task that writes them.

    The totals of buckets are as many as buckets and groups; where those are few they are sent to every task, so
    blocks are dealt once.
    """
    for g in group:
        blocks = blocks.filter(col(g).isNotNull())
    key = col(order).desc_nulls_last() if descending else col(order).asc_nulls_first()
    cut = blocks.repartitionByRange(buckets_for(blocks), *[col(g) for g in group], col(order))
    cut = cut.withColumn("_bucket", F.spark_partition_id().cast("bigint")).sortWithinPartitions(*[col(g) for g in group], key)
    noted = T.StructType([*cut.schema.fields, *[T.StructField(f"{n}_inside", cut.schema[n].dataType) for n in sums]])
    cut = materialise(cut.mapInArrow(_inside(group, order, sums, merge), noted), "ordered-blocks")
    at = cut.groupBy(*group, "_bucket").agg(*[F.sum(n).alias(f"_s_{n}") for n in sums])
    at = at.withColumn("_place", -F.col("_bucket") if descending else F.col("_bucket"))
    offsets = materialise(_offsets(at, group, "_place", sums, (), True), "bucket-totals")
    offsets = offsets.withColumn("_bucket", -F.col("_place") if descending else F.col("_place")).drop("_place")
    few = offsets.count() <= SENT
    joined = cut.join(F.broadcast(offsets) if few else offsets, [*group, "_bucket"])
    return joined.select(
        *[c for c in blocks.columns],
        *[(F.col(f"{n}_carry") + F.col(f"{n}_inside")).alias(f"{n}_before") for n in sums],
        *[f"{n}_total" for n in sums],
    )


def add_up(rows: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``rows`` of keys and whole or double sums, added up where they lie: a key comes at most a few times from a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).group_by([*keys], use_threads=False).aggregate([(c, "sum") for c in sums])
            yield from pa.table({**{k: table[k] for k in keys}, **{c: table[f"{c}_sum"] for c in sums}}).to_batches()

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    rows = rows.select(*keys, *sums)
    return rows.mapInArrow(run, rows.schema)


def positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    name: str = "position",
) -> DataFrame:
    """Adds the 1-based position of each row in its group.

    ``bucket`` must not decrease along ``order``; a group is sorted bucket by bucket.
    """
    b = carry_in(df.withColumn("_bucket", bucket), group, "_bucket", {"_n": F.lit(1)})
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return b.withColumn(name, F.col("_n_carry") + F.row_number().over(inside)).drop("_bucket", "_n_carry")


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], keep_null: bool = False) -> DataFrame:
    """Columns as rows (``ids``, feature, value), NULLs left out unless asked for."""
    long = df.select(*[col(i) for i in ids], *[col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(ids), list(columns), "feature", "value"
    )
    return long if keep_null else long.filter(F.col("value").isNotNull())


def value_counts(long: DataFrame, group: Sequence[str], sums: Mapping[str, Column] | None = None) -> DataFrame:
    """One block per (group, value) with ``n`` rows and the given sums."""
    extra = [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    return long.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"), *extra)


def value_at(blocks: DataFrame, group: Sequence[str], requests: Mapping[str, Column]) -> DataFrame:
    """Values at 0-based positions: ``requests`` maps a name to a position.

    A position may use ``n_total``, the rows of the group. ``blocks`` come from
    :func:`running_totals` over ``n``; each group gives one row of named values.
    """
    n, before = F.col("n"), F.col("n_before")
    hits = {
        name: F.max(F.when((before <= at) & (at < before + n), F.col("value"))).alias(name)
        for name, at in requests.items()
    }
    return blocks.groupBy(*group).agg(
        F.max("n_total").alias("n_total"), F.count(F.lit(1)).alias("n_levels"), *hits.values()
    )


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per (by, feature).

    ``values`` holds one number per probability, over the values that are not NULL;
    ``n_levels`` counts the distinct ones. No sample and no sketch: the two values
    around each position are looked up in the running counts.
    """
    group = [*by, "feature"]
    return block_quantiles(value_counts(melt(df, by, columns), group), group, probs)


def block_quantiles(counted: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """:func:`quantiles` of rows that are summed to blocks of (group, value, n) already."""
    blocks = running_totals(counted, group, "value", ["n"])
    requests: dict[str, Column] = {}
    for i, p in enumerate(probs):
        at = (F.col("n_total") - 1) * F.lit(float(p))
        requests[f"lo{i}"], requests[f"hi{i}"] = F.floor(at), F.ceil(at)
    found = value_at(blocks, group, requests)
    interpolated = []
    for i, p in enumerate(probs):
        at = (F.col("n_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        interpolated.append(lo + (hi - lo) * (at - F.floor(at)))
    return found.select(*group, "n_total", "n_levels", F.array(*interpolated).alias("values"))


def attach_by_value(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    take: str,
    spread: Column,
    hot_share: int = 1000,
) -> DataFrame:
    """Looks up ``take`` for each row in a table of unique ``keys``.

    ``table`` carries ``n`` and ``n_total``, the rows of each key and of its group.
    Keys with at least 1/``hot_share`` of a group's rows - at most ``hot_share`` of
    them in a group - are sent to every task; the rest, each a small part of the
    rows, meet by a shuffle. Rows already served, and those with a NULL key, are spread
    over the shuffle by ``spread`` and match nothing there.
    """
    heavy = F.col("n") * F.lit(hot_share) >= F.col("n_total")
    hot = table.filter(heavy).select(*keys, F.col(take).alias("_hot"))
    cold = table.filter(~heavy).select(*keys, F.lit(0).cast("bigint").alias("_salt"), F.col(take).alias("_cold"))
    served = rows.join(F.broadcast(hot), list(keys), "left")
    waits = reduce(lambda x, y: x & y, [col(k).isNotNull() for k in keys], F.col("_hot").isNull())
    served = served.withColumn(
        "_salt",
        F.when(waits, F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64(spread), F.lit(4096)) + 1),
    )
    joined = served.join(cold, [*keys, "_salt"], "left")
    return joined.withColumn(take, F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_salt")


def hash_order(columns: Sequence[str], seed: int) -> Column:
    """A seeded shuffle order that stays the same for the same row."""
    return F.xxhash64(*[col(c) for c in columns], F.lit(seed))
