"""Vector codes: parts of integer vectors as the index of the nearest entry of a codebook.

A vector is cut into equal parts, each with a codebook of its own that is refined by rounds of exact integer
means. The nearest entry is found by slices and masks: along each dimension the entries' coordinates are sorted,
and for each place in that order a uint64 mask holds the entries before it. The distance to a first entry, the
nearest along one of the dimensions of widest spread, is the initial radius; in each dimension the coordinates within it are a
slice of the order, so two prefix masks give the entries inside, and the AND over all dimensions leaves the only
entries that can be as near. Those alone are measured, in whole numbers.

Each round reads the table once, sums inside the task, and brings back one sum for each component of the codebooks,
whatever the number of vectors; the table itself is never copied. Give a table on disk, or one that was written.

Defined results: vectors that are NULL, or hold a NULL or a component that is not finite, are dropped; scaled
components beyond a long count as the largest or smallest long; shorter vectors, empty ones included, count as padded
with zeros to the longest, and that one to a multiple of the parts; codebooks start from the first rows by (id,
vector), NULL ids last, and are shorter if there are fewer rows; rows that repeat an id are coded each; an error
that does not fit a long is NULL; an empty table gives no rows. Other columns are kept, those named as a new one replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from colgauge.llm.common import query, table
from colgauge.operators.order import attach_by_value
from colgauge.session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SEEDS = 2               # dimensions whose nearest entry is tried for the initial radius
BATCH = 1 << 14         # vectors measured at once

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_HALF = 31              # sums are carried as two halves, so that no task's sum runs over


def whole_and_finite(vector: Column) -> Column:
    """Whether a vector is not NULL and holds only finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def scaled(vectors, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component as int64, padded to ``width``."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        out = np.floor(out * scale)
    whole = np.clip(out, -(2.0**62), 2.0**62).astype(np.int64)
    whole[out > 2.0**62] = [min(int(x), _HIGH) if np.isfinite(x) else _HIGH for x in out[out > 2.0**62]]
    whole[out < -(2.0**62)] = [max(int(x), _LOW) if np.isfinite(x) else _LOW for x in out[out < -(2.0**62)]]
    return whole


class Slices:
    """The entries of one codebook (at most 64), sorted along each dimension with masks of the entries before each place."""

    def __init__(self, entries: np.ndarray):
        if len(entries) > 64:
            raise ValueError("a mask holds 64 entries")
        self.entries = entries
        order = [np.argsort(column, kind="stable") for column in entries.T]
        self.order = order
        self.sorted = [column[o] for column, o in zip(entries.T, order)]
        bits = np.uint64(1) << np.arange(len(entries), dtype=np.uint64)
        self.before = [np.concatenate([np.zeros(1, np.uint64), np.bitwise_or.accumulate(bits[o])]) for o in order]
        spread = [int(c[-1]) - int(c[0]) for c in self.sorted]
        self.widest = sorted(range(len(spread)), key=lambda d: -spread[d])[:SEEDS]

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A whole number no smaller than the distance to some entry."""
        best = None
        for d in self.widest:
            known = self.sorted[d]
            at = np.searchsorted(known, x[:, d])
            left, right = np.maximum(at - 1, 0), np.minimum(at, len(known) - 1)
            side = np.where(np.abs(x[:, d] - known[left]) <= np.abs(known[right] - x[:, d]), left, right)
            far = ((x - self.entries[self.order[d][side]]) ** 2).sum(1)
            best = far if best is None else np.minimum(best, far)
        if best is None:
            return np.zeros(len(x), np.int64)
        if best.dtype == object:
            return np.array([math.isqrt(int(b)) + 1 for b in best], object)
        return np.sqrt(best.astype(float)).astype(np.int64) + 1

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Masks of the entries that can be the nearest ones."""
        r = self.radius(x)
        masks = np.full(len(x), ~np.uint64(0))
        for d, (known, before) in enumerate(zip(self.sorted, self.before)):
            low, high = np.searchsorted(known, x[:, d] - r, "left"), np.searchsorted(known, x[:, d] + r, "right")
            masks &= before[high] ^ before[low]
        return masks if len(self.sorted) else np.full(len(x), (np.uint64(1) << np.uint64(len(self.entries) - 1)) * np.uint64(2) - np.uint64(1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, the lower index if two are as near, and the squared distance."""
        masks = self.candidates(x)
        index = np.full(len(x), -1, np.int64)
        best = np.zeros(len(x), x.dtype)
        for j, entry in enumerate(self.entries):
            rows = np.flatnonzero(masks & (np.uint64(1) << np.uint64(j)))
            far = ((x[rows] - entry) ** 2).sum(1) if x.shape[1] else np.zeros(len(rows), x.dtype)
            nearer = (index[rows] < 0) | (far < best[rows])
            index[rows[nearer]], best[rows[nearer]] = j, far[nearer]
        return index, best


def nearest_entries(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) indexes and squared distances; ``x`` is (rows, parts, size), ``books`` (parts, entries, size)."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0)), int(books.max(initial=0)), -int(books.min(initial=0)))
    if 4 * largest * largest * max(x.shape[1] * x.shape[2], 1) > _HIGH:
        # Beyond a long the same steps run on Python's whole numbers.
        x, books = x.astype(object), books.astype(object)
    index = np.zeros(x.shape[:2], np.int64)
    far = np.zeros(x.shape[:2], x.dtype)
    for p, book in enumerate(books):
        index[:, p], far[:, p] = Slices(book).nearest(x[:, p])
    return index, far


def _sums(books: np.ndarray, scale: int):
    """Sums and counts of the parts that fall to each entry, as (slot, high half, low half), once for each task."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        high, low = np.zeros((2, parts, entries, size + 1), np.int64)
        for b in batches:
            for a in range(0, len(b), BATCH):
                x = scaled(b["vector"].iloc[a : a + BATCH].tolist(), parts * size, scale).reshape(-1, parts, size)
                index, _ = nearest_entries(x, books)
                with_count = np.concatenate([x, np.ones((*x.shape[:2], 1), np.int64)], 2)
                for p in range(parts):
                    np.add.at(high[p], index[:, p], with_count[:, p] >> _HALF)
                    np.add.at(low[p], index[:, p], with_count[:, p] & ((1 << _HALF) - 1))
        yield pd.DataFrame({"slot": np.arange(high.size, dtype=np.int32), "high": high.ravel(), "low": low.ravel()})
    return run


def fit(vectors: DataFrame, id_col: str, vector_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Codebooks (parts, entries, size) of whole numbers, or None if no vector takes part."""
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(whole_and_finite(F.col("vector")))
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    size = -(-longest // parts)
    # As many rows as a codebook has entries.
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    books = scaled([r.vector for r in first], parts * size, scale).reshape(-1, parts, size).transpose(1, 0, 2)
    for _ in range(rounds):
        summed = kept.select("vector").mapInPandas(_sums(books, scale), "slot int, high long, low long")
        wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
        # One row for each component of the codebooks and one for each entry's count.
        found = {r.slot: (int(r.high) << _HALF) + int(r.low) for r in summed.groupBy("slot").agg(*wide).collect()}
        totals = np.array([found[slot] for slot in range(len(found))], object).reshape(*books.shape[:2], size + 1)
        count = totals[:, :, size:]
        means = np.where(count > 0, totals[:, :, :size] // np.maximum(count, 1), books.astype(object))
        books = means.astype(np.int64)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vector_col: str, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """The rows whose vector takes part, with ``code`` (two hex digits a part) and ``error`` (squared distance)."""
    parts, _, size = books.shape

    @pandas_udf("code string, error long")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            codes, errors = [], []
            for a in range(0, len(series), BATCH):
                index, far = nearest_entries(scaled(series.iloc[a : a + BATCH].tolist(), parts * size, scale).reshape(-1, parts, size), books)
                codes += [row.astype(np.uint8).tobytes().hex() for row in index]
                errors += [int(e) if e <= _HIGH else None for e in far.sum(1)]
            yield pd.DataFrame({"code": codes, "error": pd.array(errors, dtype="Int64")})

    kept = vectors.filter(whole_and_finite(F.col(vector_col))).withColumn("_coded", coded(F.col(vector_col)))
    return kept.withColumn("code", F.col("_coded.code")).withColumn("error", F.col("_coded.error")).drop("_coded")


def with_group_error(coded: DataFrame, label: str) -> DataFrame:
    """Adds ``label_error``, the errors summed over equal labels, NULLs together.

    Labels that hold a thousandth of the rows, so at most a thousand, are sent to every task; the others meet by a shuffle.
    """
    keyed = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")))
    keyed = materialise(keyed, "vector-codes")
    sums = keyed.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    known = sums.select("_label", "n", F.lit(keyed.count()).alias("n_total"), F.col("_sum").try_cast("long").alias("label_error"))
    return attach_by_value(keyed, known, ["_label"], "label_error", F.col("code")).drop("_label")


def _oracle() -> str:
    """The rounds written out one after the other."""
    far = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))"
    steps = [
        f"""v0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS c
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""v AS MATERIALIZED (
  SELECT r, p, c[p * len(c) // {PARTS} + 1 : (p + 1) * len(c) // {PARTS}] AS x FROM v0, (SELECT unnest(range({PARTS})) AS p))""",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM v WHERE r <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT v.r, v.p, min([{far}, b.e]) AS best FROM v JOIN b{k} b USING (p) GROUP BY v.r, v.p)")
        if k < ROUNDS:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM (
      SELECT p, best[2] AS e, i, sum(x[i]) AS s, count(*) AS n
      FROM v JOIN a{k} USING (r, p), (SELECT unnest(range(1, (SELECT max(len(x)) FROM v) + 1)) AS i) GROUP BY ALL) GROUP BY p, e) m USING (p, e))""")
    steps.append(f"""f AS (
  SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a{ROUNDS} GROUP BY r)""")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM f JOIN v0 USING (r), h"""


@query("op13_slice_mask_codes", _oracle())
def op13_slice_mask_codes(spark, folder):
    """Codes and errors of all ``embeddings``, errors by label, and the digest of the codebooks."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    books = fit(vectors, "vec_id", "embedding")
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = compress(vectors, "embedding", books).select("vec_id", "label", "code", "error")
    return with_group_error(coded, "label").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
