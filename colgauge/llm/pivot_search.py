"""Exact top-k inner products through a pivot-distance index.

Largest inner product is turned into smallest distance: a vector x gets one more
component sqrt(M^2 - |x|^2), M the largest norm, and a query gets 0, so that
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Every vector is keyed by its nearest pivot and its
distance to it; vectors of one pivot lie in rings of equal width, a ring is split by id
into blocks of bounded size, and inside a block they are sorted by distance.

A query first reads blocks around its own ring, which gives its k-th best distance r. By
the triangle inequality nothing closer than r lies outside the annulus [d - r, d + r] of
any pivot at distance d: only blocks that cut one of these annuli are read, and in a
block only the slice inside it.

Defined results: vectors that are NULL, empty, or hold a NULL or a component that is not
finite take no part; a repeated id counts once, with its smallest vector; shorter
vectors count as padded with zeros; with fewer than k candidates all are returned; equal
scores go to the smaller id; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from colgauge.llm.common import query, table
from colgauge.session import materialise

PIVOTS = 24        # vectors that serve as pivots: a bounded sample, sent to every task
RINGS = 32         # rings up to the largest possible distance, 2 M
BLOCK = 2048       # vectors of a block, about
BATCH = 128        # queries of a batch, about
SLACK = 1e-6       # share of M that rounding can move a distance by, with room to spare

_BLOCK_SCHEMA = "pivot int, ring int, part int, dists binary, ids binary, matrix binary"
_BATCH_SCHEMA = "pivot int, ring int, part int, ids binary, matrix binary, floor binary"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not NULL or empty, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def _stack(vectors, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class _Space:
    """Pivots and the distances of the augmented space; small, sent with the tasks."""

    def __init__(self, pivots: np.ndarray, largest: float):
        self.largest = largest
        self.pivots = pivots
        self.height = np.sqrt(np.maximum(largest**2 - (pivots**2).sum(1), 0))
        self.width = max(2 * largest / RINGS, 1e-300)

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        height = np.sqrt(np.maximum(self.largest**2 - (x**2).sum(1), 0))
        squared = 2 * self.largest**2 - 2 * (x @ self.pivots.T) - 2 * np.outer(height, self.height)
        return np.sqrt(np.maximum(squared, 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        squared = (q**2).sum(1)[:, None] + self.largest**2 - 2 * (q @ self.pivots.T)
        return np.sqrt(np.maximum(squared, 0))

    def radius(self, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The distance of a vector whose inner product with q is ``floor``."""
        squared = (q**2).sum(1) + self.largest**2 - 2 * floor
        return np.sqrt(np.maximum(squared, 0)) + SLACK * max(self.largest, 1e-300)

    def ring(self, dist: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(dist / self.width), 0, RINGS).astype(np.int32)


def _assign(space: _Space, dim: int, of_queries: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _stack(b["vector"], dim)
            dist = space.of_queries(x) if of_queries else space.of_vectors(x)
            near = dist.argmin(1)
            d = dist[np.arange(len(x)), near]
            yield pd.DataFrame({"id": b["id"], "vector": b["vector"], "pivot": near.astype(np.int32),
                                "ring": space.ring(d), "dist": d})
    return run


def _blocks(rows: DataFrame, space: _Space, dim: int, size: int, of_queries: bool) -> DataFrame:
    """Rows packed into blocks of about ``size``: a ring of many rows is split by id."""
    keyed = rows.mapInPandas(_assign(space, dim, of_queries), "id long, vector array<double>, pivot int, ring int, dist double")
    # A batch of queries spans the rings of a pivot, as its queries read much the same blocks.
    keyed = materialise(keyed.withColumn("ring", F.lit(0)) if of_queries else keyed, "keyed-vectors")
    counts = keyed.groupBy("pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("parts"))
    split = keyed.join(counts, ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dist", "id"])
        packed = {"pivot": key[0], "ring": key[1], "part": key[2], "ids": pdf["id"].to_numpy(np.int64).tobytes(),
                  "matrix": _stack(pdf["vector"], dim).tobytes()}
        packed |= {"floor": b""} if of_queries else {"dists": pdf["dist"].to_numpy().tobytes()}
        return pd.DataFrame([packed])

    return split.groupBy("pivot", "ring", "part").applyInPandas(pack, _BATCH_SCHEMA if of_queries else _BLOCK_SCHEMA)


def _score(space: _Space, dim: int, k: int, least: np.ndarray | None = None):
    """Best k of each query in one block, of those inside its annulus and not below its floor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                q_ids, ids = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.ids, np.int64)
                q = np.frombuffer(row.q_matrix).reshape(-1, dim)
                floor = np.frombuffer(row.floor) if row.floor else np.full(len(q), -np.inf)
                dists = np.frombuffer(row.dists)
                d, r = space.of_queries(q)[:, row.pivot], space.radius(q, floor)
                i, j = np.searchsorted(dists, [(d - r).min(), (d + r).max()])
                j = np.searchsorted(dists, (d + r).max(), "right") if np.isfinite((d + r).max()) else len(ids)
                if i >= j:
                    continue
                ids, x = ids[i:j], np.frombuffer(row.matrix).reshape(-1, dim)[i:j]
                scores = q @ x.T
                scores[q_ids[:, None] == ids[None, :]] = -np.inf
                scores[scores < floor[:, None]] = -np.inf
                # The k-th best of the block bounds what can matter; all ties of it are kept for the order by id.
                if len(ids) > k:
                    kth = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                    scores[scores < kth[:, None]] = -np.inf
                qi, xi = np.nonzero(np.isfinite(scores))
                found = pd.DataFrame({"query_id": q_ids[qi], "score": scores[qi, xi], "vec_id": ids[xi]})
                found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                yield found.groupby("query_id").head(k)[["query_id", "vec_id", "score"]]
    return run


def _pairs(batches: DataFrame, needs: DataFrame, index: DataFrame) -> DataFrame:
    """One row for each batch and each block that it needs."""
    wanted = needs.join(index.select("pivot", "ring", "part"), ["pivot", "ring"])
    sides = batches.select(
        F.struct("pivot", "ring", "part").alias("batch"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), "floor")
    return wanted.join(sides, "batch").drop("batch").join(index, ["pivot", "ring", "part"])


def _needs(space: _Space, dim: int, everywhere: bool):
    """The rings of each pivot that the annuli of a batch cut; at first those around its queries alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                q = np.frombuffer(row.matrix).reshape(-1, dim)
                d = space.of_queries(q)
                if everywhere:
                    r = space.radius(q, np.frombuffer(row.floor))[:, None]
                    lo, hi = (d - r).min(0), (d + r).max(0)
                    hi = np.where(np.isfinite(hi), hi, (RINGS + 1) * space.width)
                    spans = [(p, lo[p], hi[p]) for p in range(len(lo))]
                else:
                    own = d[:, row.pivot]
                    spans = [(row.pivot, own.min() - space.width, own.max() + space.width)]
                out = []
                for p, low, high in spans:
                    first, last = space.ring(np.array([max(low, 0.0), high]))
                    out += [(row.pivot, row.ring, row.part, p, g) for g in range(first, last + 1)]
                yield pd.DataFrame(out, columns=["b0", "b1", "b2", "pivot", "ring"])
    return run


def _read_needs(batches: DataFrame, space: _Space, dim: int, everywhere: bool) -> DataFrame:
    found = batches.mapInPandas(_needs(space, dim, everywhere), "b0 int, b1 int, b2 int, pivot int, ring int")
    batch = F.struct(F.col("b0").alias("pivot"), F.col("b1").alias("ring"), F.col("b2").alias("part"))
    return found.select(batch.alias("batch"), "pivot", "ring")


def pivot_top_k(
    vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int, pivots: int = PIVOTS,
) -> DataFrame:
    """The k largest inner products of each query: (query_id, rank, vec_id, score double).

    ``is_query`` marks the queries among ``vectors``; every other vector is a candidate.
    Exact, whatever the pivots are; they only decide how much need not be read.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    ).filter(usable(F.col("vector")) & F.col("id").isNotNull())
    rows = materialise(rows.groupBy("id").agg(F.min("vector").alias("vector"), F.max("asked").alias("asked")), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    facts = rows.agg(F.max(F.size("vector")).alias("dim"), F.max(square).alias("square")).first()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vector").collect()
    dim = facts.dim or 1
    space = _Space(_stack([r.vector for r in sample], dim), float(np.sqrt(facts.square or 0.0)))
    index = materialise(_blocks(rows.select("id", "vector"), space, dim, BLOCK, False), "pivot-index")
    asked = rows.filter("asked").select("id", "vector")
    batches = materialise(_blocks(asked, space, dim, BATCH, True), "pivot-queries")
    found_schema = "query_id long, vec_id long, score double"

    # First the blocks around each query, one part of a split ring: they give a floor under its k-th best score.
    near = _pairs(batches, _read_needs(batches, space, dim, False), index.filter("part = 0"))
    first = near.mapInPandas(_score(space, dim, k), found_schema)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = first.withColumn("n", F.row_number().over(place)).filter(F.col("n") == k).select("query_id", "score")
    floors = asked.select(F.col("id").alias("query_id")).join(floors, "query_id", "left").select(
        "query_id", F.coalesce("score", F.lit(float("-inf"))).alias("floor"))
    ids = batches.select("pivot", "ring", "part", "ids").mapInPandas(_ids_of, "pivot int, ring int, part int, at int, query_id long")
    by_batch = ids.join(floors, "query_id").groupBy("pivot", "ring", "part").agg(
        F.sort_array(F.collect_list(F.struct("at", "floor"))).alias("floors"))
    floored = batches.drop("floor").join(by_batch, ["pivot", "ring", "part"]).mapInPandas(_pack_floors, _BATCH_SCHEMA)
    floored = materialise(floored, "pivot-floors")

    # Then every block that an annulus cuts.
    rest = _pairs(floored, _read_needs(floored, space, dim, True), index)
    scored = rest.mapInPandas(_score(space, dim, k), found_schema)
    ranked = scored.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ids_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for row in b.itertuples(index=False):
            ids = np.frombuffer(row.ids, np.int64)
            yield pd.DataFrame({"pivot": np.int32(row.pivot), "ring": np.int32(row.ring), "part": np.int32(row.part),
                                "at": np.arange(len(ids), dtype=np.int32), "query_id": ids})


def _pack_floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["floor"] = [np.array([f["floor"] for f in row]).tobytes() for row in b["floors"]]
        yield b[["pivot", "ring", "part", "ids", "matrix", "floor"]]


TOP = 5
OP7_SQL = f"""WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, x.vec_id AS vec_id,
       CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, x.v) DESC, x.vec_id)
QUALIFY row_number() OVER w <= {TOP}"""


@query("op7_pivot_top_k", OP7_SQL)
def op7_pivot_top_k(spark, folder):
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    # The check comes before the scaling: floor() of a NaN is a number.
    whole = F.when(usable(F.col("embedding")), scaled)
    vectors = table(spark, folder, "embeddings").select("vec_id", whole.alias("v"))
    found = pivot_top_k(vectors, "vec_id", "v", F.col("vec_id") % 50 == 0, TOP)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
