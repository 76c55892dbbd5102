"""Near-duplicates: MinHash bands give candidates, odd sketches sift them, full sets confirm them.

1. A document's set of word shingles is hashed; equal sets become one node, so copies never
   meet each other. Each node has ``BANDS * ROWS`` MinHash samples, a key for each band, and an
   odd sketch: one parity bit is flipped for each sample, so the XOR of two sketches holds an
   odd number of samples that only one side has, and its population count estimates the
   similarity (J = 1 + n / 4k * ln(1 - 2 x / n)), the better the higher it is.
2. In each band's bucket every node has the bucket's first node as a pivot and is compared with the
   first of its pivots. Pairs whose sketches are too far apart, or whose sizes rule the threshold
   out, go; the others are confirmed on their full sets, and links are joined to components. A second
   round does the same with pivots of other components.
3. Only nodes that share a bucket and are still in different components can hold a link that was not looked
   at. Every such bucket, of two nodes or a million, is searched in the same way: its nodes are packed into blocks of
   bounded size, pairs of blocks are dealt over the tasks, and inside a task the sketches of two blocks are
   compared as matrices; the nodes that passed with a node of another component are packed again, with their sets, and
   searched block by block. Only links that join components come out, never the pairs of a group.

A pair at the threshold itself misses every band once in about two million cases, and its
sketch the margin about once in fifty thousand; everything else is exact.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text of fewer words than
a shingle is one shingle; a NULL or wordless text has the empty set and links with nothing; a
NULL id belongs to the component of an equal set, else its component is NULL; repeated
rows come back each; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colgauge.llm.common import held_by, look_up, query, table
from colgauge.llm.words import each_text, mix
from colgauge.session import discard, materialise

SHINGLE, SIMILARITY = 5, 80        # words, percent: what near-duplicates mean unless a caller says otherwise
ROWS, BANDS = 5, 36                # at 80 percent, one pair in two million shares no band
SKETCH = 512                       # bits of an odd sketch
MARGIN = 0.17                      # an estimate this far below the threshold is still confirmed on the sets
BLOCK = 1024                       # nodes of a block of sketches, about
PART = 1 << 18                     # shingles of a block of sets, about
PAIRS = 64                         # pairs that one copy of a pivot's set serves, about

_U = np.uint64
_K = ROWS * BANDS
_MULT = mix(np.arange(_K) + 1000) | _U(1)
_LONGS = SKETCH // 64


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text given as word hashes."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if len(words) < size:
            h = _U(len(words))
            for w in words:
                h = mix(h * _U(0x9E3779B97F4A7C15) + w)[()]
            return np.array([h], _U)
        n = len(words) - size + 1
        h = np.full(n, _U(size))
        for j in range(size):
            h = h * _U(0x9E3779B97F4A7C15) + words[j : j + n]
    return np.unique(mix(h))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set."""
    low = np.full(_K, ~_U(0))
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 2048):
            part = shingles[a : a + 2048]
            for i in range(_K):
                low[i] = min(low[i], (part * _MULT[i]).min())
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key for each band, the number of the band mixed in."""
    with np.errstate(over="ignore"):
        h = mix(np.arange(BANDS))
        for r in range(ROWS):
            h = mix(h * _U(0x9E3779B97F4A7C15) + low.reshape(BANDS, ROWS)[:, r])
    return h


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parity bits of the samples, as longs."""
    with np.errstate(over="ignore"):
        at = (mix(low ^ mix(np.arange(_K) + 5000)) % _U(SKETCH)).astype(np.int64)
    bits = (np.bincount(at, minlength=SKETCH) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def _node(shingles: np.ndarray) -> int:
    """One number for a set."""
    with np.errstate(over="ignore"):
        return int(mix(mix(shingles).sum(dtype=_U) ^ _U(len(shingles))).view(np.int64)[()]) if len(shingles) else 0


def _sign(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for words in each_text(b["text"].tolist()):
                s = shingle_set(words, size)
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                low = minima(s)
                sketch, bands = odd_sketch(low), band_keys(low).view(np.int64)
                rows.append((len(s), _node(s), sketch, bands, sketch.tobytes() + bands.tobytes()))
            out = pd.DataFrame(rows, columns=["n", "node", "sketch", "bands", "packed"])
            out["node"] = pd.array(out["node"], dtype="Int64")
            out.insert(0, "id", b["id"].array)
            yield out
    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(w, size) for w in each_text(b["text"].tolist())]
            yield pd.DataFrame({"node": b["node"], "of": [_node(s) for s in sets], "shingles": [s.tobytes() for s in sets]})
    return run


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["sa"], b["sb"]):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.loc[keep, ["a", "b"]]
    return run


def _column(members: list, name: str, kind) -> np.ndarray:
    return np.array([m[name] for m in members], kind)


def _packed(members: list) -> np.ndarray:
    """A row for each node: its sketch, then the keys of its bands."""
    return np.frombuffer(b"".join(m["packed"] for m in members), _U).reshape(len(members), -1)


def _passing(a: list, b: list, mine: np.ndarray, theirs: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each node of ``a`` the places of those nodes of ``b`` that may link with it and lie in another component."""
    bits = theirs[:, :_LONGS]
    n, labels, limit = _column(b, "n", np.int64), _column(b, "label", np.int64), far_apart(percent)
    for i, m in enumerate(a):
        at = np.flatnonzero((labels != m["label"]) & (np.minimum(n, m["n"]) * 100 >= np.maximum(n, m["n"]) * percent))
        if len(at):
            apart = np.bitwise_count(bits[at] ^ mine[i, :_LONGS]).sum(1, dtype=np.int64)
            yield i, at[apart <= limit]


def _sieve(percent: int):
    """The nodes of two blocks of one bucket that may link, in the first bucket that both share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                a, b = r.members, r.others if r.others is not None else r.members
                mine, theirs, found = _packed(a), _packed(b), set()
                key = np.int64(r.key).view(_U)
                for i, at in _passing(a, b, mine, theirs, percent):
                    bands = theirs[at, _LONGS:]
                    first = bands[np.arange(len(at)), (bands == mine[i, _LONGS:]).argmax(1)] == key
                    if first.any():
                        found.add(a[i]["node"])
                        found.update(b[k]["node"] for k in at[first])
                yield pd.DataFrame({"key": np.int64(r.key), "node": np.array(sorted(found), np.int64)})
    return run


def _search(percent: int):
    """Links between two blocks of one bucket, each if it joins what the links before it did not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.itertuples(index=False):
                a, b = r.members, r.others if r.others is not None else r.members
                top = {m["label"]: m["label"] for m in [*a, *b]}

                def root(x: int) -> int:
                    while top[x] != x:
                        top[x] = x = top[top[x]]
                    return x

                sets = [np.frombuffer(m["shingles"], _U) for m in b]
                for i, at in _passing(a, b, _packed(a), _packed(b), percent):
                    mine = np.frombuffer(a[i]["shingles"], _U)
                    for k in at:
                        one, two = root(a[i]["label"]), root(b[k]["label"])
                        if one == two:
                            continue
                        both = len(np.intersect1d(mine, sets[k], assume_unique=True))
                        if 100 * both >= percent * (len(mine) + len(sets[k]) - both):
                            top[one] = two
                            found.append((a[i]["node"], b[k]["node"]))
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
    return run


def _block_pairs(rows: DataFrame, weight: Column, size: int, fields: list[str], name: str) -> DataFrame:
    """(key, members, others): the rows of each key in blocks of about ``size``, and every two blocks that can hold a link.

    ``others`` is NULL where a block meets itself. A component as large as a block fills blocks of its own,
    and two blocks of one component do not meet.
    """
    sized = materialise(rows.withColumn("_weight", weight.cast("long")), f"{name}-rows")
    heavy = sized.groupBy("key", "label").agg(F.sum("_weight").alias("_held"))
    alone = F.col("_held") >= size
    rest = heavy.groupBy("key").agg(F.sum(F.when(~alone, F.col("_held"))).alias("_rest"))
    parts = F.ceil(F.when(alone, F.col("_held")).otherwise(F.col("_rest")) / F.lit(size)).cast("int")
    plan = heavy.join(rest, "key").select("key", "label", F.struct(alone.alias("alone"), parts.alias("parts")).alias("_plan"))
    planned = look_up(sized, ["key", "label"], materialise(plan, f"{name}-plan"), "_plan", "node")
    lone = F.col("_plan.alone")
    block = F.struct(lone.alias("alone"), F.when(lone, F.col("label")).otherwise(0).alias("label"), F.pmod(F.xxhash64("node"), F.col("_plan.parts")).alias("part"))
    blocks = materialise(planned.groupBy("key", block.alias("block")).agg(
        F.collect_list(F.struct(*fields)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high")), f"{name}-blocks")
    discard(sized)
    # Blocks are numbered by names alone; their rows follow when the pairs are dealt out.
    names = blocks.select("key", "block", "low", "high")
    other = names.select("key", F.col("block").alias("_other"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    mixed = (F.col("low") < F.col("high")) | (F.col("_low") < F.col("_high")) | (F.col("low") != F.col("_low"))
    pairs = names.join(other, "key").filter((F.col("block") < F.col("_other")) & mixed).select("key", "block", "_other")
    held = blocks.select("key", "block", "members")
    met = pairs.join(held, ["key", "block"]).join(
        held.select("key", F.col("block").alias("_other"), F.col("members").alias("others")), ["key", "_other"])
    own = blocks.filter("low < high").select("key", "members")
    return met.select("key", "members", "others").unionByName(own, allowMissingColumns=True)


def _searched(live: DataFrame, nodes: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links between the components that still share a bucket."""
    facts = live.select("key", "node", "label").join(nodes.select("node", "n", "packed"), "node")
    met = _block_pairs(facts, F.lit(1), BLOCK, ["node", "label", "n", "packed"], "sketch")
    passed = materialise(met.mapInPandas(_sieve(percent), "key long, node long").distinct(), "passed")
    sets = sets_of(passed.select("node"))
    rows = live.select("key", "node", "label").join(passed, ["key", "node"]).join(nodes.select("node", "n", "packed"), "node").join(sets, "node")
    met = _block_pairs(rows, F.length("shingles") / 8, PART, ["node", "label", "n", "packed", "shingles"], "set")
    return materialise(met.select("members", "others").mapInPandas(_search(percent), "a long, b long"), "links")


def far_apart(percent: int) -> int:
    """The largest XOR count that still goes on to the sets."""
    least = percent / 100 - MARGIN
    return int(np.ceil(SKETCH / 2 * (1 - np.exp(4 * _K / SKETCH * (least - 1)))))


def _may_link(percent: int) -> Column:
    """Sizes allow the threshold, and the sketches are near enough."""
    apart = F.lit(0)
    for i in range(_LONGS):
        apart = apart + F.bit_count(F.get("sketch_a", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i))))
    sizes = F.least("n_a", "n_b") * F.lit(100) >= F.greatest("n_a", "n_b") * F.lit(percent)
    return sizes & (apart <= far_apart(percent))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of an edge reaches.

    Every round each node takes the smallest label among its neighbours', then the label of its
    label; paths halve, so a few rounds do. A round is written before the next one reads it, and labels
    are looked up so that neither a pivot of many edges nor a large component is a hot key.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    degrees = materialise(held_by(both, ["b"]), "degrees")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = look_up(both, ["b"], labels.select(F.col("node").alias("b"), "label"), "label", "a", degrees)
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        # A label also offers itself to the node it names, so that trees hang on smaller roots.
        offered = near.join(labels, "node").select(F.col("label").alias("node"), "_near").groupBy("node").agg(F.min("_near").alias("_offer"))
        taken = materialise(labels.join(near, "node").join(offered, "node", "left").select(
            "node", F.least("label", "_near", F.coalesce("_offer", "label")).alias("label"), F.col("label").alias("_old")), "labels")
        after = look_up(taken, ["label"], taken.select(F.col("node").alias("label"), F.col("label").alias("_up")), "_up", "node")
        after = materialise(after.select("node", F.least("label", "_up").alias("label"), "_old"), "labels")
        discard(labels, taken)
        if not after.filter(F.col("label") != F.col("_old")).limit(1).count():
            discard(both, degrees)
            return after.select("node", "label")
        labels = after


def near_duplicates(docs: DataFrame, id_col: str, text: str, shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own included.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    signed = materialise(read.mapInPandas(_sign(shingle), "id long, n long, node long, sketch array<long>, bands array<long>, packed binary"), "signed")
    full = signed.filter(F.col("node").isNotNull())
    nodes = materialise(full.groupBy("node").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.first("packed").alias("packed"), F.min("id").alias("first_id")), "nodes")
    bands = nodes.select("node", F.explode("bands").alias("key"))
    pivots = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last").select("key", "pivot")
    # Only buckets of two nodes or more go on.
    shared = materialise(look_up(bands, ["key"], materialise(pivots, "pivots"), "pivot", "node").filter("pivot IS NOT NULL"), "shared-bands")
    facts = nodes.select("node", "n", "sketch")

    def sifted(pairs: DataFrame) -> DataFrame:
        """Of each node's pivots the first, if sizes and sketches allow a link."""
        a = facts.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
        chosen = materialise(pairs.groupBy("a").agg(F.min("b").alias("b")), "chosen")
        pivot = facts.select(F.col("node").alias("b"), F.struct("n", "sketch").alias("_pivot"))
        met = look_up(chosen, ["b"], pivot, "_pivot", "a").join(a, "a")
        met = met.withColumn("n_b", F.col("_pivot.n")).withColumn("sketch_b", F.col("_pivot.sketch"))
        return met.filter(_may_link(percent)).select("a", "b")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(node, shingles) of some nodes, from the texts again."""
        holders = nodes.join(wanted.distinct(), "node").select("node", F.col("first_id").alias("id")).filter("id IS NOT NULL")
        holders = signed.select("id", "node").join(holders, ["id", "node"]).distinct()
        sets = read.join(holders, "id").select("node", "text").mapInPandas(_sets(shingle), "node long, of long, shingles binary")
        # An id that is repeated with another text gives a set that is not its node's.
        return materialise(sets.filter("node = of").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets make a link; a pivot's set comes in as many copies as its pairs need."""
        pairs = materialise(pairs, "candidates")
        sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        copies = materialise(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(PAIRS)).cast("int").alias("copies")), "copies")
        dealt = look_up(pairs, ["b"], copies, "copies", "a").select("a", "b", F.pmod(F.xxhash64("a"), F.col("copies")).alias("copy"))
        mine = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        pivot = copies.join(sets.withColumnRenamed("node", "b"), "b").select(
            "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - F.lit(1).cast("long"))).alias("copy"), F.col("shingles").alias("sb"))
        return materialise(dealt.join(mine, "a").join(pivot, ["b", "copy"]).mapInPandas(_confirm(percent), "a long, b long"), "links")

    def live() -> DataFrame:
        """Members of buckets that still hold two components."""
        known = materialise(shared.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled-bands")
        ends = known.groupBy("key").agg(F.min("label").alias("low"), F.max(F.struct("label", "node")).alias("top")).filter(
            F.col("low") < F.col("top.label")).select("key", "top")
        return materialise(look_up(known, ["key"], materialise(ends, "live-keys"), "top", "node").filter("top IS NOT NULL"), "live-bands")

    edges = confirmed(sifted(shared.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))))
    labels = components(edges)
    other = live().filter(F.col("label") != F.col("top.label")).select(F.col("node").alias("a"), F.col("top.node").alias("b"))
    edges = edges.union(confirmed(sifted(other)))
    labels = components(edges)
    edges = edges.union(_searched(live(), nodes, sets_of, percent))
    labels = components(edges)

    named = materialise(nodes.select("node", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    first = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = look_up(named, ["label"], first, "component_id", "node").select("node", "component_id")
    classed = look_up(full.select("id", "n", "node"), ["node"], materialise(classes, "classes"), "component_id", "id")
    alone = signed.filter("node IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return classed.select("id", "n", "component_id").union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, all columns kept.

    Rows with a NULL id stay; rows that repeat an id stay or go by their id.
    """
    classes = near_duplicates(docs, id_col, text)
    gone = classes.groupBy(F.col(id_col).alias("_gone")).agg(
        F.max((F.col("component_id") == F.col(id_col)).cast("int")).alias("_stays")).filter("_stays = 0").select("_gone")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")


OP5_SQL = """WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""


@query("op5_odd_sketch_dedup", OP5_SQL)
def op5_odd_sketch_dedup(spark, folder):
    """Groups of near-duplicates on four-word shingles, as its contract has it."""
    found = near_duplicates(table(spark, folder, "documents"), "doc_id", "text", shingle=4, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
