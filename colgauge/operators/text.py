"""Word-based closeness of texts: tf-idf cosine, novelty, normalised copies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from colgauge.functions.scalars import col
from colgauge.operators.order import attach_by_value, running_totals
from colgauge.session import materialise

# The words that carry no meaning of their own.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it its of on or that the "
    "their them they this to was were which with what how when why who whose per vs over "
    "under into than then there these those each every any all one two our your not "
    "customer customers account accounts feature features measure measures"
).split()
REPEAT_FROM = 0.6
PASSAGES = 1000     # passages whose words are sent to every task at once
BLOCK = 4_000_000   # words of a block of bags; a task holds two
BLOCKS = 8          # of bags, at least
BUCKETS = 512       # of words in a bag's print
PAIRS = 1 << 20     # that a task holds at once
SLICE = 1 << 12     # bags or pairs whose prints are unpacked at once
SLACK = 1e-4        # of bounds, as they are taken in single precision


def words(text: str | Column) -> Column:
    """Content words: lower case, three letters or more, stop words out, a plural's s cut."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    kept = F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
    plural = lambda w: (F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss")
    return F.transform(kept, lambda w: F.when(plural(w), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def _inverse(n: Column, df: Column) -> Column:
    return F.ln((1 + n) / (1 + df)) + 1


def word_counts(items: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, word, tf)."""
    return items.select(col(id_col).alias("id"), F.explode(words(text)).alias("word")).groupBy("id", "word").agg(
        F.count(F.lit(1)).alias("tf")
    )


def text_similarity(others: DataFrame, id_col: str, text: str, query: str) -> DataFrame:
    """How close one text is to each of the others, 0 to 1: (id, similarity) for every one of them.

    Words are weighted by their rarity over the query and the others together.
    """
    spark = others.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(words("q").alias("w")).first().w
    counts = {w: float(asked.count(w)) for w in sorted(set(asked))}
    n = others.agg(F.count(F.lit(1)) + 1).scalar()
    tf = materialise(word_counts(others, id_col, text), "words")
    in_query = F.col("word").isin(*counts) if counts else F.lit(False)
    freq = materialise(tf.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "frequencies")
    total = freq.agg(F.sum("n")).scalar()
    table = freq.withColumns({
        "n_total": total,
        "idf": _inverse(n.cast("double"), F.col("n") + in_query.cast("int")),
    })
    weighted = attach_by_value(tf, table, ["word"], "idf", F.col("id"))
    w = F.col("tf") * F.col("idf")
    if counts:
        asked_tf = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(v))])[F.col("word")]
    else:
        asked_tf = F.lit(0.0)
    dots = weighted.groupBy("id").agg(
        F.sum(w * F.coalesce(asked_tf, F.lit(0.0)) * F.col("idf")).alias("_dot"), F.sum(w * w).alias("_sq")
    )
    seen = spark.createDataFrame([(k, v) for k, v in counts.items()] or [("", 0.0)], "word string, tf double")
    own = seen.join(freq, "word", "left").withColumn("_w", F.col("tf") * _inverse(n.cast("double"), F.coalesce("n", F.lit(0)) + 1))
    norm = own.agg(F.sum(F.col("_w") * F.col("_w"))).scalar()
    scored = others.select(col(id_col).alias("id")).join(dots, "id", "left")
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(F.try_divide(F.col("_dot"), F.sqrt(F.col("_sq") * norm)), F.lit(0.0)).alias("similarity"),
    )


def nearest_text(others: DataFrame, id_col: str, text: str, query: str) -> DataFrame:
    """One row: the text closest to the query."""
    best = F.max(F.struct(F.col("similarity"), (-col(id_col)).alias("_first")))
    return text_similarity(others, id_col, text, query).agg(best.alias("_b")).select(
        (-F.col("_b._first")).alias(id_col), F.col("_b.similarity").alias("similarity")
    )


def nearest_passages(
    others: DataFrame, id_col: str, text: str, passages: DataFrame, passage_id: str, passage_text: str, each: int = PASSAGES
) -> DataFrame:
    """The closest of all passages to each text: (id, passage id, similarity) for every text; ids are unique.

    Words are weighted by their rarity over the texts and the passages together. The words of a text are dealt by its
    id once; the words of the passages come to them in blocks of about ``each`` passages.
    Of passages equally close, to six places, the first counts; a text that shares no word with any has none, and similarity 0.
    """
    asked = materialise(word_counts(passages, passage_id, passage_text), "words")
    split = others.select(col(id_col).alias("id"), words(text).alias("_words"))
    n = others.count() + (n_passages := passages.count())
    seen = split.select(F.explode(F.array_distinct("_words")).alias("word")).unionByName(asked.select("word"))
    freq = materialise(seen.groupBy("word").agg(_inverse(F.lit(float(n)), F.count(F.lit(1))).alias("idf")), "frequencies")
    weighed = asked.join(freq, "word").select(F.col("id").alias("passage"), "word", "idf", (F.col("tf") * F.col("idf")).alias("v"))
    lengths = weighed.groupBy("passage").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    weighed = materialise(weighed.join(lengths, "passage").select("passage", "word", "idf", (F.col("v") / F.col("length")).alias("v")), "passages")
    tf = split.repartition("id").select("id", F.explode("_words").alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf"))
    blocks, best, lengths_of = max(1, -(-n_passages // each)), None, None
    for k in range(blocks):
        block = weighed.filter(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == k)
        # Bounded by the passages of a block, so texts stay where they are.
        holders = F.broadcast(block.groupBy("word").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("passage", "v")).alias("in")))
        weight = tf.join(holders, "word").select("id", (F.col("tf") * F.col("idf")).alias("w"), "in")
        if lengths_of is None:      # only words of no passage of the first block are dealt by word
            rest = tf.join(holders.select("word"), "word", "left_anti").join(freq, "word").select("id", (F.col("tf") * F.col("idf")).alias("w"))
            squares = [x.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("sq")) for x in (weight, rest)]
            lengths_of = squares[0].unionByName(squares[1]).groupBy("id").agg(F.sqrt(F.sum("sq")).alias("length"))
            lengths_of = materialise(lengths_of, "lengths")
        pairs = weight.select("id", "w", F.explode("in").alias("x")).groupBy("id", "x.passage").agg(F.sum(F.col("w") * F.col("x.v")).alias("dot"))
        texts = pairs.groupBy("id").agg(F.collect_list(F.struct("passage", "dot")).alias("near")).join(lengths_of, "id")
        close = F.transform("near", lambda x: F.struct((-F.round(x["dot"] / F.col("length"), 6)).alias("far"), x["passage"].alias("passage")))
        top = texts.select("id", F.array_min(close).alias("near")).select("id", (-F.col("near.far")).alias("similarity"), "near.passage").filter("similarity IS NOT NULL")
        best = top if best is None else best.unionByName(top)
    if blocks > 1:
        best = best.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "passage")).alias("near")).select("id", (-F.col("near.far")).alias("similarity"), "near.passage")
    return others.select(col(id_col).alias("id")).join(best, "id", "left").select(
        F.col("id").alias(id_col), F.col("passage").alias(passage_id), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def _vectors(words: DataFrame, times: DataFrame, n: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(bag, first_at, last_at, length, words) of bags that share a word with another, and what a word's rarity follows from.

    Words are numbered from the rarest on and stand as often as the bag has them, those of one bag alone left out; ``length`` is
    of the whole bag. Words from a number on weigh as much as given beside it, of which there are few: no more than the root of twice the words.
    """
    freq = materialise(words.groupBy("word").agg(F.sum("copies").alias("df"), F.count(F.lit(1)).alias("n")), "frequencies")
    shared = freq.filter("n > 1")
    steps = shared.groupBy("df").agg(F.count(F.lit(1)).alias("n")).select("df", "n", _inverse(F.lit(float(n)), F.col("df")).alias("idf")).orderBy("df").collect()
    starts = np.cumsum([0, *[r.n for r in steps]])[:-1]
    start = freq.sparkSession.createDataFrame([(r.df, int(x)) for r, x in zip(steps, starts)], "df long, start long")
    numbered = running_totals(shared.select("df", "word", F.lit(1).cast("bigint").alias("k")), ["df"], "word", ["k"])
    numbered = numbered.join(F.broadcast(start), "df").select("word", (F.col("start") + F.col("k_before")).cast("int").alias("number"))
    table = freq.join(numbered, "word", "left").select(
        "word", "n", freq.agg(F.sum("n")).scalar().alias("n_total"), F.struct("df", "number").alias("_code"))
    coded = attach_by_value(words, table, ["word"], "_code", F.col("bag")).select("bag", "tf", "_code.*")
    weight = F.col("tf") * _inverse(F.lit(float(n)), F.col("df"))
    numbers = F.collect_list(F.when(F.col("number").isNotNull(), F.array_repeat("number", F.col("tf").cast("int"))))
    vectors = coded.repartition("bag").groupBy("bag").agg(
        F.sqrt(F.sum(weight * weight)).alias("length"), F.array_sort(F.flatten(numbers)).alias("words")).filter(F.size("words") > 0)
    return materialise(vectors.join(times, "bag").select("bag", "first_at", "last_at", "length", "words"), "vectors"), starts, np.array([r.idf for r in steps])


@dataclass
class _Block:
    """The bags of a block as rows (owner, word, weight) by owner and from the rarest word on; a bag's rows begin at ``bounds``.

    ``left`` is the length of a row's more frequent words, ``first`` the rows under which a bag is looked up.
    """

    n: int
    owner: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    bounds: np.ndarray
    left: np.ndarray
    first: np.ndarray
    step: np.ndarray
    prints: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, starts: np.ndarray, idf: np.ndarray, threshold: float) -> _Block:
        held = rows["words"].combine_chunks()
        every, n = held.flatten().to_numpy(zero_copy_only=False), len(held)
        sizes = pc.list_value_length(held).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        at = np.flatnonzero(np.r_[True, (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])][: len(every)]).astype(np.int32)
        times, word, owner = np.diff(at, append=np.int32(len(every))), every[at], owner[at]
        bounds, length = np.searchsorted(owner, np.arange(n + 1, dtype=np.int32)), rows["length"].to_numpy()
        weight, left, first = np.zeros(len(word)), np.zeros(len(word), np.float32), []
        step, prints = np.zeros(n, np.float32), np.zeros((n, BUCKETS), np.uint8)
        for k in range(0, n, SLICE):    # so that what is made on the way is small beside the block
            m = min(n, k + SLICE)
            part, begins = slice(bounds[k], bounds[m]), bounds[k: m + 1] - bounds[k]
            mine = owner[part] - k
            weight[part] = times[part] * idf[np.searchsorted(starts, word[part], side="right") - 1] / length[k:m][mine]
            square = weight[part] * weight[part]
            total = np.r_[0.0, np.cumsum(square)]
            after = np.maximum(0.0, total[begins[1:]][mine] - total[1:])
            left[part] = np.sqrt(after)
            first.append((np.flatnonzero(after + square >= threshold * threshold - SLACK) + bounds[k]).astype(np.int32))
            cells = np.bincount(mine * BUCKETS + word[part] % BUCKETS, square, (m - k) * BUCKETS).reshape(-1, BUCKETS)
            step[k:m] = np.sqrt(cells.max(1)) / 255
            prints[k:m] = np.minimum(255, np.ceil(np.sqrt(cells) / step[k:m, None]))
        return cls(n, owner, word, weight, bounds, left, np.concatenate(first), step, prints)


def _met(a: _Block, b: _Block, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of bags whose overlap can reach the threshold, and few others, each once; of one block, the smaller first.

    Under the rarest word a pair shares, its overlap is no larger than the product of the word's own weights and that of the
    lengths of what is left; the product of two prints is never below that of the bags.
    """
    place = b.first[np.argsort(b.word[b.first], kind="stable")]
    words, weight, left, owner = b.word[place], b.weight[place].astype(np.float32), b.left[place], b.owner[place]
    asked = a.word[a.first]
    low = np.searchsorted(words, asked)
    many = np.searchsorted(words, asked, side="right") - low
    ends = np.r_[0, np.cumsum(many)]
    edge = np.searchsorted(a.owner[a.first], np.arange(a.n + 1))    # a bag's rows stay together, so a pair comes once
    k = 0
    while k < a.n:
        m = max(k + 1, int(np.searchsorted(ends[edge], ends[edge[k]] + PAIRS, side="right")) - 1)
        rows = np.arange(edge[k], edge[m])
        row = np.repeat(rows, many[rows])
        to = np.arange(len(row)) + np.repeat(low[rows] - (ends[rows] - ends[edge[k]]), many[rows])
        mine = a.first[row]
        keep = a.weight[mine].astype(np.float32) * weight[to] + a.left[mine] * left[to] >= threshold - SLACK
        if same:
            keep &= a.owner[mine] < owner[to]
        pairs = np.unique(a.owner[mine[keep]].astype(np.int64) * b.n + owner[to[keep]])
        for at in range(0, len(pairs), SLICE):
            x, y = np.divmod(pairs[at: at + SLICE], b.n)
            bound = np.einsum("ij,ij->i", a.prints[x].astype(np.float32), b.prints[y].astype(np.float32)) * a.step[x] * b.step[y]
            yield x[bound >= threshold - SLACK], y[bound >= threshold - SLACK]
        k = m


def _overlaps(a: _Block, b: _Block, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The scalar product of each pair of bags."""
    def rows(block: _Block, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = block.bounds[bags + 1] - block.bounds[bags]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(block.bounds[bags] - (ends - sizes), sizes)
        return at, np.repeat(np.arange(len(bags), dtype=np.int64), sizes) << 32 | block.word[at]

    (p, left), (q, right) = rows(a, x), rows(b, y)
    both, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    return np.bincount(both >> 32, a.weight[p[i]] * b.weight[q[j]], len(x))


def _records(later: np.ndarray, first: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Which rows have a larger overlap than all of the same ``later`` that come first."""
    order = np.lexsort((-overlap, first, later))
    levels, level = np.unique(overlap[order], return_inverse=True)
    height = later[order].astype(np.int64) * len(levels) + level
    return order[height > np.r_[-1, np.maximum.accumulate(height)][:-1]]


def _candidates(words: DataFrame, times: DataFrame, threshold: float, n: int | None = None) -> DataFrame:
    """(earlier, later, overlap) of bags: for each every earlier one that reaches the threshold and is closer than all before that one.

    ``words`` has a row for each word of a bag, with ``tf`` and the bag's ``copies`` where those are not 1; ``n`` counts
    the texts. An item of a bag repeats the closest bag that began before the item, the first of equally close ones, so no other pair can
    be asked for. Bags are dealt to blocks of about ``BLOCK`` words, and each two blocks are compared by one task, which
    keeps no pairs but these: what is written and held does not follow the number of pairs.
    """
    one = F.lit(1).cast("bigint")
    words = words.select("bag", "word", *[(F.col(c) if c in words.columns else one).alias(c) for c in ("tf", "copies")])
    vectors, starts, idf = _vectors(words, times, times.count() if n is None else n)
    blocks = max(BLOCKS, -(-(vectors.agg(F.sum(F.size("words"))).first()[0] or 0) // BLOCK))

    def compare(rows: pa.Table) -> pa.Table:
        at = rows["block"].to_numpy()
        sides = [rows.filter(pa.array(at == k)) for k in np.unique(at)]
        found, held = [], 0
        if rows["cell"][0].as_py() % (blocks + 1) == 0 or len(sides) == 2:
            both = pa.concat_tables(sides).drop_columns(["words"])
            a, *other = [_Block.of(side, starts, idf, threshold) for side in sides]
            b = other[0] if other else a
            first, last = both["first_at"].to_numpy(), both["last_at"].to_numpy()
            for x, y in _met(a, b, not other, threshold):
                if not len(x):
                    continue
                overlap = _overlaps(a, b, x, y)
                close = overlap >= threshold
                x, y, overlap = x[close], y[close] + (a.n if other else 0), overlap[close]
                for e, l in ((x, y), (y, x)):
                    before = first[e] < last[l]
                    found.append((e[before], l[before], overlap[before]))
                    held += int(before.sum())
                if held > PAIRS:
                    e, l, o = map(np.concatenate, zip(*found))
                    keep = _records(l, first[e], o)
                    found, held = [(e[keep], l[keep], o[keep])], 0
        e, l, o = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(e):
            keep = _records(l, first[e], o)
            e, l, o, bags = e[keep], l[keep], o[keep], both["bag"]
        else:
            bags = rows["bag"]
        return pa.table({"earlier": bags.take(pa.array(e)), "later": bags.take(pa.array(l)), "overlap": pa.array(o)})

    kind = T.StructType([T.StructField(c, words.schema["bag"].dataType) for c in ("earlier", "later")] + [T.StructField("overlap", T.DoubleType())])
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("bag"), F.lit(blocks)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cell = F.least("block", "_other") * blocks + F.greatest("block", "_other")
    cells = dealt.withColumn("cell", cell.cast("int")).drop("_other").repartition(blocks * (blocks + 1), "cell")
    return materialise(cells.groupBy("cell").applyInArrow(compare, kind), "pairs")


def novelty(
    items: DataFrame, id_col: str, run: str, round_col: str, text: str, threshold: float = REPEAT_FROM
) -> DataFrame:
    """Which items repeat one of an earlier round: (id, run, round, overlap, repeats, repeated).

    Texts of the same words are one bag, so copies are compared once. A pair can
    only reach the threshold if both hold one of the other's rarest words: each bag
    is looked up under its rarest words alone, up to where the words left over are
    too light to reach it, and a pair is looked at in full only if bounds on what both have in common
    allow it. No pair that an item could repeat is lost; ``overlap`` is NULL
    when no earlier item reaches it. ``repeated`` is the id of the item that is repeated: the one
    of largest overlap (to nine places), of these the first by run and round, then by id. Rarity is taken over all items.
    """
    placed = items.select(col(run).alias("run"), col(round_col).alias("round"), col(id_col).alias("id"), col(text).alias("_text"))
    placed = placed.repartitionByRange("run", "round", "id").sortWithinPartitions("run", "round", "id")
    bagged = placed.select(
        F.monotonically_increasing_id().alias("place"), "id", F.struct("run", "round").alias("at"), F.array_sort(words("_text")).alias("_words"),
    ).withColumn("bag", F.unhex(F.sha2(F.concat_ws(" ", "_words"), 256)))
    bagged = materialise(bagged, "bagged")
    # The place of a bag's first item is its number.
    bags = materialise(bagged.groupBy("bag").agg(
        F.count(F.lit(1)).alias("copies"), F.min("place").alias("first_at"), F.max("place").alias("last_at"),
        F.min(F.struct("at", "id")).alias("first"), F.max(F.size("_words")).alias("size"),
    ), "bags")
    tf = bagged.groupBy("bag").agg(
        F.count(F.lit(1)).alias("copies"), F.min("place").alias("number"), F.any_value("_words").alias("_words")
    ).select("bag", "number", "copies", F.explode("_words").alias("word")).groupBy("bag", "number", "copies", "word").agg(
        F.count(F.lit(1)).alias("tf")
    ).select(F.col("number").alias("bag"), "copies", "word", "tf")
    numbers = bags.select(F.col("first_at").alias("bag"), "first_at", "last_at")
    close = _candidates(materialise(tf, "words"), numbers, threshold, bagged.count())
    partners = close.join(bags.select(F.col("first_at").alias("earlier"), F.col("first").alias("_first")), "earlier").join(
        bags.select(F.col("first_at").alias("later"), "bag"), "later").select("bag", "overlap", "_first")
    itself = bags.filter((F.col("size") > 0) & (F.col("copies") > 1)).select("bag", F.lit(1.0).alias("overlap"), F.col("first").alias("_first"))
    best = F.min(F.struct((-F.round("overlap", 9)).alias("far"), F.col("_first"), F.col("overlap")))
    hits = (
        bagged.select("id", "at", "bag").join(partners.unionByName(itself), "bag")
        .filter(F.col("_first.at") < F.col("at")).groupBy("id").agg(best.alias("_best"))
        .select("id", F.col("_best.overlap").alias("overlap"), F.col("_best._first.id").alias("repeated"))
    )
    return bagged.select("id", "at").join(hits, "id", "left").select(
        F.col("id").alias(id_col), F.col("at.run").alias("run"), F.col("at.round").alias("round"), "overlap",
        F.col("overlap").isNotNull().alias("repeats"), "repeated",
    )


def normalised(text: str | Column) -> Column:
    """A text without case, punctuation or layout."""
    plain = F.regexp_replace(F.lower(col(text)), r"[!-/:-@\[-`{-~]+", " ")
    return F.trim(F.regexp_replace(plain, r"[ \t\r\n]+", " "))


def normalised_duplicates(items: DataFrame, id_col: str, text: str) -> DataFrame:
    """Groups of texts equal once normalised: (fingerprint, first_id, copies), only real groups.

    A group reduces to its size and first id wherever its rows are, however many it has.
    """
    return (
        items.groupBy(F.sha2(normalised(text), 256).alias("fingerprint"))
        .agg(F.min(col(id_col)).alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )
