"""SimHash fingerprints of whole texts, and the search for all of them within a Hamming radius.

Terms are the word shingles of a text. Each is hashed to 64 bits, and every occurrence votes
with the weight of its term (the letters of the shingle, so that chains of short, frequent words
count less): +weight on the bits that are 1, -weight on those that are 0. Bit i of the
fingerprint is 1 where the votes are positive. Two counters of 32 bits ride in one long, so 32
sums serve all 64 bits, and they stay in generated code.

For the search a fingerprint is cut into ``BLOCKS`` blocks. Within radius r at most r blocks
differ, so at least BLOCKS - r agree: for each choice of BLOCKS - r blocks there is one permuted
table keyed by those blocks. Two fingerprints meet in the first table in which they agree, and
nowhere else. Equal fingerprints are counted before they meet anything.

DataFrame functions only; no Python runs on the executors.

Defined results: a NULL text is empty; an empty text has fingerprint 0; a text of fewer words than a
shingle is one term; rows stand in the order (doc_id, text), a NULL id first, and the next
document is the next row, that of the last row being the first; a table of one row is its own
next; repeated rows are fingerprinted each; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colgauge.llm.common import query, table, whole_text
from colgauge.session import materialise

SHINGLE = 2
RADIUS = 3
BLOCKS = 6
WIDTH = 256        # rows of a bucket in document order, about
_PAIR = 0x100000001


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return F.filter(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " ", -1), lambda w: w != "")


def terms(w: str, shingle: int = SHINGLE) -> Column:
    """The shingles of a column of words, one for each occurrence.

    ``w`` is a column made before: inside a lambda an expression would be computed anew for each element.
    """
    n = F.size(w)
    joined = F.col(w)
    for j in range(1, shingle):
        rest = F.greatest(n - j, F.lit(0))
        joined = F.zip_with(F.slice(joined, F.lit(1), rest), F.slice(F.col(w), F.lit(j + 1), rest), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n >= shingle, joined).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def _votes() -> list[Column]:
    """Sums of the weights on bit i (low half) and bit i + 32 (high half), for i from 0 to 31."""
    return [
        F.sum(F.shiftrightunsigned(F.col("_h"), i).bitwiseAND(F.lit(_PAIR)) * F.col("_w")).alias(f"_v{i}") for i in range(32)
    ]


def _fingerprint() -> Column:
    """The bits whose votes hold more than half of all weight."""
    bits = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"_v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"_v{i}"), 32)
        for at, count in ((i, low), (i + 32, high)):
            value = 1 << at if at < 63 else -(1 << 63)
            bits = bits.bitwiseOR(F.when(count * 2 > F.col("_total"), F.lit(value)).otherwise(F.lit(0)).cast("long"))
    return bits


def fingerprints(docs: DataFrame, keys: list[str], text: str, name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """(keys, name): the fingerprint of each row, ``keys`` being unique.

    The terms of a row are summed where the row is, before anything is shuffled.
    """
    split = docs.select(*keys, words(F.col(text)).alias("_words"))
    exploded = split.select(*keys, F.explode_outer(terms("_words", shingle)).alias("_t"))
    hashed = exploded.select(
        *keys, F.coalesce(F.xxhash64("_t"), F.lit(0)).alias("_h"),
        F.when(F.col("_t").isNull(), 0).otherwise(F.least(F.length("_t"), F.lit(64))).cast("long").alias("_w"))
    voted = hashed.groupBy(*keys).agg(*_votes(), F.sum("_w").alias("_total"))
    return voted.select(*keys, F.when(F.col("_total") > 0, _fingerprint()).otherwise(F.lit(0)).cast("long").alias(name))


def likeness(a: str | Column, b: str | Column) -> Column:
    """The share of equal bits."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _blocks(count: int) -> list[int]:
    """Masks of ``count`` blocks of the 64 bits, as even as can be."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def within_radius(asked: DataFrame, known: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (asked, known, distance) of distinct fingerprints within the radius.

    Both inputs hold one long column ``fingerprint`` without repetition. Table t is keyed by the
    bits of its blocks; a pair is given by the first table that brings it together.
    """
    tables = [_signed(sum(c)) for c in combinations(_blocks(blocks), blocks - radius)]
    masks = F.array(*[F.lit(m).cast("long") for m in tables])

    def permuted(df: DataFrame, name: str) -> DataFrame:
        at = df.select(F.col("fingerprint").alias(name), F.posexplode(masks).alias("table", "_mask"))
        return at.select(name, "table", F.col(name).bitwiseAND(F.col("_mask")).alias("block"))

    a, b = permuted(asked, "asked"), permuted(known, "known")
    differ = F.col("asked").bitwiseXOR(F.col("known"))
    earlier = F.lit(len(tables))
    for t in reversed(range(len(tables))):
        earlier = F.when(differ.bitwiseAND(F.lit(tables[t]).cast("long")) == 0, F.lit(t)).otherwise(earlier)
    return a.join(b, ["table", "block"]).filter((F.bit_count(differ) <= radius) & (earlier == F.col("table"))).select(
        "asked", "known", F.bit_count(differ).alias("distance"))


def neighbours(prints: DataFrame, asked: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fingerprint, n_near): rows within the radius of each asked fingerprint, the row itself left out."""
    known = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("_n"), F.max(asked).alias("_asked"))
    pairs = within_radius(known.filter("_asked").select("fingerprint"), known.select("fingerprint"), radius, blocks)
    sizes = known.select(F.col("fingerprint").alias("known"), "_n")
    return pairs.join(sizes, "known").groupBy(F.col("asked").alias("fingerprint")).agg((F.sum("_n") - 1).alias("n_near"))


def with_next(docs: DataFrame, id_col: str, carried: dict[str, Column], order: list[str], width: int = WIDTH) -> DataFrame:
    """Adds, for each name of ``carried``, its value in the next row by (id, order), the first row's after the last.

    Ids are cut into buckets of about ``width`` rows by their range, and a row meets its next
    one in a window over its bucket; only the last row of a bucket looks at the first row of the
    next bucket, found in the same way among the buckets, level by level, so no task ever
    orders more than a bucket.
    """
    rows = docs.withColumn("_at", F.col(id_col).cast("long"))
    facts = rows.agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi, n = facts.lo or 0, facts.hi or 0, max(facts.n, 1)
    step = max(1, -(-(hi - lo + 1) * width // n))
    bucket = F.coalesce(F.floor((F.col("_at").cast("decimal(38,0)") - F.lit(lo)) / F.lit(step)) + 1, F.lit(0)).cast("long")
    rows = rows.withColumn("_bucket", bucket).withColumn("_next", F.struct(*[c.alias(k) for k, c in carried.items()]))
    found = _next_of(rows, ["_at", *order], (hi - lo) // step + 2, width)
    return found.select(*docs.columns, "_bucket", *[F.col(f"_after.{k}").alias(f"next_{k}") for k in carried])


def _next_of(rows: DataFrame, order: list[str], buckets: int, width: int = WIDTH) -> DataFrame:
    """Adds ``_after``, the ``_next`` of the row that follows in (_bucket, order); the first one's after the very last."""
    led, heads = _led(rows, order)
    first = heads.orderBy("_bucket").limit(1).select(F.col("_next").alias("_first"))
    return _over_edges(led, heads, buckets, width).join(F.broadcast(first), how="left").withColumn(
        "_after", F.coalesce("_after", "_first")).drop("_first")  # one row


def _led(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with what follows in their bucket, and the first row of each bucket."""
    inside = Window.partitionBy("_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    led = rows.withColumns({"_after": F.lead("_next").over(inside), "_place": F.row_number().over(inside)})
    return led.drop("_place"), materialise(led.filter(F.col("_place") == 1).select("_bucket", "_next"), "heads")


def _over_edges(led: DataFrame, heads: DataFrame, buckets: int, width: int) -> DataFrame:
    """Fills ``_after`` of the last row of each bucket with the first row of the next bucket, level by level."""
    if buckets <= 1:
        return led
    upper = heads.select(F.col("_bucket").alias("_head"), F.floor(F.col("_bucket") / F.lit(width)).alias("_bucket"), "_next")
    upper_led, upper_heads = _led(upper, ["_head"])
    filled = _over_edges(upper_led, upper_heads, -(-buckets // width) if buckets > width else 1, width)
    return led.join(filled.select(F.col("_head").alias("_bucket"), F.col("_after").alias("_over")), "_bucket", "left").withColumn(
        "_after", F.coalesce("_after", "_over")).drop("_over")


def edited_prints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how alike they and the next one's are.

    The edited text has the last quarter of the code points replaced by the first as many (or
    all) of the next document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    rows = with_next(rows, "doc_id", {"text": F.col("text")}, ["text"])
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut)))
    # A number for repeated rows makes each row a key of its own; the bucket comes first, so rows stay where they are.
    copy = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text"))
    keys = ["_bucket", "_row", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.withColumns({"_row": copy, "edited_sha256": F.sha2(F.col("edited"), 256)})
    both = rows.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("of")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("of")),
    )).alias("_x")).select(*keys, "_x.which", "_x.of")
    prints = fingerprints(both, [*keys, "which"], "of")
    side = lambda k: F.max(F.when(F.col("which") == k, F.col("fingerprint")))
    wide = prints.groupBy(*keys).agg(side(0).alias("fingerprint"), side(1).alias("edited_fingerprint"))
    wide = materialise(wide, "fingerprints")
    last = wide.agg(F.max("_bucket")).first()[0] or 0
    nexts = _next_of(wide.withColumn("_next", F.struct("fingerprint")), ["_row"], last + 2)
    return nexts.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "_after.fingerprint").alias("near_next"))


@query("op9_simhash")
def op9_simhash(spark, folder):
    """Fingerprints of ``documents``; for every 50th id also how many other rows lie within the radius."""
    prints = materialise(edited_prints(table(spark, folder, "documents")), "prints")
    asked = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    near = neighbours(prints, asked)
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return prints.join(near, "fingerprint", "left").select(
        "doc_id", "n_chars", "edited_sha256", hexed("fingerprint").alias("fingerprint"),
        hexed("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next",
        F.when(asked, F.col("n_near")).alias("n_near"))
