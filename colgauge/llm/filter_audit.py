"""How filters interact: what each of them does at every place of every order.

Each document has a mask of the filters it fails. What happens to it in each of the 120 orders of five
filters, step by step, follows from the mask alone, so a mask stands for one big integer whose 600 fields
of 64 bits hold a one where the document is removed, and for another one with the steps that it fails after it
has gone. Documents are counted by part, mask and labels first (a sum that combines before the shuffle, at most
128 rows a part); a part's integers are then added up, each as often as it is counted. A field never
holds more than the part's documents, which fit 63 bits, so no field runs into the next one.

Copies are found by the digest of the whole text: the smallest id of each digest is looked up by digest and
id together, so a group of copies of any size is spread over the tasks.

Defined results: a NULL text is empty, a NULL part is the empty string; a NULL id is larger than no id and smaller
than none, so such a row never fails the filter of copies, and has no labels; rows that repeat both id and text
are no copies of each other and count each; several labels of one id count if one of them is set; an
empty table has no parts and gives no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colgauge.llm.common import query, table, whole_text
from colgauge.session import materialise

FILTERS = "ABCDE"
WORDS, DISTINCT, UPPER = 200, 50, 3      # words at least; percent of them distinct at least; percent of capitals at most
COPY = "E"

_FIELD = 8      # bytes
_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
           "good_lost long, toxic_lost long, shapley long")


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions on one text alone; ``text`` is not NULL."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < WORDS,
        "B": F.size(F.array_distinct(words)) * F.lit(100) < n * F.lit(DISTINCT),
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * UPPER,
        "D": text.rlike("[#$%&*|]"),
    }


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def facts(docs: DataFrame, id_col: str, text: str, part: str) -> DataFrame:
    """(id, part, digest, mask): what each document fails on its own, and the digest of its text."""
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole_text(text).alias("text"))
    mask = sum((fails.cast("int") * bit(letter) for letter, fails in text_failures(F.col("text")).items()), F.lit(0))
    return read.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str, text: str, part: str) -> DataFrame:
    """(part, mask, good, toxic, n): the documents of each part by what they fail and how they are labelled."""
    rows = materialise(facts(docs, id_col, text, part), "filter-facts")
    known = rows.filter("id IS NOT NULL")
    flags = [F.max((F.col(c) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    marked = labels.select(F.col(id_col).alias("id"), "quality", "toxic").filter("id IS NOT NULL").groupBy("id").agg(*flags)
    first = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("_first", F.lit(1))
    copy = F.when(F.col("_first").isNull(), bit(COPY)).otherwise(0)
    flag = lambda c: F.coalesce(c, F.lit(0))
    judged = known.join(marked, "id", "left").join(first, ["digest", "id"], "left").select(
        "part", (F.col("mask") + copy).alias("mask"), flag("good").alias("good"), flag("toxic").alias("toxic"))
    # Rows without an id would all meet in one task of the joins, and find nothing there.
    rest = rows.filter("id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return judged.union(rest).groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


@lru_cache(maxsize=1)
def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


@lru_cache(maxsize=None)
def packed(mask: int) -> tuple[int, int]:
    """Two integers with a field for each step of each order: removed there, and failing there after removal."""
    removed = redundant = 0
    for o, order in enumerate(orders()):
        gone = False
        for s, letter in enumerate(order):
            if mask & bit(letter):
                field = 1 << 8 * _FIELD * (o * len(FILTERS) + s)
                if gone:
                    redundant += field
                else:
                    removed += field
                gone = True
    return removed, redundant


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum, a row for each order."""
    steps = len(orders()) * len(FILTERS)
    return np.frombuffer(total.to_bytes(steps * _FIELD, "little"), "<u8").astype(np.int64).reshape(-1, len(FILTERS))


def _audit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    sums = dict.fromkeys(("removed", "redundant", "good_lost", "toxic_lost"), 0)
    alone = dict.fromkeys(FILTERS, 0)
    everything = 0
    for row in pdf.itertuples(index=False):
        n = int(row.n)
        everything += n
        removed, redundant = packed(row.mask)
        sums["removed"] += n * removed
        sums["redundant"] += n * redundant
        sums["good_lost"] += n * row.good * removed
        sums["toxic_lost"] += n * row.toxic * removed
        for letter in FILTERS:
            alone[letter] += n * (row.mask == bit(letter))
    fields = {name: unpacked(total) for name, total in sums.items()}
    letters = np.array([list(order) for order in orders()])
    share = {letter: int(fields["removed"][letters == letter].sum()) for letter in FILTERS}
    out = {"part": key[0], "filter_order": np.repeat(orders(), len(FILTERS)), "step": np.tile(np.arange(1, len(FILTERS) + 1), len(orders()))}
    out["kept"] = (everything - fields["removed"].cumsum(1)).ravel()
    out |= {name: values.ravel() for name, values in fields.items()}
    out["unique_fails"] = [alone[x] for x in letters.ravel()]
    out["shapley"] = [share[x] for x in letters.ravel()]
    return pd.DataFrame(out)[[c.split()[0] for c in _SCHEMA.split(", ")]]


def audit(docs: DataFrame, labels: DataFrame, id_col: str, text: str, part: str) -> DataFrame:
    """One row for each part, order and step; see the columns in the module's queries."""
    return mask_counts(docs, labels, id_col, text, part).groupBy("part").applyInPandas(_audit, _SCHEMA)


OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
f AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
p AS (SELECT c.*, o, coalesce(list_min(list_transform(string_split(fails, ''), lambda z: CASE WHEN z <> '' THEN instr(o, z) END)), 9) AS pos FROM c, o),
s AS (SELECT *, substr(o, step, 1) AS letter FROM p, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, o AS filter_order, step::INT AS step, letter,
    sum(CASE WHEN pos > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN pos = step THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN pos < step AND contains(fails, letter) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN pos = step THEN n * good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN pos = step THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT * EXCLUDE (letter), sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM r"""


@query("op12_packed_filter_audit", OP12_SQL)
def op12_packed_filter_audit(spark, folder):
    """The five filters in all their orders over ``documents``, by language."""
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id", "text", "lang")
