"""Log-probabilities of whole texts under a weighted backoff automaton of n-grams.

The model: p(w) = (c(w) + 1) / (N + V + 1), and for each longer context h
p(w | h) = (c(hw) + TAU p(w | h')) / (c(h) + TAU), h' being h without its first token. As an
automaton every context seen in training is a state; a seen n-gram is an arc with its
log-probability, leading to the longest seen context that it ends in; a failure arc leads to
the state of h' and costs log(TAU / (c(h) + TAU)). A text is read once from left to right: the
state is carried, arcs taken and failure arcs summed.

No task holds the whole model. Texts lie in blocks of bounded size. A block sends the hashes
of its distinct n-grams, dealt by hash, with their counts in training texts; where a hash lands all
counts of it are summed, and the sums go back to the blocks that asked. From them each block builds
the part of the automaton its own texts can reach, and runs it. Counts cover all training texts.

Defined results: a NULL text is empty; an empty text is the end token alone; without training
texts N = V = 0 and every token is unknown; a NULL id falls in fold 0; repeated rows are counted
and scored each; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from colgauge.llm.common import fold, groups_for, query, table, whole_text
from colgauge.llm.words import hash_words, mix
from colgauge.session import materialise

ORDER = 2           # the longest n-gram; more cost shuffle in proportion
TAU = 4.0           # weight of the shorter context's distribution
BLOCK = 4 << 20     # characters of a block

_U = np.uint64
_START, _END = mix(11)[()], mix(13)[()]
_G = _U(0x9E3779B97F4A7C15)


def blocks_of(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[int, pd.DataFrame]]:
    """Rows of one task in runs of at most ``size`` characters (or one longer text), numbered by task and place."""
    task = TaskContext.get().partitionId() << 24
    held, total, number = [], 0, 0
    for b in batches:
        first = 0
        for i, n in enumerate(b["text"].str.len()):
            if total and total + n > size:
                held.append(b.iloc[first:i])
                yield task + number, pd.concat(held)
                held, total, number, first = [], 0, number + 1, i
            total += n
        held.append(b.iloc[first:])
    if sum(map(len, held)):
        yield task + number, pd.concat(held)


class Grams:
    """The n-grams of a block: for each order the distinct hashes, and which of them each position holds."""

    def __init__(self, texts: list[str], order: int):
        words, ends = hash_words(texts)
        n = np.diff(ends, prepend=0)
        size = n + 2        # a start before and an end after
        self.first = np.cumsum(size) - size
        ext = np.empty(int(size.sum()), _U)
        place = np.arange(len(ext)) - np.repeat(self.first, size)
        last = np.repeat(size - 1, size)
        ext[place == 0], ext[place == last] = _START, _END
        ext[(place > 0) & (place < last)] = words
        self.size, self.place = size, place
        self.keys, self.at = [], []
        chain = ext
        with np.errstate(over="ignore"):
            for k in range(1, order + 1):
                if k > 1:
                    before = np.concatenate([[_U(0)], chain[:-1]])
                    chain = mix(before * _G + ext)
                valid = place >= max(k - 1, 1)
                # 56 bits are kept; keys are dealt by the highest of them.
                keys, inverse = np.unique(mix(chain[valid] + _U(k)) >> _U(8), return_inverse=True)
                at = np.full(len(ext), -1, np.int64)
                at[valid] = inverse
                self.keys.append(keys)
                self.at.append(at)

    def counts(self, k: int, weight: np.ndarray) -> np.ndarray:
        """How often each n-gram of order k occurs in the texts of weight 1."""
        here = self.at[k - 1] >= 0
        return np.bincount(self.at[k - 1][here], np.repeat(weight, self.size)[here], len(self.keys[k - 1])).astype(np.int64)


def _group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    return (keys >> _U(56 - (groups - 1).bit_length())).astype(np.int64) if groups > 1 else np.zeros(len(keys), np.int64)


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(blob, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i8").tobytes())


def _spread(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8")


def _ask(order: int, groups: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, rows in blocks_of(batches, BLOCK):
            grams = Grams(rows["text"].tolist(), order)
            learns = rows["learns"].to_numpy(np.float64)
            out = []
            for k in range(1, order + 1):
                keys, counts = grams.keys[k - 1], grams.counts(k, learns)
                group = _group_of(keys, groups)
                cuts = np.flatnonzero(np.diff(group, prepend=-1, append=groups + 1))
                out += [(int(group[a]), k, block, _pack(keys[a:b]), _squeeze(counts[a:b])) for a, b in zip(cuts, cuts[1:])]
            yield pd.DataFrame(out, columns=["g", "k", "block", "keys", "counts"])
    return run


def _answer(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
    """Sums of one group of hashes, sent back row by row in the order they were asked in."""
    keys = [_unpack(b) for b in asked["keys"]]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(inverse, np.concatenate([_spread(b) for b in asked["counts"]]), len(distinct)).astype(np.int64)
    back = np.split(sums[inverse], np.cumsum([len(k) for k in keys])[:-1])
    first = int(key[1]) == 1
    seen, total = (int((sums > 0).sum()), int(sums.sum())) if first else (0, 0)
    one = np.arange(len(asked)) == 0
    return pd.DataFrame({"block": asked["block"], "k": asked["k"], "g": asked["g"], "sums": [_squeeze(b) for b in back],
                         "seen": one * seen, "total": one * total})


def _bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts of a block as one compressed row."""
    for block, rows in blocks_of(batches, BLOCK):
        texts = [t.encode("utf-8", "surrogatepass") for t in rows["text"]]
        lengths = np.array([len(t) for t in texts], np.int64)
        body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        ids = rows["id"].to_numpy(dtype=np.float64, na_value=np.nan)
        yield pd.DataFrame([{"block": block, "body": body, "lengths": lengths.tobytes(), "known": (~np.isnan(ids)).tobytes(),
                             "ids": rows["id"].fillna(0).to_numpy(np.int64).tobytes(), "held": rows["held"].to_numpy(bool).tobytes()}])


class Automaton:
    """The part of the model that the texts of one block can reach."""

    def __init__(self, grams: Grams, sums: list[np.ndarray], total: int, distinct: int, tau: float):
        order = len(sums)
        self.unknown = -math.log10(total + distinct + 1)
        self.words = len(grams.keys[0])
        docs = 0 if not len(sums[0]) else int(sums[0][grams.at[0][grams.first + grams.size - 1]].max(initial=0))
        self.start = 1 if docs and order > 1 else 0       # state 1 is the start of a text, which no n-gram of order 1 counts
        self.fail, self.cost = [0, 0], [0.0, math.log10(tau / (docs + tau))]
        numbers, lower = [], None
        arcs: dict[int, tuple[float, int]] = {}
        for k in range(1, order + 1):
            count = sums[k - 1]
            # One position that holds each n-gram stands for all of them.
            where = np.flatnonzero(grams.at[k - 1] >= 0)
            spot = np.zeros(len(count), np.int64)
            spot[grams.at[k - 1][where]] = where
            word = grams.at[0][spot]
            if k == 1:
                prob = (count + 1) / (total + distinct + 1)
                context = np.zeros(len(count), np.int64)
            else:
                before = grams.at[k - 2][spot - 1]
                lone = (grams.place[spot - 1] == 0) & (k == 2)
                context = np.where(lone, self.start, numbers[k - 2][before])
                seen = np.where(lone, docs, sums[k - 2][before])
                less = lower[grams.at[k - 2][spot]]
                prob = np.where(seen > 0, (count + tau * less) / (seen + tau), less)
            state = np.zeros(len(count), np.int64)
            if k < order:
                live = count > 0
                state[live] = len(self.fail) + np.arange(int(live.sum()))
                shorter = np.zeros(len(count), np.int64) if k == 1 else numbers[k - 2][grams.at[k - 2][spot]]
                self.fail += shorter[live].tolist()
                self.cost += np.log10(tau / (count[live] + tau)).tolist()
                target = state
            else:
                target = numbers[k - 2][grams.at[k - 2][spot]] if k > 1 else state
            numbers.append(state)
            lower = prob
            live = count > 0
            arcs.update(zip((context[live] * self.words + word[live]).tolist(), zip(np.log10(prob[live]).tolist(), target[live].tolist())))
        self.arcs = arcs

    def read(self, words: list[int]) -> float:
        """One traversal from left to right."""
        arcs, fail, cost, width, state, parts = self.arcs, self.fail, self.cost, self.words, self.start, []
        for w in words:
            arc = arcs.get(state * width + w)
            while arc is None and state:
                parts.append(cost[state])
                state = fail[state]
                arc = arcs.get(state * width + w)
            if arc is None:
                parts.append(self.unknown)
            else:
                parts.append(arc[0])
                state = arc[1]
        return math.fsum(parts)


def _score(order: int, groups: int, total: int, distinct: int, tau: float):
    def run(key: tuple, texts: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        row = texts.iloc[0]
        cuts = np.cumsum(np.frombuffer(row["lengths"], np.int64))
        body = zstandard.ZstdDecompressor().decompress(row["body"])
        grams = Grams([body[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *cuts], cuts)], order)
        back = []
        for k in range(1, order + 1):
            mine = sums[sums["k"] == k].sort_values("g")
            back.append(np.concatenate([_spread(b) for b in mine["sums"]]) if len(mine) else np.zeros(0, np.int64))
            if len(back[-1]) != len(grams.keys[k - 1]):
                raise ValueError("a block was not read again as it was first read; write its table before scoring it")
        model = Automaton(grams, back, total, distinct, tau)
        at, count = grams.at[0], back[0]
        logs = np.log10((count + 1) / (total + distinct + 1))
        out = []
        for first, size in zip(grams.first, grams.size):
            words = at[first + 1 : first + size]
            out.append((size - 1, int((count[words] > 0).sum()), math.fsum(logs[words]), model.read(words.tolist())))
        done = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score"])
        ids = pd.array(np.frombuffer(row["ids"], np.int64), dtype="Int64")
        ids[~np.frombuffer(row["known"], bool)] = pd.NA
        done.insert(0, "id", ids)
        done["held"] = np.frombuffer(row["held"], bool)
        return done
    return run


def score_texts(docs: DataFrame, id_col: str, text: str, held_out: Column, order: int = ORDER, tau: float = TAU) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    Learns from the rows that are not held out. ``docs`` is read twice and must come in the same order
    each time, as a table read from files does.
    """
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text).alias("text"), held.alias("held"))
    groups = 1 << (groups_for(rows.select("text"), 4 << 20) - 1).bit_length()
    asked = rows.select("text", (~F.col("held")).cast("int").alias("learns")).mapInPandas(
        _ask(order, groups), "g int, k int, block long, keys binary, counts binary")
    answered = materialise(asked.groupBy("g", "k").applyInPandas(
        _answer, "block long, k int, g int, sums binary, seen long, total long"), "ngram-sums")
    facts = answered.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    bundles = rows.mapInPandas(_bundle, "block long, body binary, lengths binary, known binary, ids binary, held binary")
    scored = bundles.groupBy("block").cogroup(answered.select("block", "k", "g", "sums").groupBy("block")).applyInPandas(
        _score(order, groups, facts.total, facts.seen, tau),
        "id long, n_tokens long, n_known long, base_score double, score double, held boolean")
    return scored.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known",
        F.lit(facts.total).cast("long").alias("train_tokens"), "base_score", "score")


def crc32_sql(column: str) -> str:
    """crc32 of a number's text, for DuckDB, which has no such function."""
    eight = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    codes = f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: {eight}), 4294967295)"


OP2_SQL = f"""WITH d AS (
  SELECT doc_id, {crc32_sql('doc_id')} % 7 = 2 AS held_out, list_append(list_prepend('<start>', regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')), ' end') AS w
  FROM documents),
t AS (SELECT doc_id, held_out, CASE WHEN i = 1 THEN ' start' ELSE w[i] END AS u, w[i + 1] AS w
      FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
f AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v, coalesce(max(c) FILTER (w = ' end'), 0) AS docs FROM c),
h AS (SELECT w AS u, c FROM c WHERE w <> ' end' UNION ALL SELECT ' start', docs FROM f),
b AS (SELECT u, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1, 2),
p AS (SELECT t.doc_id, t.held_out, coalesce(c.c, 0) AS c, (coalesce(c.c, 0) + 1) / (f.n + f.v + 1) AS p1,
             coalesce(h.c, 0) AS hc, coalesce(b.c, 0) AS bc, f.n
      FROM t CROSS JOIN f LEFT JOIN c ON c.w = t.w LEFT JOIN h ON h.u = t.u LEFT JOIN b ON b.u = t.u AND b.w = t.w)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
       round(fsum(log10(p1)), 6) AS base_score,
       round(fsum(log10(CASE WHEN hc > 0 THEN (bc + {TAU} * p1) / (hc + {TAU}) ELSE p1 END)), 6) AS score
FROM p GROUP BY doc_id, held_out"""


@query("op2_backoff_lm", OP2_SQL)
def op2_backoff_lm(spark, folder):
    scored = score_texts(table(spark, folder, "documents"), "doc_id", "text", fold("doc_id", 7) == 2)
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})
