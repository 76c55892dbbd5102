"""Token counts of whole texts: byte-pair merges applied to all pre-tokens of a batch at once.

A batch of texts lies in one array of code points. The borders between pre-tokens follow from each
character's class and that of its neighbours, so they are found without a loop over characters. The
different pre-tokens of the batch are held as one ragged array of symbols with the rank of each adjacent
pair beside it. A round takes every sequence's lowest rank, merges all pairs of that rank in it (of
overlapping ones the first, the third and so on) and ranks only the new pairs; sequences without a pair
that merges leave the array, and what is left of each is its count. Merging all pairs of the lowest rank
at once is the same as merging one after the other, as no merge makes a pair of a lower rank than its
own; that is checked when a vocabulary is read.

A text longer than ``PIECE`` characters is cut before white space that follows something else, where a
pre-token always ends, so memory is bounded by ``PIECE`` and by the longest stretch without white space.

Defined results: a NULL or empty text has no tokens; strings of special tokens inside a text are one
token each; nothing is put before or behind a text; repeated rows are counted each, all columns of the
table are kept (one named as the count is replaced); an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from colgauge.llm.common import query, table, whole_text
from colgauge.llm.words import mix

VOCABULARY = "byte_bpe_50k.json"    # a parameter: a name of the tokenizers' folder or a path
LIMIT = 512                         # tokens above which a text is over the limit
PIECE = 1 << 20                     # characters held in one array, about

_U = np.uint64
_NEVER = np.int64(1 << 40)          # the rank of a pair that never merges
_OTHER, _LETTER, _NUMBER, _BLANK, _BORDER = range(5)
_CUT = re.compile(r"(?<=\S)[ \n]")
# What may follow an apostrophe as a pre-token of its own.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _class_runs() -> tuple[tuple[int, int, int], ...]:
    """(first, end, class) of each run of letters, numbers or white space, as the tokenizers' library has them."""
    from tokenizers import Regex, pre_tokenizers

    def runs(pattern: str, text: str) -> list[tuple[str, tuple[int, int]]]:
        return pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text)

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    kinds = ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_BLANK, r"\s"))
    found = runs("|".join(p + "+" for _, p in kinds), "".join(map(chr, points)))
    heads = "".join(piece[0] for piece, _ in found)
    kind = {head: k for k, pattern in kinds for head, _ in runs(pattern, heads)}
    return tuple((points[a], points[b - 1] + 1, kind[piece[0]]) for piece, (a, b) in found)


class Merges:
    """A byte-level vocabulary as arrays: what each pair of symbols merges to, and when. Under 2 MB, sent with the tasks."""

    def __init__(self, spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        if not plain or before.get("add_prefix_space") or spec.get("normalizer") or model.get("dropout"):
            raise ValueError("only byte-level BPE without normalizer, prefix space or dropout is read")
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        rank = {pair: r for r, pair in enumerate(pairs)}
        made: dict[str, int] = {}
        for (a, b), r in rank.items():
            made[a + b] = min(r, made.get(a + b, r))
        if any(r <= made.get(side, -1) for pair, r in rank.items() for side in pair):
            raise ValueError("a merge comes before one that makes its parts")
        self.size = max(vocab.values()) + 1
        ids = np.array([(vocab[a] * self.size + vocab[b], r, vocab[a + b]) for (a, b), r in rank.items()], np.int64).reshape(-1, 3)
        ids = ids[np.argsort(ids[:, 0])]
        self.keys = ids[:, 0]
        self.ranks = np.append(ids[:, 1], _NEVER)
        self.result = np.zeros(len(pairs), np.int64)
        self.result[ids[:, 1]] = ids[:, 2]
        # Bytes that print stand for themselves, the others for the characters from 256 on.
        shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
        hidden = iter(range(256, 512))
        self.bytes = np.array([vocab[chr(b) if b in shown else chr(next(hidden))] for b in range(256)], np.int64)
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        if any(t.get(x) for t in spec.get("added_tokens", []) for x in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their neighbours are not read")
        self.runs = _class_runs()

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Merges:
        """Reads a file; done by the driver alone."""
        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def classes(self) -> np.ndarray:
        """The class of each code point."""
        out = np.full(0x110000, _OTHER, np.uint8)
        for first, end, kind in self.runs:
            out[first:end] = kind
        return out

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.size + right
        if not len(self.keys):
            return np.full(len(pair), _NEVER)
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], _NEVER)


def pre_token_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, as a mask over code points; borders between texts start one of their own.

    Letters, numbers and other characters go in runs, a single space goes with the run behind it, white space
    before other characters leaves its last character out, and a contraction is split from its word.
    """
    n = len(points)
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    blank = kind == _BLANK
    inner_end = np.flatnonzero(blank[:-1] & ~blank[1:] & (kind[1:] != _BORDER))
    start[inner_end] = True
    behind_space = inner_end[points[inner_end] == 0x20] + 1
    start[behind_space] = False
    # An apostrophe that starts a pre-token, with letters behind it.
    quote = np.flatnonzero(start[:-1] & (points == 0x27))
    at = lambda k: points[np.minimum(quote + k, n - 1)] * (quote + k < n)
    for letters in _CONTRACTIONS:
        hit = quote[np.logical_and.reduce([at(k + 1) == ord(c) for k, c in enumerate(letters)])]
        start[hit + 1] = False
        start[hit + 1 + len(letters)] = True
    return start[:n]


def merged_lengths(merges: Merges, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many symbols are left of each sequence (none is empty) when no pair merges any more."""
    out = lengths.copy()
    seq = np.repeat(np.arange(len(lengths)), lengths)

    def ranked(at: np.ndarray) -> np.ndarray:
        inside = (at >= 0) & (at < len(symbols) - 1)
        at = np.where(inside, at, 0)
        inside &= seq[at] == seq[np.minimum(at + 1, len(seq) - 1)]
        r = np.full(len(at), _NEVER)
        r[inside] = merges.rank_of(symbols[at[inside]], symbols[at[inside] + 1])
        return r

    rank = ranked(np.arange(len(symbols)))
    while len(symbols):
        first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        low = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.append(first, len(seq)))
        done = low == _NEVER
        if done.any():
            out[seq[first[done]]] = sizes[done]
            stays = np.repeat(~done, sizes)
            symbols, seq, rank = symbols[stays], seq[stays], rank[stays]
            low, sizes = low[~done], sizes[~done]
            if not len(symbols):
                break
        hits = np.flatnonzero(rank == np.repeat(low, sizes))
        follows = np.concatenate([[False], np.diff(hits) == 1])
        if follows.any():
            # x x x x: pairs that overlap; the odd ones of a run give way.
            order = np.arange(len(hits))
            hits = hits[(order - np.maximum.accumulate(np.where(follows, 0, order))) % 2 == 0]
        symbols[hits] = merges.result[rank[hits]]
        keep = np.ones(len(symbols), bool)
        keep[hits + 1] = False
        symbols, seq, rank = symbols[keep], seq[keep], rank[keep]
        new = hits - np.arange(len(hits))
        rank[new] = ranked(new)
        before = new[new > 0] - 1
        rank[before] = ranked(before)
    return out


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each sequence, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _different(data: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different sequence of bytes, and for every sequence which of them it is."""
    with np.errstate(over="ignore"):
        place = np.arange(len(data)) - np.repeat(first, lengths)
        values = mix(data.astype(_U) + _U(256) * place.astype(_U))
        sums = mix(np.add.reduceat(values, first) + lengths.astype(_U))
    _, one, which = np.unique(sums, return_index=True, return_inverse=True)
    # Equal hashes are equal bytes, or else nothing is taken together.
    same = lengths == lengths[one[which]]
    if same.all() and (data == data[_ragged(first[one[which]], lengths)]).all():
        return one, which
    return np.arange(len(first)), np.arange(len(first))


def count_pieces(merges: Merges, classes: np.ndarray, pieces: list[str]) -> np.ndarray:
    """Tokens of each piece of text, none of them empty or holding a special string."""
    joined = "\n".join(pieces) + "\n"
    data = np.frombuffer(joined.encode("utf-8"), np.uint8)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    kind = classes[points]
    kind[ends] = _BORDER
    starts = np.flatnonzero(pre_token_starts(points, kind))
    # From code points to bytes.
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    byte_at = np.concatenate([[0], np.cumsum(width)])
    first = byte_at[starts]
    lengths = np.diff(np.append(first, len(data)))
    one, which = _different(data, first, lengths)
    sequences = _ragged(first[one], lengths[one])
    counts = merged_lengths(merges, merges.bytes[data[sequences]], lengths[one])[which]
    counts[kind[starts] == _BORDER] = 0
    total = np.concatenate([[0], np.cumsum(counts)])
    upto = total[np.searchsorted(starts, ends, "right")]
    return np.diff(np.concatenate([[0], upto]))


def _cut(text: str) -> Iterator[str]:
    """A text in pieces of about ``PIECE`` characters, cut where a pre-token always ends."""
    at = 0
    while len(text) - at > PIECE:
        found = _CUT.search(text, at + PIECE)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def count_texts(merges: Merges, classes: np.ndarray, texts: list[str]) -> np.ndarray:
    """Tokens of each text."""
    counts = np.zeros(len(texts), np.int64)
    special = re.compile("|".join(map(re.escape, merges.special))) if merges.special else None
    pieces: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if pieces:
            np.add.at(counts, owner, count_pieces(merges, classes, pieces))
        pieces.clear()
        owner.clear()
        held = 0

    for i, text in enumerate(texts):
        parts = [text]
        if special is not None and special.search(text):
            parts = special.split(text)
            counts[i] += len(parts) - 1
        for part in parts:
            for piece in _cut(part):
                if piece:
                    pieces.append(piece)
                    owner.append(i)
                    held += len(piece) + 1
                    if held > PIECE:
                        flush()
    flush()
    return counts


def count_tokens(docs: DataFrame, text: str, name: str, merges: Merges) -> DataFrame:
    """``docs`` with the tokens of each text in the column ``name``."""

    @pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classes = merges.classes()
        for batch in batches:
            yield pd.Series(count_texts(merges, classes, batch.tolist()))

    return docs.withColumn(name, counted(whole_text(text)))


@query("op11_rank_merge_counts")
def op11_rank_merge_counts(spark, folder):
    """Bytes and tokens of every document, and whether there are more than ``LIMIT`` tokens."""
    docs = table(spark, folder, "documents").select("doc_id", whole_text("text").alias("text"))
    counted = count_tokens(docs, "text", "n_tokens", Merges.load())
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
