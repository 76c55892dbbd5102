"""SentencePiece encoding and decoding of whole texts by a max-plus scan over a piece lattice.

A node of the lattice is a piece that ends at a place of the text; an arc joins a piece to one that
starts where it ends. The file's model is a merge (BPE) model: an arc weighs 0 where the merges leave
the border between its two pieces standing and minus infinity where a merge would cross it, so exactly
one path has weight 0, and it is the encoding. Whether a border stands depends on the two pieces alone.

Between two characters that stand beside each other in no piece - before a space, around an unknown
character, mostly before punctuation - there is a sure cut: a single boundary state. Between sure cuts a stretch of text is
scanned once and remembered. Giant documents are split into chunks, at a sure cut where one lies
near, else anywhere: then the boundary states are the pieces that end just before the cut, and a chunk
gives a transfer matrix from the states before it to those behind it (0 or minus infinity, kept as bits).
Matrices are combined associatively, forwards and backwards, which tells the states on the path at
every cut; each chunk is then traced back on its own, wherever it lies.

Defined results: a NULL or empty text has no ids and decodes to an empty text; characters in no piece
become their bytes; U+2581 decodes as a space; repeated rows are encoded each; other columns are kept;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from colgauge.llm.common import query, table, whole_text
from colgauge.session import materialise

MODEL = "/opt/tokenizers/piece_bpe_32k.model"      # a parameter; read by the driver alone
CHUNK = 1 << 16         # characters of a chunk of a giant document
BATCH = 1_000           # documents that a worker holds at once
REMEMBER = 120_000      # stretches remembered before the older half is let go
BORDERS = 300_000       # pairs of pieces whose border is remembered
STARTS = 60_000         # beginnings whose pieces are remembered

SPACE = "▁"
_NONE = -1              # the state at a sure cut
_UNKNOWN = -2           # a character in no piece


class Pieces:
    """The pieces of a model, how each is merged, and which borders stand. About 2 MB, sent with the tasks."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.ids = {p: i for i, p in enumerate(pieces) if p}
        order = sorted(self.ids.values(), key=lambda i: -scores[i])
        self.rank = {i: k for k, i in enumerate(order)}
        self.longest = max(map(len, self.ids), default=1)
        # Single characters come before all merges.
        self.made = {i: -1 if len(pieces[i]) == 1 else self.rank[i] for i in order}
        self.parts: dict[int, tuple[int, int]] = {}
        for i in sorted(self.ids.values(), key=lambda i: len(pieces[i])):
            if len(pieces[i]) > 1:
                self._learn_parts(i)
        for i in [i for p, i in self.ids.items() if len(p) > 1 and i not in self.parts]:
            del self.ids[pieces[i]]         # the merges never end in this piece
        self.ends: dict[str, int] = {}      # last two characters -> longest piece that ends in them
        for p in self.ids:
            self.ends[p[-2:]] = max(self.ends.get(p[-2:], 1), len(p))
        # First four characters -> the lengths of longer pieces that begin so; the pairs of characters inside pieces.
        self.longer: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 4:
                self.longer.setdefault(p[:4], set()).add(len(p))
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.known = set(self.ids) & set("".join(self.ids))
        self.spelled = [p.encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            self.spelled[i] = bytes([b])
        self._stands: dict[int, bool] = {}
        self._chains: tuple[dict, dict] = ({}, {})
        self._starts: dict[str, tuple[tuple[int, int | None], ...]] = {}
        self._seen: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another character")
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if "\n" not in self.known else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        return cls([sp.id_to_piece(i) if plain[i] else "" for i in range(n)], [sp.get_score(i) for i in range(n)],
                   [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def __getstate__(self):
        return self.__dict__ | {"_stands": {}, "_chains": ({}, {}), "_starts": {}, "_seen": {}, "_older": {}}

    def _learn_parts(self, i: int) -> None:
        piece, parts, last = self.pieces[i], list(self.pieces[i]), None
        while len(parts) > 1:
            options = [(self.rank[self.ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ids]
            if not options:
                return
            _, k = min(options)
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert parts == [piece] and last
        if all(p in self.ids for p in last):
            self.parts[i] = (self.ids[last[0]], self.ids[last[1]])

    def stands(self, a: int, b: int) -> bool:
        """Whether the border between pieces a and b survives the merges."""
        if a < 0 or b < 0:
            return True
        key = a << 20 | b
        found = self._stands.get(key)
        if found is None:
            if len(self._stands) >= BORDERS:
                self._stands.clear()
            found = self._stands[key] = self._border(a, b)
        return found

    def _chain(self, i: int, side: int) -> list[tuple[str, float, float]]:
        """The parts that touch the border while a piece is built: (part, made at, gone at); found once for each piece."""
        out = self._chains[side].get(i)
        if out is None:
            out, at, gone = [], i, float("inf")
            while True:
                if self.made[at] < gone:
                    out.append((self.pieces[at], self.made[at], gone))
                if at not in self.parts:
                    break
                gone, at = self.made[at], self.parts[at][side]
            self._chains[side][i] = out
        return out

    def _border(self, a: int, b: int) -> bool:
        right, ids = self._chain(b, 0), self.ids.get
        for x, made_x, gone_x in self._chain(a, 1):
            for y, made_y, gone_y in right:
                if made_x >= gone_y or made_y >= gone_x:
                    continue        # they never stand side by side
                both = ids(x + y)
                # Of equal merges the left one comes first.
                if both is not None and self.rank[both] < gone_x and self.rank[both] <= gone_y:
                    return False
        return True

    def ending(self, text: str, j: int) -> Iterator[tuple[int, int]]:
        """Pieces that end at j: (start, piece), the longest first; a character in no piece stands alone."""
        c = text[j - 1]
        if c not in self.known:
            yield j - 1, _UNKNOWN
            return
        for i in range(max(0, j - self.ends.get(text[max(j - 2, 0) : j], 1)), j):
            piece = self.ids.get(text[i:j])
            if piece is not None:
                yield i, piece

    def starting(self, start: str) -> tuple[tuple[int, int | None], ...]:
        """Lengths and ids of the pieces that begin as the four characters ``start``, the longest first; None where more decide."""
        found = [(k, None) for k in sorted(self.longer.get(start, ()), reverse=True)]
        found += [(k, self.ids[start[:k]]) for k in range(len(start), 0, -1) if start[:k] in self.ids]
        if len(self._starts) >= STARTS:
            self._starts.clear()
        self._starts[start] = tuple(found)
        return self._starts[start]

    def stretch_ids(self, text: str) -> tuple[int, ...]:
        """The ids of a text between two sure cuts: the one path through its lattice whose weight is 0.

        Followed from piece to piece, the longest first. Only one path of weight 0 leads to a place, so a
        place from which it cannot go on is given up for good, and no place is left twice.
        """
        ids, starts, borders = self.ids.get, self._starts.get, self._stands.get
        whole = ids(text)
        if whole is not None:
            return (whole,)
        n, at, path, lost = len(text), 0, [], set()
        before, most = _NONE, n
        while at < n:
            start = text[at : at + 4]
            for size, piece in starts(start) or self.starting(start):
                if size > most or lost and at + size in lost:
                    continue
                if piece is None:
                    piece = ids(text[at : at + size])
                    if piece is None:
                        continue
                if before < 0:
                    break
                stands = borders(before << 20 | piece)
                if self.stands(before, piece) if stands is None else stands:
                    break
            else:
                lost.add(at)
                size = len(self.pieces[path.pop()])
                at -= size
                before, most = path[-1] if path else _NONE, size - 1
                continue
            path.append(piece)
            at += size
            before, most = piece, n - at
        return tuple(path)

    def pieces_of(self, text: str) -> tuple[int, ...]:
        """The ids of a stretch, cut further wherever no piece holds the two characters beside each other."""
        inner = self.inner
        cuts = [k for k, pair in enumerate(map(add, text, text[1:]), 1) if pair not in inner]
        if not cuts and len(text) > 1:
            return self.stretch_ids(text)
        out: list[int] = []
        for first, end in zip([0, *cuts], [*cuts, len(text)]):
            part = text[first:end]
            if part in self.ids:
                out.append(self.ids[part])
            elif len(part) == 1:
                out.extend(self.byte_ids[b] for b in part.encode("utf-8", "replace"))
            else:
                out += self.remembered(part, self.stretch_ids)
        return tuple(out)

    def remembered(self, text: str, find) -> tuple[int, ...]:
        """What ``find`` says of a text; short texts are found once while they are in use."""
        ids = self._seen.get(text)
        if ids is None:
            ids = self._older.get(text) or find(text)
            if len(text) <= 64:
                if len(self._seen) >= REMEMBER:
                    self._older, self._seen = self._seen, {}
                self._seen[text] = ids
        return ids

    def spell(self, text: str, path) -> tuple[int, ...]:
        out: list[int] = []
        for i, j, piece in path:
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.byte_ids[b] for b in text[i:j].encode("utf-8", "replace"))
        return tuple(out)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as the model normalises it: spaces are pieces, one is put before."""
        return self.encode_marked(SPACE + text.replace(" ", SPACE)) if text else np.zeros(0, np.int32)

    def encode_marked(self, marked: str) -> np.ndarray:
        out: list[int] = []
        for s in self.stretch.findall(marked):
            out += self._seen.get(s) or self.remembered(s, self.pieces_of)
        return np.array(out, np.int32)

    def decode(self, ids) -> str:
        """The text of ids: pieces, bytes where there are bytes, without the space put before."""
        text = b"".join(map(self.spelled.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")
        return text.replace(SPACE, " ").removeprefix(" ")

    # Chunks of giant documents.

    def sure(self, marked: str, at: int) -> bool:
        """Whether a sure cut lies before place ``at``."""
        return marked[at - 1 : at + 1] not in self.inner

    def split(self, marked: str, size: int) -> list[tuple[int, int]]:
        """Chunks of about ``size`` characters, ending at a sure cut where one lies within another ``size``."""
        cuts = [0]
        while len(marked) - cuts[-1] > size:
            at = cuts[-1] + size
            near = next((k for k in range(at, min(at + size, len(marked))) if self.sure(marked, k)), at)
            cuts.append(near)
        return list(zip(cuts, [*cuts[1:], len(marked)]))

    def boundary(self, text: str, at: int, is_sure: bool) -> list[tuple[int, int]]:
        """The states at a cut: (end, piece) of the pieces that end in the last places before it."""
        if at == 0 or is_sure:
            return [(at, _NONE)]
        return [(j, piece) for j in range(max(1, at - self.longest + 1), at + 1) for _, piece in self.ending(text, j)]

    def scan(self, text: str, first: int, states: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
        """Every node that ends after ``first``: (end, piece) -> (start, the states that reach it, as bits)."""
        reached: dict[int, list[tuple[int, int]]] = {}
        for k, (j, piece) in enumerate(states):
            reached.setdefault(j, []).append((piece, 1 << k))
        nodes: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(first + 1, len(text) + 1):
            here = []
            for i, piece in self.ending(text, j):
                bits = 0
                for before, b in reached.get(i, ()):
                    if self.stands(before, piece):
                        bits |= b
                if bits:
                    nodes[j, piece] = (i, bits)
                    here.append((piece, bits))
            if here:
                reached[j] = reached.get(j, []) + here
        return nodes

    def trace(self, text: str, first: int, entries, enter: int, nodes, exits, leave: int, sure_b: bool) -> tuple[int, ...]:
        """Back from the last piece on the path to the entry state: the pieces that end in this chunk."""
        alive = {n: start for n, (start, bits) in nodes.items() if bits & enter}
        by_end: dict[int, list[int]] = {}
        for j, piece in alive:
            by_end.setdefault(j, []).append(piece)
        if sure_b:
            j, piece = len(text), by_end[len(text)][0]
        else:
            j, piece = max(s for k, (s, _) in enumerate(exits) if leave >> k & 1)
        at_entry = {e for k, e in enumerate(entries) if enter >> k & 1}
        path = []
        while j > first:
            i = alive[j, piece]
            path.append((i, j, piece))
            if i <= first:
                break
            piece = next(p for p in by_end[i] if self.stands(p, piece))
            j = i
        assert path == [] or path[-1][0] > first or any(e[0] == path[-1][0] for e in at_entry)
        return self.spell(text, reversed(path))


def combine(left: list[int], right: list[int]) -> list[int]:
    """The product of two transfer matrices, given as the bits of the entry states of each exit state."""
    out = []
    for bits in right:
        total = 0
        for k, row in enumerate(left):
            if bits >> k & 1:
                total |= row
        out.append(total)
    return out


def _window(pieces: Pieces, marked: str, a: int, b: int) -> tuple[int, str]:
    """A chunk with as much text before it as its boundary states need."""
    low = max(0, a - 2 * pieces.longest)
    return a - low, marked[low:b]


def _cut(pieces: Pieces, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                marked = SPACE + text.replace(" ", SPACE)
                spans, out = pieces.split(marked, size), []
                for k, (a, b) in enumerate(spans):
                    offset, window = _window(pieces, marked, a, b)
                    out.append((key, k, offset, window, a == 0 or pieces.sure(marked, a), b == len(marked) or pieces.sure(marked, b)))
                yield pd.DataFrame(out, columns=["key", "k", "offset", "window", "sure_a", "sure_b"])
    return run


def _exits(pieces: Pieces, window: str, sure: bool, nodes: dict, entries: list[tuple[int, int]], offset: int) -> list[tuple[tuple[int, int], int]]:
    """The states behind a chunk, each with the entry states that reach it, as bits."""
    if sure:        # any piece that ends at the cut
        bits = 0
        for (j, _), (_, b) in nodes.items():
            bits |= b if j == len(window) else 0
        return [((len(window), _NONE), bits)]
    own = {e: 1 << k for k, e in enumerate(entries)}
    return [(s, own.get(s, 0) if s[0] <= offset else nodes.get(s, (0, 0))[1]) for s in pieces.boundary(window, len(window), False)]


def _transfer(pieces: Pieces):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.sure_a and r.sure_b:       # one state before, one behind
                    rows.append([(1).to_bytes(1, "little")])
                    continue
                entries = pieces.boundary(r.window, r.offset, r.sure_a)
                nodes = pieces.scan(r.window, r.offset, entries)
                exits = _exits(pieces, r.window, r.sure_b, nodes, entries, r.offset)
                rows.append([bits.to_bytes(len(entries) // 8 + 1, "little") for _, bits in exits])
            yield pd.DataFrame({"key": batch["key"], "k": batch["k"], "matrix": rows})
    return run


def _states_on_path(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk the entry and exit states on the path, from prefix and suffix products of the matrices."""
    pdf = pdf.sort_values("k")
    matrices = [[int.from_bytes(b, "little") for b in m] for m in pdf["matrix"]]
    ahead = list(accumulate(matrices, combine, initial=[1]))
    live = [[k for k, bits in enumerate(m) if bits & 1] for m in ahead]
    # Backwards: the entry states of each chunk that lead to the end.
    back, needed = [0] * len(matrices) + [1], 1
    for n in reversed(range(len(matrices))):
        needed = _reach_back(matrices[n], needed)
        back[n] = needed
    on = [sum(1 << k for k in ks if back[n] >> k & 1) for n, ks in enumerate(live)]
    enc = lambda x: x.to_bytes((x.bit_length() + 7) // 8 or 1, "little")
    return pd.DataFrame({"key": pdf["key"], "k": pdf["k"], "enter": [enc(x) for x in on[:-1]], "leave": [enc(x) for x in on[1:]]})


def _reach_back(matrix: list[int], wanted: int) -> int:
    out = 0
    for k, bits in enumerate(matrix):
        if wanted >> k & 1:
            out |= bits
    return out


def _trace(pieces: Pieces):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.itertuples(index=False):
                if r.sure_a and r.sure_b:
                    found.append(pieces.encode_marked(r.window[r.offset :]))
                    continue
                enter, leave = int.from_bytes(r.enter, "little"), int.from_bytes(r.leave, "little")
                entries = pieces.boundary(r.window, r.offset, r.sure_a)
                nodes = pieces.scan(r.window, r.offset, entries)
                exits = _exits(pieces, r.window, r.sure_b, nodes, entries, r.offset)
                found.append(np.array(pieces.trace(r.window, r.offset, entries, enter, nodes, exits, leave, r.sure_b), np.int32))
            yield pd.DataFrame({"key": batch["key"], "k": batch["k"], "ids": found})
    return run


def encode(docs: DataFrame, text: str, name: str, pieces: Pieces, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with all its columns and ``name``, the array of ids.

    Texts up to two chunks are encoded where they are; longer ones chunk by chunk, each distinct text once.
    """
    @F.pandas_udf("array<int>")
    def here(texts: pd.Series) -> pd.Series:
        return pd.Series([pieces.encode(t) for t in texts])

    # Batches of fewer rows: ids and texts of thousands of documents at once are what fills a worker.
    conf, name_of = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name_of)) > BATCH:
        conf.set(name_of, str(BATCH))
    # Said to be non-deterministic, or a plan that uses the ids twice would encode twice.
    here = here.asNondeterministic()
    long = F.length(whole_text(text)) > 2 * chunk
    rows = docs.select(F.struct("*").alias("row"), whole_text(text).alias("text"), long.alias("long"))
    short = rows.filter("NOT long").select("row.*", here("text").alias(name))
    giants = rows.filter("long").withColumn("key", F.sha2(F.col("text"), 256))
    texts = giants.groupBy("key").agg(F.first("text").alias("text"))
    cut = materialise(texts.mapInPandas(_cut(pieces, chunk), "key string, k int, offset int, window string, sure_a boolean, sure_b boolean"), "chunks")
    matrices = cut.mapInPandas(_transfer(pieces), "key string, k int, matrix array<binary>")
    states = matrices.groupBy("key").applyInPandas(_states_on_path, "key string, k int, enter binary, leave binary")
    traced = cut.join(states, ["key", "k"]).mapInPandas(_trace(pieces), "key string, k int, ids array<int>")
    whole = traced.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda c: c["ids"])).alias("ids"))
    return short.unionByName(giants.join(whole, "key").select("row.*", F.col("ids").alias(name)))


def decode(docs: DataFrame, ids: str, name: str, pieces: Pieces) -> DataFrame:
    """``docs`` with ``name``, the text of a column of ids."""
    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return pd.Series([pieces.decode(x) if x is not None else None for x in column])

    return docs.withColumn(name, text_of(F.col(ids)))


@query("op8_max_plus_pieces")
def op8_max_plus_pieces(spark, folder):
    """Ids of every document as a count and a digest, and whether they decode to its text."""
    pieces = Pieces.load()
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = decode(encode(docs, "text", "ids", pieces), "ids", "decoded", pieces)

    @F.pandas_udf("string")
    def digest(column: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(np.asarray(x, "<i4").tobytes()).hexdigest() for x in column])

    plain = F.replace(whole_text("text"), F.lit(SPACE), F.lit(" "))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest("ids").alias("ids_sha256"),
                       (F.col("decoded") == plain).alias("round_trip"))
