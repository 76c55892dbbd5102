"""Token ids packed into rows of fixed length by best fit, longest first.

Each document is encoded by the tokenizer's library, an end token is put behind it, and it is cut into
pieces of at most the row length; nothing is lost, and the pieces' places in their document are kept. Documents are dealt into
shards of bounded size by a hash, and a shard packs its pieces from the longest to the shortest, each
into the row with the least room that still holds it. A segment tree over the amounts of room says in
O(log length) steps which is the least one that suffices. A packed row carries its ids as a binary
row of the matrix (int32, padded), where its segments end, and positions that start anew with each segment.

Defined results: a NULL or empty text is the end token alone; a NULL id is kept as NULL; repeated
rows are packed each; equal lengths go in the order of (id, place in the document, ids); an empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from colgauge.llm.common import groups_for, query, table, whole_text
from colgauge.llm.sentencepieces import MODEL
from colgauge.llm.words import chunks

LENGTH = 2048       # ids of a row
END = 2             # the id put behind each document
PAD = 0
SHARD = 4 << 20     # bytes of input of a shard, about

_SCHEMA = ("shard int, row int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, starts array<int>")


class Rooms:
    """Open rows by the room left in them, under a segment tree of how many there are."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at //= 2

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need``: (room, row), and it is open no more."""
        at = need + self.size
        if not self.count[at]:
            # Up to the first node with rows to its right, then down to the leftmost of them.
            while at > 1 and not (at % 2 == 0 and self.count[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Which pieces lie in each row; ``lengths`` comes in decreasing order."""
    rooms, rows = Rooms(length), []
    for k, n in enumerate(lengths):
        found = rooms.take(n)
        if found is None:
            found = (length, len(rows))
            rows.append([])
        room, row = found
        rows[row].append(k)
        if room > n:
            rooms.put(room - n, row)
    return rows


def load_model(path: str = MODEL) -> bytes:
    """A tokenizer's file, read by the driver and sent with the tasks: half a MB."""
    with open(path, "rb") as f:
        return f.read()


def _encode(model: bytes):
    """The tokenizer's ids of each text, as int32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        for b in batches:
            texts = b["text"].tolist()
            for first, end in chunks(texts):
                ids = [x.tobytes() for x in library.encode(texts[first:end], num_threads=1, return_type="numpy")]
                yield pd.DataFrame({"id": b["id"].array[first:end], "shard": b["shard"].array[first:end], "ids": ids})
    return run


def _pack(length: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pieces, places = [], np.arange(length, dtype="<i4")
        for doc, blob in zip(pdf["id"], pdf["ids"]):
            ids = np.append(np.frombuffer(blob, "<i4"), np.int32(END))
            known = not pd.isna(doc)
            pieces += [(min(length, len(ids) - a), known, int(doc) if known else 0, a, ids[a : a + length].tobytes()) for a in range(0, len(ids), length)]
        pieces.sort(key=lambda p: (-p[0], p[1:]))
        out = []
        for row, members in enumerate(best_fit([p[0] for p in pieces], length)):
            sizes = [pieces[k][0] for k in members]
            ids, positions = np.full(length, PAD, "<i4"), np.zeros(length, "<i4")
            used = sum(sizes)
            ids[:used] = np.frombuffer(b"".join(pieces[k][4] for k in members), "<i4")
            positions[:used] = np.concatenate([places[:n] for n in sizes])
            out.append((key[0], row, ids.tobytes(), positions.tobytes(), [0, *np.cumsum(sizes).tolist()],
                        [pieces[k][2] if pieces[k][1] else None for k in members], [pieces[k][3] for k in members]))
        return pd.DataFrame(out, columns=["shard", "row", "ids", "positions", "cu_seqlens", "doc_ids", "starts"])
    return run


def pack(docs: DataFrame, id_col: str, text: str, model: bytes, length: int = LENGTH) -> DataFrame:
    """Packed rows: (shard, row, ids, positions, cu_seqlens, doc_ids, starts).

    ``ids`` and ``positions`` are rows of int32 matrices; segment s of a row holds ids cu_seqlens[s] to
    cu_seqlens[s + 1], which are those of doc_ids[s] from its place starts[s] on.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text).alias("text"))
    # The length deals rows that share an id; only ids move.
    shard = F.pmod(F.xxhash64("id", F.length("text")), F.lit(groups_for(rows.select("text"), SHARD))).cast("int")
    dealt = rows.select("id", shard.alias("shard"), "text").mapInPandas(_encode(model), "id long, shard int, ids binary")
    return dealt.groupBy("shard").applyInPandas(_pack(length), _SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet, the id matrix as its column of binary rows."""
    packed.write.mode("overwrite").parquet(path)


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark, folder):
    """Every packed row of ``documents`` with its segments, and digests of its ids and positions."""
    packed = pack(table(spark, folder, "documents"), "doc_id", "text", load_model())
    return packed.select("shard", "row", "doc_ids", "starts", "cu_seqlens", F.element_at("cu_seqlens", -1).alias("n_ids"),
                         F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))
