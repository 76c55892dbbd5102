"""Words of whole texts as 64-bit hashes, batch by batch and without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
# The multipliers of the SplitMix64 generator.
_GAMMA, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
CHUNK = 1 << 20     # bytes of text hashed at once; one longer text is a chunk of its own

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray | int) -> np.ndarray:
    """The SplitMix64 finaliser: a permutation of 64-bit numbers."""
    x = np.asarray(x, dtype=_U)
    with np.errstate(over="ignore"):
        x = (x + _GAMMA)
        x = (x ^ (x >> _U(30))) * _M1
        x = (x ^ (x >> _U(27))) * _M2
        return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256))
_POWERS = np.ones(1, _U)
_BASE = int(mix(7)) | 1


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << int(n).bit_length()
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([[_U(1)], np.cumprod(np.full(size, _BASE, _U))])
    return _POWERS


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in an array of bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and where the words of each text end."""
    blobs = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    ends_at = np.cumsum([len(b) + 1 for b in blobs], dtype=np.int64)
    data = _LOWER[np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)] if blobs else np.zeros(0, np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    lengths = ends - starts
    inside = ~_SPACE[data]
    place = np.flatnonzero(inside) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        values = _BYTE[data[inside]] * _powers(int(lengths.max()) + 1)[place]
        sums = np.add.reduceat(values, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return mix(sums ^ lengths.astype(_U)), np.searchsorted(starts, ends_at).astype(np.int64)


def chunks(texts: list[str | None], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``size`` characters together, or one longer text."""
    first = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and total + n > size:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


def each_text(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of one text after the other."""
    for a, b in chunks(texts):
        hashes, ends = hash_words(texts[a:b])
        start = 0
        for end in ends:
            yield hashes[start:end]
            start = end
