"""Language of whole texts by string kernels, Nystroem landmarks and kernel ridge regression.

A text is the set of its byte n-grams of 1 to 3 bytes (a blended spectrum; presence, not counts),
once letters are lower case and everything else a single space. The kernel of two texts is the
number of n-grams they share over the root of the product of their set sizes. Some labelled texts
serve as landmarks: phi(x) = K(x, landmarks) K(landmarks, landmarks)^-1/2, and one ridge regression
for each language against the rest is fitted on phi. As K(x, landmarks) is the presence row of x
times the presence matrix of the landmarks, the fitted weights fold into one matrix of n-grams x languages, and
texts are scored in batches as presence rows times that matrix.

The fit uses a bounded sample: about ``SAMPLE`` labelled rows of each language, ``LANDMARKS`` of them
landmarks, drawn by a hash of the id. Every text is then scored whole.

Defined results: a NULL text or one without a letter is ``und`` with score 0; without labelled
texts every text is ``und``; with one language every text with a letter is of it; equal scores go to the
language that is first in order; repeated rows are scored each; an empty table gives no rows.
Columns other than those named are not read, and labels are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colgauge.llm.common import fold, query, table

LONGEST = 3             # bytes of the longest n-gram
LANDMARKS = 48          # landmarks of each language, about
SAMPLE = 600            # labelled rows of each language that the fit uses, about
RIDGE = 1e-3
UNKNOWN = "und"
_SPACE = 1 << 24        # n-grams of three bytes; shorter ones lie in other ranges
_SIZE = _SPACE + (1 << 16) + (1 << 8)

_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32


def grams(text: str) -> np.ndarray:
    """The sorted distinct n-grams of a text as numbers below ``_SIZE``."""
    data = _KEEP[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    blank = data == 32
    data = data[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint32)
    one, two = data + _SPACE + 65536, (data[:-1] << 8 | data[1:]) + _SPACE
    three = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return np.unique(np.concatenate([one, two, three]))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b = b[[has_letter(t) for t in b["text"]]]
        yield pd.DataFrame({"lang": b["lang"], "at": b["at"], "grams": [grams(t).astype(np.int32).tobytes() for t in b["text"]]})


class Landmarks:
    """Presence rows of the landmarks over the n-grams that any of them holds."""

    def __init__(self, sets: list[np.ndarray]):
        self.known = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint32)
        self.presence = np.zeros((len(self.known), len(sets)), np.float32)
        for i, s in enumerate(sets):
            self.presence[np.searchsorted(self.known, s), i] = 1 / np.sqrt(len(s))

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), self.presence.shape[1]))
        for i, s in enumerate(sets):
            at = np.searchsorted(self.known, s)
            at = at[self.known[np.minimum(at, len(self.known) - 1)] == s]
            out[i] = self.presence[at].sum(0) / np.sqrt(len(s))
        return out


class LanguageModel:
    """Weights of every known n-gram for every language; a few MB, sent with the tasks."""

    def __init__(self, langs: list[str], known: np.ndarray, weights: np.ndarray, offset: np.ndarray, sharpness: float):
        self.langs, self.known, self.weights, self.offset, self.sharpness = langs, known, weights, offset, sharpness

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        if not rows:
            return best, score
        place = _table(self)
        margins = np.empty((len(rows), len(self.langs)))
        for k, i in enumerate(rows):
            s = grams(texts[i])
            at = place[s]
            # A presence row times the matrix: the sum of the rows of the n-grams that are present.
            margins[k] = self.weights[at].sum(0) / np.sqrt(len(s))
        margins = self.sharpness * (margins + self.offset)
        likely = np.exp(margins - margins.max(1, keepdims=True))
        likely /= likely.sum(1, keepdims=True)
        top = likely.argmax(1)
        score[rows] = likely[np.arange(len(rows)), top]
        for i, k in zip(rows, top):
            best[i] = self.langs[k]
        return best, score


_PLACES: dict[int, np.ndarray] = {}


def _table(model: LanguageModel) -> np.ndarray:
    """Where each n-gram stands among the weights; the last row, zero, is for all others."""
    key = hash((len(model.known), model.known[:1].tobytes(), model.weights.tobytes()))
    if key not in _PLACES:
        _PLACES.clear()
        place = np.full(_SIZE, len(model.known), np.int32)
        place[model.known] = np.arange(len(model.known), dtype=np.int32)
        _PLACES[key] = place
    return _PLACES[key]


def fit_languages(docs: DataFrame, text: str, lang: str, id_col: str, learns: Column) -> LanguageModel:
    """Fits on a bounded sample of the rows that ``learns`` marks, drawn by the hash of id and text."""
    rows = docs.filter(learns & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"),
        (F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text)), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("at"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)

    def drawn(n: int) -> DataFrame:
        share = F.lit(0.0)
        for name, total in counts.items():
            share = F.when(F.col("lang") == name, F.lit(n / total)).otherwise(share)
        # Rows of one id and text share a draw, and teach once.
        return rows.filter(F.col("at") < share).dropDuplicates(["lang", "at"])

    schema = "lang string, at double, grams binary"
    sets = sorted(drawn(LANDMARKS).mapInPandas(_distinct, schema).collect(), key=lambda r: (r.lang, r.at, bytes(r.grams))) if langs else []
    if not sets:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((1, 0)), np.zeros(0), 1.0)
    marks = Landmarks([np.frombuffer(r.grams, np.int32) for r in sets])

    def kernel_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[has_letter(t) for t in b["text"]]]
            k = marks.kernel([grams(t).astype(np.int32) for t in b["text"]])
            yield pd.DataFrame({"lang": b["lang"], "at": b["at"], "k": [r.tobytes() for r in k]})

    sample = sorted(drawn(SAMPLE).mapInPandas(kernel_rows, "lang string, at double, k binary").collect(), key=lambda r: (r.lang, r.at, bytes(r.k)))
    k = np.array([np.frombuffer(r.k) for r in sample])
    y = np.array([[1.0 if r.lang == name else -1.0 for name in langs] for r in sample])
    own = marks.kernel([np.frombuffer(r.grams, np.int32) for r in sets])
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k @ root
    offset = y.mean(0)
    fitted = np.linalg.solve(phi.T @ phi + RIDGE * len(phi) * np.eye(phi.shape[1]), phi.T @ (y - offset))
    weights = np.vstack([marks.presence @ (root @ fitted), np.zeros((1, len(langs)))])
    margins, truth = phi @ fitted + offset, y.argmax(1)

    def loss(b: float) -> float:
        m = b * margins
        top = m.max(1)
        return float((top + np.log(np.exp(m - top[:, None]).sum(1)) - m[np.arange(len(m)), truth]).mean())

    sharpness = min((1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0), key=loss)
    return LanguageModel(langs, marks.known, weights, offset, sharpness)


def _found(docs: DataFrame, text: str, model: LanguageModel) -> DataFrame:
    """(row, found.lang, found.score): rows as they were beside what is found."""
    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        best, score = model.predict(texts.tolist())
        return pd.DataFrame({"lang": best, "score": score})

    return docs.select(F.struct("*").alias("row"), predict(F.col(text)).alias("found"))


def identify(docs: DataFrame, text: str, model: LanguageModel, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with all its columns and two more, in place of any so named: the language and how sure it is."""
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in (lang, score)]
    return _found(docs, text, model).select(*kept, F.col("found.lang").alias(lang), F.col("found.score").alias(score))


SURE = 0.35     # the pipeline keeps a document whose best language has at least this share


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose language is found with some certainty, columns as they were.

    Texts without a letter go, and those that no language claims; labels only teach. Where nothing is labelled, texts with a letter stay.
    """
    model = fit_languages(docs, text, lang, id_col, fold(id_col, 3) != 1)
    if not model.langs:
        return docs.filter(F.col(text).rlike(r"\p{L}"))
    return _found(docs, text, model).filter((F.col("found.lang") != UNKNOWN) & (F.col("found.score") >= SURE)).select("row.*")


@query("op3_string_kernel")
def op3_string_kernel(spark, folder):
    docs = table(spark, folder, "documents")
    held = fold("doc_id", 3) == 1
    model = fit_languages(docs, "text", "lang", "doc_id", ~held)
    found = identify(docs.select("doc_id", "text"), "text", model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
