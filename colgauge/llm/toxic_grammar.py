"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers are composed into one machine. Two find phrases of one or several words, one those of insult, one
those of threat: a state is what has been read of a phrase, and where none goes on the longest one that can takes
over. Three read the symbols that those write (insult, threat, target, negation, report, other): one marks what stands
in the scope of a negation, one what is reported speech, one whether an insult or a threat has a target, before it or,
for threats, after it. A clause is one run through the machine, from its first word to its last; its log-odds are the
sum of the weights of the arcs on its path, and a text's those of all its clauses and of the base. A word alone never decides: a threat
without a target is nothing, a negated or reported insult weighs less than a direct one.

Labels teach two things, on a bounded sample of about ``SAMPLE`` labelled documents: further insults, a
symbol of their own (words that stand almost only in toxic documents, after many different words, so
that copies of one text teach nothing), and the weights of the arcs: those that write one symbol share one weight, found by a ridge
regression, drawn to the priors, of the label on how often the paths of a text write each symbol.

Defined results: a NULL or empty text scores as one in which no clause matches; without labels the priors hold; a label that is NULL
is no label; a document labelled twice is toxic if one label says so; repeated rows are scored each; an empty
table gives no rows. Only the id and the text are read; the id serves folds and the sample alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colgauge.llm.common import fold, query, table

SAMPLE = 20_000         # labelled rows of the fit, about
CONTEXTS = 8            # different words before it that a learned insult needs among toxic texts
PURE = 0.8              # share of toxic texts among its occurrences, some taken off
SHRINK = 4.0            # occurrences taken off before a share is believed
RIDGE = 0.5             # how strongly log-odds are drawn to their priors
SCOPE = 3               # words that a negation reaches
FLAG = 0.7
BASE = -3.0             # log-odds of a text in which no clause matches, before labels are seen

# Words of the grammar, in the languages of the corpus.
INSULTS = (
    "idiot idiots moron morons stupid imbecile fool loser losers scum trash garbage pathetic worthless disgusting "
    "clown dumb dumbass jerk pig pigs rat vermin filth freak creep coward liar bastard bitch asshole retard scumbag "
    "dummkopf trottel arschloch schwachkopf abschaum versager dreckskerl "
    "imbécile crétin connard salaud abruti ordure minable idiote "
    "imbécil estúpido estúpida gilipollas cabrón escoria basura inútil idiotas"
).split()
THREATS = "kill murder destroy hurt hang shoot stab beat burn töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours yourself he she they them him her du dich dir ihr euch sie tu toi te vous tú ti usted ustedes".split()
INSULT_PHRASES = (
    "shut up", "go to hell", "drop dead", "piece of shit", "piece of crap", "waste of space", "son of a bitch", "screw you", "fuck you",
    "halt die klappe", "fahr zur hölle", "halt die fresse", "leck mich",
    "ta gueule", "va te faire", "ferme la", "sale con",
    "vete al infierno", "cierra la boca", "hijo de puta", "vete a la mierda",
)
THREAT_PHRASES = (
    "hope you die", "watch your back", "coming for", "wish you were dead", "beat the hell out of", "smash the face of",
    "mach dich fertig", "bring dich um", "vais te tuer", "voy a matar", "voy a por",
)
NEGATIONS = "not no never isn aren wasn don doesn neither nor without nicht kein keine nie pas jamais ni nunca jamás tampoco".split()
REPORTS = "said says say told claimed called quoted reported wrote alleged sagte sagt behauptete dit disait dijo dice".split()

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n|]+")

Arcs = Mapping[tuple[object, str], tuple[object, str, float]]


def machine(states: Mapping[object, Mapping[str, tuple[object, str, float]]], symbols: str) -> Arcs:
    """A transducer with an arc for each state and symbol; one not given keeps the state and copies the symbol."""
    return {(s, x): arcs.get(x, (s, x, 0.0)) for s, arcs in states.items() for x in symbols}


def phrases(listed: Iterable[str], mark: str, letters: Iterable[str], else_: Mapping[str, str]) -> Arcs:
    """Reads words and writes ``mark`` where a phrase ends, else the word itself or what ``else_`` has for it.

    A state is the longest end of what was read that begins a phrase.
    """
    whole = {tuple(p.split()) for p in listed}
    begun = {p[:i] for p in whole for i in range(len(p))} | {()}
    arcs = {}
    for state in begun:
        for x in letters:
            read = (*state, x)
            ends = [read[i:] for i in range(len(read) + 1)]
            arcs[state, x] = (next(e for e in ends if e in begun), mark if whole.intersection(ends) else else_.get(x, x), 0.0)
    return arcs


# Symbols: o other, I insult, L learned insult, H threat, Y target, N negation, R report; i l h negated,
# J M K reported; and with a target A insult, E learned insult, B threat, a e b negated, C F D reported.
def negation(scope: int = SCOPE) -> Arcs:
    states: dict = {0: {"N": (scope, "o", 0.0)}}
    for k in range(1, scope + 1):
        step = {x: (k - 1, x, 0.0) for x in "oYR"}
        struck = {x: (k - 1, x.lower(), -2.5) for x in "ILH"}
        states[k] = step | struck | {"N": (scope, "o", 0.0)}
    return machine(states, "oILHYNR")


def report() -> Arcs:
    told = {x: (1, y, -1.5) for x, y in zip("ILH", "JMK")} | {x: (1, x, -1.0) for x in "ilh"} | {"R": (1, "o", 0.0)}
    return machine({0: {"R": (1, "o", 0.0)}, 1: told}, "oILHYRilh")


def target() -> Arcs:
    pairs = dict(zip("ILHilhJMK", "AEBaebCFD"))
    threats = "HhK"
    weight = {x: -3.0 if x in threats else {"I": 2.0, "J": 2.0, "L": 0.0, "M": 0.0}.get(x.upper(), -2.0) for x in pairs}
    gain = {x: 5.5 if x in threats else 0.5 for x in pairs}
    alone = {x: (x if x in threats else 0, x, weight[x]) for x in pairs} | {"Y": (1, "o", 0.0)}
    aimed = {x: (1, y, weight[x] + gain[x]) for x, y in pairs.items()} | {"Y": (1, "o", 0.0)}
    # After a threat that has no target yet, a target makes it one.
    waits = {x: alone | {"Y": (1, pairs[x], gain[x])} for x in threats}
    return machine({0: alone, 1: aimed} | waits, "oILHYilhJMK")


def compose(a: Arcs, b: Arcs, start: tuple = (0, 0)) -> Arcs:
    """The machine that runs ``a`` and feeds what it writes to ``b``; weights add. Only states that can be reached."""
    symbols = {x for _, x in a}
    out: dict = {}
    queue, met = [start], {start}
    while queue:
        s, t = state = queue.pop()
        for x in symbols:
            s2, y, w = a[s, x]
            t2, z, v = b[t, y]
            out[state, x] = ((s2, t2), z, w + v)
            if (s2, t2) not in met:
                met.add((s2, t2))
                queue.append((s2, t2))
    return out


GRAMMAR = compose(compose(negation(), report()), target(), ((0, 0), 0))
START = ((0, 0), 0)

# What a word is read as: itself if a longer phrase holds it, else one letter for all words of its kind.
KINDS = {w: k for k, words in {"R": REPORTS, "N": NEGATIONS, "Y": TARGETS, "H": THREATS, "I": INSULTS}.items() for w in words}
PARTS = {w for p in (*INSULT_PHRASES, *THREAT_PHRASES) for w in p.split()}
_LETTERS = [*"oILHYNR", *sorted(PARTS)]
CLAUSES = compose(
    compose(phrases(INSULT_PHRASES, "I", _LETTERS, {}),
            phrases(THREAT_PHRASES, "H", _LETTERS, {w: KINDS.get(w, "o") for w in PARTS}), ((), ())),
    GRAMMAR, (((), ()), START))
CLAUSE_START = (((), ()), START)


# From the weakest to the strongest.
PATTERNS = "hblieaKMDFJCHLEIBA"


class Reader:
    """What the paths of a text's clauses write, and their weights."""

    def __init__(self, learned: list[str]):
        self.letter = {w: "L" for w in learned} | KINDS | {w: w for w in PARTS}
        # A clause without any of these writes nothing but "o"; a phrase is known by its longest word.
        self.marked = {w for w, k in self.letter.items() if k in "ILH"} | {w for w in PARTS if KINDS.get(w, "o") in "IH"} | {
            max(p.split(), key=len) for p in (*INSULT_PHRASES, *THREAT_PHRASES)}

    def paths(self, text: str | None) -> Iterator[tuple[list[str], float]]:
        """For each clause that matches: the symbols written, "o" left out, and the sum of the arcs' weights before learning."""
        low = (text or "").lower()
        if self.marked.isdisjoint(_WORD.findall(low)):
            return
        for clause in _CLAUSE.split(low):
            words = _WORD.findall(clause)
            if self.marked.isdisjoint(words):
                continue
            state, wrote, weight = CLAUSE_START, [], 0.0
            for w in words:
                state, y, v = CLAUSES[state, self.letter.get(w, "o")]
                weight += v
                if y != "o":
                    wrote.append(y)
            if wrote:
                yield wrote, weight

    def patterns(self, text: str | None) -> list[tuple[str, float]]:
        """The strongest symbol of each clause that matches, and the weight of its path."""
        return [(max(wrote, key=PATTERNS.index), weight) for wrote, weight in self.paths(text)]

    def counts(self, text: str | None) -> np.ndarray:
        """How often the paths of a text write each symbol."""
        out = np.zeros(len(PATTERNS))
        for wrote, _ in self.paths(text):
            for y in wrote:
                out[PATTERNS.index(y)] += 1
        return out


def prior_weights() -> np.ndarray:
    """The log-odds of no match, then what writing each symbol adds: the arc weights of the plainest clause that does."""
    plain = {"I": "I", "L": "L", "H": "H", "A": "YI", "E": "YL", "B": "YH", "i": "NI", "l": "NL", "h": "NH",
             "a": "NYI", "e": "NYL", "b": "NYH", "J": "RI", "M": "RL", "K": "RH", "C": "RYI", "F": "RYL", "D": "RYH"}
    weights = []
    for pattern in PATTERNS:
        state, total = START, 0.0
        for x in plain[pattern]:
            state, _, w = GRAMMAR[state, x]
            total += w
        weights.append(max(total - BASE, 0.0))
    return np.array([BASE, *weights])


class Toxicity:
    """A reader and the learned weight of each symbol's arcs; a few kB, sent with the tasks."""

    def __init__(self, learned: list[str], weights: np.ndarray):
        self.reader, self.weights = Reader(learned), weights

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.weights[0] + self.reader.counts(text) @ self.weights[1:]))))


def fit_weights(x: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ridge regression of the log-odds, drawn to the priors: ``toxic`` of ``n`` texts with the counts ``x``."""
    first = prior_weights()
    x = np.hstack([np.ones((len(x), 1)), x])
    theta = first.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (toxic - n * p) - RIDGE * (theta - first)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(theta)), slope)
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    theta[1:] = np.maximum(theta[1:], 0)        # nothing this grammar finds makes a text less toxic
    return theta


def _learned_insults(sample: DataFrame) -> list[str]:
    """Words that stand almost only in toxic texts and after many different words."""
    words = sample.select("toxic", F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)).alias("w"))
    before = F.concat(F.array(F.lit("")), F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))))
    pairs = words.filter(F.size("w") > 0).select("toxic", F.explode(F.array_distinct(F.arrays_zip(
        F.col("w").alias("word"), before.alias("before")))).alias("p"))
    seen = pairs.groupBy(F.col("p.word").alias("word"), F.col("p.before").alias("before")).agg(
        F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    # Each word before it counts once, whatever the number of texts that repeat the two.
    counts = seen.groupBy("word").agg(
        F.sum((F.col("t") > 0).cast("int")).alias("contexts"), F.sum((F.col("t") < F.col("n")).cast("int")).alias("clean"))
    pure = F.col("contexts") - SHRINK >= PURE * (F.col("contexts") + F.col("clean") - SHRINK)
    return [r.word for r in counts.filter((F.col("contexts") >= CONTEXTS) & pure).orderBy(F.desc("contexts"), "word").collect()]


def fit_toxicity(docs: DataFrame, labels: DataFrame, learns: Column, id_col: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Toxicity:
    """Learns from a bounded sample of the labelled documents that ``learns`` marks."""
    known = labels.select(F.col(id_col).alias("id"), F.col(toxic).cast("int").alias("toxic")).filter(
        F.col("id").isNotNull() & F.col("toxic").isin(0, 1))
    n = known.count()
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # About SAMPLE rows, however many labels there are: small enough to be sent to every task.
    drawn = known.filter(at < F.lit(SAMPLE / max(n, 1))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    sample = docs.filter(learns).select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter(
        F.col("text").isNotNull()).join(F.broadcast(drawn), "id").select("text", "toxic")
    learned = _learned_insults(sample)
    reader = Reader(learned)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"counts": [reader.counts(t).tolist() for t in b["text"]], "toxic": b["toxic"]})

    rows = sample.mapInPandas(counted, "counts array<double>, toxic int").groupBy("counts").agg(
        F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(rows, key=lambda r: r.counts)
    if not rows:
        return Toxicity(learned, prior_weights())
    return Toxicity(learned, fit_weights(np.array([r.counts for r in rows]), *(np.array([float(r[k]) for r in rows]) for k in "tn")))


def score_toxicity(docs: DataFrame, text: str, model: Toxicity, name: str = "score") -> DataFrame:
    """``docs`` with all its columns and ``name``, a number from 0 to 1, in place of any so named."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts])

    return docs.withColumn(name, score(F.col(text)))


@query("op10_toxic_grammar")
def op10_toxic_grammar(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = fold("doc_id", 3) == 1
    model = fit_toxicity(docs, table(spark, folder, "labels"), ~held)
    return score_toxicity(docs, "text", model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= FLAG).cast("int").alias("predicted"))
