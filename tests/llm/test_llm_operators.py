"""The training-data operators: edge cases, brute force, round trips."""

import hashlib
import pickle
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colgauge.llm import (
    backoff_lm, best_fit_packing, feistel_pii, odd_sketch, pivot_search, sentencepieces, simhash, string_kernel, toxic_grammar,
    weighted_mix,
)
from colgauge.llm.catalog import registered_queries, registered_sql
from colgauge.llm.words import each_text

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, row string, score double, ids string, label long"
LONG = "one two three four five six seven eight nine ten " * 400


def rows(spark, *texts):
    """Documents with NULLs, empty and long texts, repeated rows and extra columns."""
    given = [(i, t, "en", "src1", len(t or ""), 1, "r", 0.5, "x", 2) for i, t in enumerate(texts)]
    odd = [
        (100, None, "en", None, None, None, None, None, None, None), (101, "", None, "src2", 0, 1, "r", 1.0, "x", 2),
        (102, LONG, "en", "src1", len(LONG), 1, "r", 0.1, "x", 3), (102, LONG, "en", "src1", len(LONG), 1, "r", 0.1, "x", 3),
        (None, "no id here at all my friend", "en", "src3", 5, 1, "r", 0.2, "x", 1), (103, " \t\n ", "de", "", 4, 1, "r", 0.2, "x", 1),
        (104, "12 345 !!", None, None, 4, 1, "r", 0.2, "x", 1),
    ]
    return spark.createDataFrame(given + odd, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_group_numbers_of_rows_that_are_in_no_file(spark):
    """A plan over an RDD of rows guesses exabytes; numbers of groups then follow the rows."""
    from colgauge.llm.common import groups_for, input_bytes

    df = spark.createDataFrame(spark.sparkContext.parallelize([("abcdé",), (None,), ("x" * 100,)]), "text string")
    assert input_bytes(df) == 106 and groups_for(df, 50, 1) == 3 and groups_for(empty(spark).select("text")) == 8


# --- 1 -----------------------------------------------------------------------------------------


def test_share_out_fills_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000)], "l0 string, l1 string, tokens long")
    got = {(r.l0, r.l1): r.target for r in weighted_mix.budgets(leaves, ["l0", "l1"], {}, F.lit(400.0), 1).collect()}
    # a/x is short by 90: its sibling a/y takes that, b is untouched.
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", "y"): 100}
    got = {(r.l0, r.l1): r.target for r in weighted_mix.budgets(leaves, ["l0", "l1"], {"a": 9.0}, F.lit(2000.0), 1).collect()}
    # a as a whole is short: the rest goes to b.
    assert got == {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 495, ("b", "y"): 495}


def test_mix_edge_cases(spark):
    df = rows(spark, "a b c", "d e f g", "h")
    done = weighted_mix.mix(df, [F.col("lang"), F.col("source")], {"en": 2.0, "de": 0.0}, share=1.5, epochs=3, epoch="epoch").collect()
    assert all(0 <= r.epoch < 3 for r in done) and not any(r.lang == "de" for r in done)
    assert set(done[0].asDict()) == {*df.columns, "epoch"}
    assert weighted_mix.mix(df.withColumn("epoch", F.lit("x")), [F.col("lang")], {}, epoch="epoch").columns == [*df.columns, "epoch"]
    assert weighted_mix.mix(empty(spark), [F.col("lang")], {}).count() == 0


def test_mix_prefix_is_the_longest_that_is_affordable(spark):
    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), "s") for i in range(300)], "doc_id long, text string, source string")
    share, total = 0.37, sum(i % 7 + 1 for i in range(300))
    got = {r.doc_id for r in weighted_mix.mix(df, [F.col("source")], {}, share=share).collect()}
    order = sorted(range(300), key=lambda i: int(hashlib.md5(f"{weighted_mix.SEED}:0:{i}:{hashlib.md5(('w ' * (i % 7 + 1)).encode()).hexdigest()}".encode()).hexdigest()[:15], 16))
    want, spent = set(), 0
    for i in order:
        spent += i % 7 + 1
        if spent > int(total * share):
            break
        want.add(i)
    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_spends_the_budget_on_rows_without_an_id_and_on_repeated_rows(spark, seed):
    texts = ["four words of text", "just four other words"] + [f"these are words {i}" for i in range(300)]
    given = [(None if i % 2 else i, texts[0 if i % 3 else i % 302], "s") for i in range(1000)] + [(5, texts[1], "s")] * 200
    df = spark.createDataFrame(given, "doc_id long, text string, source string")
    done = weighted_mix.mix(df, [F.col("source")], {}, share=0.25, seed=seed).collect()
    assert 4 * len(done) == 1200
    # No row comes more often than an epoch holds it.
    for key in {(r.doc_id, r.text) for r in done}:
        assert sum((r.doc_id, r.text) == key for r in done) <= sum((i, t) == key for i, t, _ in given)


def test_weights_go_by_path(spark):
    leaves = spark.createDataFrame([("en", "en", 1000), ("en", "x", 1000), ("de", "en", 1000), ("de", "x", 1000)], "l0 string, l1 string, tokens long")
    share = lambda w: {(r.l0, r.l1): r.target for r in weighted_mix.budgets(leaves, ["l0", "l1"], w, F.lit(800.0), 1).collect()}
    # A name at another level takes nothing from the root's weight.
    assert share({"en": 3.0}) == {("en", "en"): 300, ("en", "x"): 300, ("de", "en"): 100, ("de", "x"): 100}
    assert share({("*", "en"): 3.0}) == {("en", "en"): 300, ("en", "x"): 100, ("de", "en"): 300, ("de", "x"): 100}
    assert share({("*", "en"): 3.0, ("de", "en"): 1.0})[("de", "en")] == 200


# --- 2 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_automaton_against_the_formula(spark, order):
    random.seed(order)
    texts = [" ".join(random.choice("abcDE") for _ in range(random.randint(0, 12))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id") % 5 == 0
    got = {r.doc_id: r for r in backoff_lm.score_texts(df, "doc_id", "text", held, order=order).collect()}
    seqs = [["<s>", *t.lower().split(), "</s>"] for t in texts]
    counts, starts = {}, 0
    for i, s in enumerate(seqs):
        if i % 5:
            starts += 1
            for k in range(1, order + 1):
                for j in range(max(k - 1, 1), len(s)):
                    g = tuple(s[j - k + 1 : j + 1])
                    counts[g] = counts.get(g, 0) + 1
    total, distinct = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)

    def prob(context, w):
        if not context:
            return (counts.get((w,), 0) + 1) / (total + distinct + 1)
        less = prob(context[1:], w)
        seen = starts if context == ("<s>",) else counts.get(context, 0)
        return (counts.get((*context, w), 0) + backoff_lm.TAU * less) / (seen + backoff_lm.TAU) if seen else less

    for i, s in enumerate(seqs):
        want = sum(np.log10(prob(tuple(s[max(0, j - order + 1) : j]), s[j])) for j in range(1, len(s)))
        assert got[i].score == pytest.approx(want, abs=1e-9)
        assert got[i].n_tokens == len(s) - 1 and got[i].train_tokens == total


def test_backoff_edge_cases(spark):
    got = backoff_lm.score_texts(rows(spark, "a b", "A  b"), "doc_id", "text", F.col("doc_id") == 0).collect()
    assert len(got) == 9 and all(np.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (100, 101, 103)} == {1}
    none = backoff_lm.score_texts(rows(spark), "doc_id", "text", F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and all(r.score == 0 for r in none)
    assert backoff_lm.score_texts(empty(spark), "doc_id", "text", F.lit(False)).count() == 0


# --- 3 and 10 ----------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = registered_queries()["op3_string_kernel"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    right = [r.lang == r.lang_pred for r in found]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in found)


def test_language_edge_cases(spark):
    df = rows(spark, *["the house and the tree", "das haus und der baum"] * 4).withColumn(
        "lang", F.when(F.col("text").startswith("das"), "de").otherwise(F.col("lang")))
    model = string_kernel.fit_languages(df, "text", "lang", "doc_id", F.lit(True))
    found = string_kernel.identify(df, "text", model, "found", "sure").collect()
    assert len(found) == df.count() and {r.found for r in found if r.doc_id in (100, 101, 103, 104)} == {"und"}
    assert all(r.found == ("de" if r.text.startswith("das") else "en") for r in found if r.doc_id is not None and r.doc_id < 8)
    kept = string_kernel.keep_known(df)
    assert kept.columns == df.columns and kept.filter("doc_id < 8").count() == 8
    nothing = string_kernel.fit_languages(empty(spark), "text", "lang", "doc_id", F.lit(True))
    assert {r.found for r in string_kernel.identify(df, "text", nothing, "found", "sure").collect()} == {"und"}
    assert string_kernel.keep_known(empty(spark)).count() == 0


def test_language_learns_from_rows_without_an_id(spark):
    texts = [("en", "the house and the tree number"), ("de", "das haus und der baum nummer")]
    df = spark.createDataFrame([(None, f"{texts[i % 2][1]} {i}", texts[i % 2][0]) for i in range(4000)], "doc_id long, text string, lang string")
    model = string_kernel.fit_languages(df, "text", "lang", "doc_id", F.lit(True))
    assert model.langs == ["de", "en"]
    found = string_kernel.identify(df.withColumn("score", F.lit("x")), "text", model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and found.filter("lang <> lang_pred").count() == 0
    unlabelled = string_kernel.keep_known(df.withColumn("lang", F.lit(None).cast("string")).union(spark.createDataFrame([(1, "12 34", "")], df.schema)))
    assert unlabelled.count() == 4000


def test_kernel_weights_fold(spark):
    """Scores by n-gram weights equal scores by kernels with the landmarks."""
    sets = [string_kernel.grams(t).astype(np.int32) for t in ("the cat sat", "le chat noir", "die katze")]
    marks = string_kernel.Landmarks(sets)
    for i, s in enumerate(sets):
        brute = [len(np.intersect1d(s, o)) / np.sqrt(len(s) * len(o)) for o in sets]
        assert marks.kernel([s])[0] == pytest.approx(brute, abs=1e-6) and brute[i] == pytest.approx(1)


def test_toxicity_grammar():
    reader = toxic_grammar.Reader(["blork"])
    assert [p for p, _ in reader.patterns("You are an idiot. Nice day.")] == ["A"]
    assert [p for p, _ in reader.patterns("that is not a moron")] == ["i"]
    assert [p for p, _ in reader.patterns("she said stupid things")] == ["C"]
    assert [p for p, _ in reader.patterns("they told of scum")][0] in "CJ"
    assert reader.patterns("i will kill the process")[0][1] < reader.patterns("you i will kill")[0][1]
    assert reader.patterns("a blork here")[0][0] == "L" and reader.patterns(None) == [] and reader.patterns("") == []
    model = toxic_grammar.Toxicity([], toxic_grammar.prior_weights())
    assert model.score("you idiot") > model.score("an idiot") > model.score("not an idiot") > model.score("fine") == model.score(None)


def test_composition_equals_cascade():
    random.seed(3)
    n, r, t = toxic_grammar.negation(), toxic_grammar.report(), toxic_grammar.target()
    for _ in range(200):
        states, joint = [0, 0, 0], toxic_grammar.START
        for x in random.choices("oILHYNR", k=12):
            states[0], y, a = n[states[0], x]
            states[1], z, b = r[states[1], y]
            states[2], out, c = t[states[2], z]
            joint, got, w = toxic_grammar.GRAMMAR[joint, x]
            assert got == out and w == pytest.approx(a + b + c)


def test_clause_machine_equals_cascade():
    """Phrase machines and symbol machines run one after the other, arc by arc, give the path of the composed machine."""
    random.seed(4)
    tg = toxic_grammar
    letters = [*"oILHYNR", *sorted(tg.PARTS)]
    others = {w: tg.KINDS.get(w, "o") for w in tg.PARTS}
    machines = [tg.phrases(tg.INSULT_PHRASES, "I", letters, {}), tg.phrases(tg.THREAT_PHRASES, "H", letters, others),
                tg.negation(), tg.report(), tg.target()]
    texts = [random.choices(letters, k=10) for _ in range(200)]
    texts += [random.choices("oYNR", k=2) + random.choice([*tg.INSULT_PHRASES, *tg.THREAT_PHRASES]).split() + ["Y"] for _ in range(100)]
    for text in texts:
        states, joint = [(), (), 0, 0, 0], tg.CLAUSE_START
        for x in text:
            total, y = 0.0, x
            for k, m in enumerate(machines):
                states[k], y, w = m[states[k], y]
                total += w
            joint, got, weight = tg.CLAUSES[joint, x]
            assert got == y and weight == pytest.approx(total)


def test_phrases_end_where_a_phrase_does():
    listed, letters = ["a b c", "b c d", "x", "b"], "abcdxo"
    arcs = toxic_grammar.phrases(listed, "!", letters, {"x": "?"})
    random.seed(5)
    for _ in range(300):
        text, state = random.choices(letters, k=9), ()
        for i, x in enumerate(text):
            state, y, _ = arcs[state, x]
            ends = any(" ".join(text[:i + 1]).endswith(p) and len(p.split()) <= i + 1 for p in listed)
            assert y == ("!" if ends else "?" if x == "x" else x)


def test_toxicity_scores_the_path():
    tg = toxic_grammar
    reader, model = tg.Reader([]), tg.Toxicity([], tg.prior_weights())
    text = "You will kill you idiot scum moron. Nobody is an idiot! He said go to hell; shut up"
    written = [w for w, _ in reader.paths(text)]
    assert [len(w) for w in written] == [4, 1, 1, 1] and reader.counts(text).sum() == 7
    prior = dict(zip(tg.PATTERNS, model.weights[1:]))
    total = model.weights[0] + sum(prior[y] for w in written for y in w)
    assert model.score(text) == pytest.approx(1 / (1 + np.exp(-total)))
    assert model.score("you idiot, you scum") > model.score("you idiot")
    assert model.score("i will kill you") > 0.7 > 0.1 > model.score("kill the process, kill it") == model.score("fine")
    assert [p for p, _ in reader.patterns("shut up. Up and shut. go to hell")] == ["I", "I"]
    assert reader.patterns("wish you were dead")[0][0] == "B"


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = registered_queries()["op10_toxic_grammar"](spark, folder).join(labels, "doc_id").filter("held_out").collect()
    assert not any(r.predicted for r in found if not r.toxic)
    assert np.mean([r.predicted for r in found if r.toxic]) > 0.6


def test_toxicity_edge_cases(spark):
    df, labels = rows(spark, "you idiot", "fine"), spark.createDataFrame(
        [(0, 1), (0, 0), (1, None), (None, 1), (102, 0)], "doc_id long, toxic int")
    model = toxic_grammar.fit_toxicity(df, labels, F.lit(True))
    found = toxic_grammar.score_toxicity(df, "text", model, "tox").collect()
    assert len(found) == df.count() and all(0 <= r.tox <= 1 for r in found)
    none = toxic_grammar.fit_toxicity(empty(spark), labels.limit(0), F.lit(True))
    assert none.score("you idiot") > 0.7 > none.score("fine")


# --- 4 -----------------------------------------------------------------------------------------


def _feistel(x, a, b, what, key=feistel_pii.KEY):
    left, right = divmod(x, b)
    for i in range(feistel_pii.ROUNDS):
        pad = lambda half: int(hashlib.sha512(f"{key}|{what}|{i}|{half}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            left = (left + pad(right) % a) % a
        else:
            right = (right + pad(left) % b) % b
    return left * b + right


def _luhn(s):
    digits = [int(c) for c in reversed(s)]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_feistel_is_a_permutation_and_matches_brute_force(spark):
    df = spark.range(30 * 7).select("id", feistel_pii.feistel(F.col("id"), 30, 7, feistel_pii.KEY, F.lit("t")).alias("y"))
    got = {r.id: r.y for r in df.collect()}
    assert sorted(got.values()) == list(range(210)) and got == {x: _feistel(x, 30, 7, "t") for x in range(210)}


def test_pseudonyms(spark):
    texts = [
        "ip 129.38.82.176 and again 129.38.82.176.", "card 4845168114407329 or 4845-1681-1440-7329, bad 4845168114407320",
        "on 2021-02-29 and 2020-02-29 or 29.02.2020", "call +1 (017) 555-7713 now", "of.55@mail9.example.com!!", "nothing 12345 here",
        "DE89 3704 0044 0532 0130 00 but DE88370400440532013000", "078-05-1120 666-05-1120",
    ]
    df = rows(spark, *texts)
    done = feistel_pii.pseudonymise(df, found="found")
    got = {r.doc_id: r for r in done.collect() if r.doc_id is not None}
    assert done.drop("found").columns == df.columns and done.count() == df.count()
    number = _feistel(((129 * 256 + 38) * 256 + 82) * 256 + 176, 65536, 65536, "ip")
    ip = ".".join(str(number >> n & 255) for n in (24, 16, 8, 0))
    assert got[0].text == f"ip {ip} and again {ip}."
    card = got[1].found[0].pseudonym
    assert _luhn(card) and card[0] == "4" and got[1].found[1].pseudonym.replace("-", "") == card and got[1].text.endswith("bad 4845168114407320")
    assert got[2].text.startswith("on 2021-02-29 and ") and len(got[2].found) == 2
    iso, dotted = (p.pseudonym for p in got[2].found)
    assert iso.split("-") == dotted.split(".")[::-1]
    assert got[3].text.startswith("call +1 (") and "555-7713" not in got[3].text and len(got[3].text) == len(texts[3])
    assert got[4].text.endswith(".com!!") and "mail9" not in got[4].text and len(got[4].text) == len(texts[4])
    assert got[5].text == texts[5] and got[5].found == [] and got[100].text is None and got[101].text == "" and got[102].text == LONG
    iban = got[6].found[0].pseudonym.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and "DE88370400440532013000" in got[6].text
    assert len(got[7].found) == 1 and got[7].text.endswith("666-05-1120")
    assert feistel_pii.pseudonymise(empty(spark)).count() == 0


def test_pseudonyms_of_wider_forms(spark):
    values = {
        "iban": ["ES91 2100 0418 4502 0005 1332", "NO93 8601 1117 947", "DE89370400440532013000"],
        "email": ["lañ.55@mail9.example.com", "Ünal_ö@exämple.de", "_x.y@mail.org", "иван@почта.рф"],
        "phone": ["+44 20 7946 0958", "555 123 4567", "+33 1 23 45 67 89", "+442079460958", "+44 (0)20 7946 0958", "+49 30 123456", "1-800-555-0199"],
        "date": ["2023-01-15", "01/15/2023", "2023/01/15", "15-01-2023"],
    }
    after = {"iban": " I am 12 DE89 3704 0044 0532 0130 00", "email": ", yes", "phone": " I am", "date": "T10:00:00Z"}
    flat = [(k, v) for k, vs in values.items() for v in vs]
    texts = [f"see {v}{after[k] if k != 'date' or v[2] == '2' else ' x'}" for k, v in flat]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in feistel_pii.pseudonymise(df, found="found").collect()}
    for i, (k, v) in enumerate(flat):
        p = got[i].found[0]
        assert (p.kind, p.value) == (k, v) and p.pseudonym != v and len(p.pseudonym) == len(v), (v, got[i])
        assert got[i].text.startswith(f"see {p.pseudonym}" + texts[i][4 + len(v) :][:5])
        assert all(a.isalpha() == b.isalpha() and a.isdigit() == b.isdigit() and a.isupper() == b.isupper() for a, b in zip(v, p.pseudonym))
    of = {p.value: p.pseudonym for r in got.values() for p in r.found}
    assert len(got[0].found) == 2 and of["+44 20 7946 0958"].replace(" ", "") == of["+442079460958"] == of["+44 (0)20 7946 0958"].replace(" (0)", "").replace(" ", "")
    assert of["+33 1 23 45 67 89"].startswith("+33 ") and of["+49 30 123456"].startswith("+49 ")
    assert of["2023-01-15"].replace("-", "/") == of["2023/01/15"] and int(of["01/15/2023"][3:5]) > 12
    assert "ñ" not in of["lañ.55@mail9.example.com"]
    plain = ["lañ.55 and 2023-13-15T10:00", "x" * 3 + " ES91 2100 0418 4502 0005 1333 I am", "a.b.c-" * 20_000]
    same = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    assert [r.text for r in feistel_pii.pseudonymise(same).orderBy("doc_id").collect()] == plain


def test_month_first_dates_stay_different(spark):
    days = spark.range(45000, 46000).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d")).filter("day(d) > 12")
    df = days.select(F.concat_ws(" ", F.date_format("d", "MM/dd/yyyy"), F.date_format("d", "dd/MM/yyyy")).alias("text"))
    found = [p for r in feistel_pii.pseudonymise(df, found="found").collect() for p in r.found]
    assert len(found) == 2 * df.count() and len({p.pseudonym for p in found}) == len(found)


def test_pseudonyms_run_no_python(spark):
    plan = registered_queries()["op4_feistel_pii"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


# --- 5 -----------------------------------------------------------------------------------------


def test_near_duplicates_edge_cases(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp"
    df = rows(spark, base, base.upper(), base + " qq", "x y", "X  y", "x", "quite another text of some length indeed yes")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in odd_sketch.near_duplicates(df, "doc_id", "text", 4, 80).collect()}
    by_id = {k[0]: v for k, v in got.items()}
    assert by_id[0] == by_id[1] == by_id[2] == 0 and by_id[3] == by_id[4] == 3 and by_id[5] == 5 and by_id[6] == 6
    assert by_id[100] == 100 and by_id[101] == 101 and by_id[103] == 103 and by_id[102] == 102 and by_id[None] is None
    kept = odd_sketch.deduplicate(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 3, 5, 6, 100, 101, 102, 102, 103, 104] and ids.count(None) == 1
    assert odd_sketch.near_duplicates(empty(spark), "doc_id", "text").count() == 0


def test_near_duplicates_chain_of_many(spark):
    """A large group in which many pairs are below the threshold, against brute force."""
    random.seed(5)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(random.randint(0, 6)):
            w[random.randrange(len(w))] = f"z{random.randrange(1000)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in odd_sketch.near_duplicates(df, "doc_id", "text", 4, 80).collect()}
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    label = list(range(len(sets)))
    for _ in range(len(sets)):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    assert got == dict(enumerate(label))


def test_two_edited_groups_that_share_buckets(spark):
    """Near copies of two texts that are 0.7 alike: many buckets are shared, and no link joins the groups."""
    random.seed(55)
    base = [f"w{i}" for i in range(400)]
    other = base[:330] + [f"v{i}" for i in range(70)]
    texts = []
    for k in range(160):
        words = list((base, other)[k % 2])
        for _ in range(random.randint(0, 6)):
            words[random.randrange(len(words))] = f"x{random.randrange(10**6)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in odd_sketch.near_duplicates(df, "doc_id", "text", 4, 80).collect()}
    sets = [frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) for w in (t.split() for t in texts)]
    top = list(range(len(texts)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    assert got == {i: root(i) for i in range(len(texts))}


def test_blocks_of_a_bucket_meet_once(spark, monkeypatch):
    """Small blocks: a component fills blocks of its own, and every pair of nodes of two components meets."""
    rows = spark.createDataFrame([(7, n, 0 if n < 50 else n, 1) for n in range(80)], "key long, node long, label long, n long")
    met = odd_sketch._block_pairs(rows, F.lit(1), 8, ["node", "label"], "test").collect()
    pairs = set()
    for r in met:
        a, b = [[(m.node, m.label) for m in side] if side is not None else None for side in (r.members, r.others)]
        found = {tuple(sorted((x[0], y[0]))) for x in a for y in (b or a) if x[1] != y[1]}
        assert not found & pairs and len(a) <= 40
        pairs |= found
    assert len(pairs) == 50 * 30 + 30 * 29 // 2


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for j in (0.95, 0.8):
        both = rng.integers(0, 1 << 62, int(2000 * 2 * j / (1 + j)), dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 62, 2000 - len(both), dtype=np.uint64)]) for _ in "ab")
        x = odd_sketch.odd_sketch(odd_sketch.minima(a)) ^ odd_sketch.odd_sketch(odd_sketch.minima(b))
        apart = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x)
        estimate = 1 + odd_sketch.SKETCH / (4 * odd_sketch._K) * np.log(1 - 2 * apart / odd_sketch.SKETCH)
        assert abs(estimate - j) < 0.12 and apart <= odd_sketch.far_apart(80)


# --- 6 and 8 -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.Pieces.load()


def _library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)


def test_pieces_equal_the_library(spark, pieces):
    library = _library()
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    random.seed(8)
    texts += ["", " ", "  a", "日本 😀\n\n x", "a" * 40, "ab▁c"] + ["".join(random.choices("abeint ▁\n.,0é1", k=40)) for _ in range(300)]
    for t in texts:
        assert pieces.encode(t).tolist() == library.encode(t)
        assert pieces.decode(pieces.encode(t)) == t.replace("▁", " ")


def test_borders_outlive_remembered_stretches(pieces, monkeypatch):
    own = pickle.loads(pickle.dumps(pieces))
    monkeypatch.setattr(sentencepieces, "REMEMBER", 1)
    own.encode("chachauge enchpflich erouenst")
    known = dict(own._stands)
    own.encode("ofonsternd")
    assert known and known.items() <= own._stands.items()


def test_giant_texts_by_chunks(spark, pieces):
    library = _library()
    random.seed(9)
    texts = ["".join(random.choices(alphabet, k=n)) for alphabet in ("abeinst", "abeinst ", "e1n.,\n ") for n in (25, 60, 200)]
    df = rows(spark, *texts)
    done = sentencepieces.encode(df, "text", "found", pieces, chunk=9)
    got = done.collect()
    assert len(got) == df.count() and done.columns == [*df.columns, "found"]
    assert all(r.found == library.encode(r.text or "") for r in got)
    assert sentencepieces.encode(empty(spark), "text", "found", pieces).count() == 0


def test_best_fit_against_brute_force():
    random.seed(2)
    lengths = sorted((random.randint(1, 50) for _ in range(300)), reverse=True)
    rows_, rooms = best_fit_packing.best_fit(lengths, 64), []
    for n in lengths:
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(64 - n)
    assert sorted(64 - sum(lengths[k] for k in m) for m in rows_) == sorted(rooms)
    assert sorted(k for m in rows_ for k in m) == list(range(300))


def test_packing_takes_the_library_s_arrays(monkeypatch):
    """No list of Python numbers is made for each text."""
    import sentencepiece

    class Library:
        def __init__(self, **_):
            pass

        def encode(self, texts, num_threads, return_type):
            assert return_type == "numpy"
            return [np.arange(len(t), dtype=np.int32) for t in texts]

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Library)
    batch = pd.DataFrame({"id": [1, 2], "shard": [0, 0], "text": ["abc", ""]})
    out = next(best_fit_packing._encode(b"")(iter([batch])))
    assert [np.frombuffer(b, "<i4").tolist() for b in out["ids"]] == [[0, 1, 2], []]


def test_packing_is_lossless(spark, pieces):
    df = rows(spark, "hello world", "a b c", "hello world")
    packed = best_fit_packing.pack(df, "doc_id", "text", best_fit_packing.load_model(), length=16).collect()
    parts = {}
    for r in packed:
        ids, pos = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.positions, "<i4")
        assert len(ids) == len(pos) == 16
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, []).append((start, ids[a:b].tolist()))
    for r in df.collect():
        whole = [*pieces.encode(r.text).tolist(), best_fit_packing.END]
        found = sorted(parts[r.doc_id])
        if r.doc_id != 102:
            assert [x for _, p in found for x in p] == whole
        else:       # twice the same row
            assert sum(len(p) for _, p in found) == 2 * len(whole)
    assert best_fit_packing.pack(empty(spark), "doc_id", "text", best_fit_packing.load_model()).count() == 0


# --- 7 -----------------------------------------------------------------------------------------


def test_top_k_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]),
            (8, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [1.0, 1.0]), (9, [0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, v array<double>").withColumn("score", F.lit(1))
    got = pivot_search.pivot_top_k(df, "vec_id", "v", F.col("vec_id").isin(0, 9, 3), 3).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [
        (0, 1, 1, 5.0), (0, 2, 8, 5.0), (0, 3, 2, 3.0), (9, 1, 0, 0.0), (9, 2, 1, 0.0), (9, 3, 2, 0.0)]
    assert pivot_search.pivot_top_k(df.limit(0), "vec_id", "v", F.lit(True), 3).count() == 0


# --- 9 -----------------------------------------------------------------------------------------


def _simhash(text):
    import xxhash

    words = text.translate(str.maketrans("\t\n\x0b\f\r", "     ")).split(" ")
    words = [w for w in words if w]
    n = simhash.SHINGLE
    terms = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    votes, total = [0] * 64, 0
    for t in terms:
        h, w = xxhash.xxh64(t.encode(), seed=42).intdigest(), min(len(t), 64)
        total += w
        for i in range(64):
            votes[i] += w * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def test_simhash_against_brute_force(spark):
    df = rows(spark, "a b c d e", "a b c d e", "one", "Ünï cödé ✓ text  with   gaps")
    got = simhash.edited_prints(df).collect()
    order = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    texts = [r.text or "" for r in order]
    want = []
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        f, e, x = _simhash(t), _simhash(edited), _simhash(after)
        like = lambda a, b: 1 - bin(a ^ b).count("1") / 64
        want.append((order[k].doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, like(f, e), like(f, x)))
    mine = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint & (1 << 64) - 1, r.edited_fingerprint & (1 << 64) - 1, r.near_edited, r.near_next) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)
    assert simhash.edited_prints(empty(spark)).count() == 0


def test_next_row_over_many_buckets(spark):
    ids = random.Random(4).sample(range(10**9), 300)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in simhash.with_next(df, "doc_id", {"text": F.col("text")}, ["text"], width=4).collect()}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_radius_search_is_whole(spark, radius):
    random.seed(radius)
    known = [random.getrandbits(64) for _ in range(40)]
    known += [k ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 5))) for k in known for _ in range(3)]
    signed = sorted({k - (1 << 64) if k >> 63 else k for k in known})
    df = spark.createDataFrame([(k,) for k in signed], "fingerprint long")
    got = {(r.asked, r.known, r.distance) for r in simhash.within_radius(df, df, radius).collect()}
    apart = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert got == {(a, b, apart(a, b)) for a in signed for b in signed if apart(a, b) <= radius}


# --- all ---------------------------------------------------------------------------------------


def test_folds(spark):
    got = spark.range(50).select("id", backoff_lm.fold("id", 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 7 for r in got)


def test_words_match_their_pattern():
    import re

    random.seed(6)
    texts = ["".join(random.choices("aB é\t\n\x0b\x0c\r\x1c\xa0 ", k=30)) for _ in range(200)]
    for t, h in zip(texts, each_text(texts)):
        assert len(h) == len(re.findall(r"[^\x20\x09-\x0D]+", t))
    (a, b, c) = each_text(["Ab c", "ab  C", "ab d"])
    assert a.tolist() == b.tolist() != c.tolist()


@pytest.mark.parametrize("name", sorted(registered_sql()))
def test_query_against_sql(spark, name):
    from oracle import compare, connect

    assert compare(registered_queries()[name](spark, SMALL), connect(SMALL), registered_sql()[name]) is None
