"""Token counts, the filter audit and vector codes: the library, brute force, edge cases."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colgauge.llm import filter_audit, token_counts, vector_codes
from colgauge.llm.catalog import registered_queries
from test_llm_operators import LONG, SMALL, empty, rows

# --- 11 ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def merges():
    return token_counts.Merges.load()


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))


def _lengths(tokenizer, texts):
    return [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


PIECES = ["'", "'s", "'re", "'ve", " ", "  ", "\n", "\t", "a", "ll", "d", "é", "1", "²", "!", "?", "<|endoftext|>", "<|end", " ", "　",
          "字", "😀", "́", "\x1c", "\x85", "ab", "the", " the", "'S", "s", "t", "aaaa", "    ", "࢏", "꟎"]


@pytest.mark.parametrize("piece", [1 << 20, 23])
def test_counts_equal_the_librarys(monkeypatch, merges, tokenizer, piece):
    monkeypatch.setattr(token_counts, "PIECE", piece)
    random.seed(piece)
    texts = ["".join(random.choices(PIECES, k=random.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(chr(random.choice([random.randrange(0xD800), random.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(500)]
    texts += ["a" * n for n in range(1, 60)] + [" " * n for n in range(1, 60)] + ["=-" * 50, "", LONG * 3, "ab" * 3000]
    assert token_counts.count_texts(merges, merges.classes(), texts).tolist() == _lengths(tokenizer, texts)


def test_equal_hashes_of_different_pre_tokens_are_not_taken_together(monkeypatch, merges, tokenizer):
    monkeypatch.setattr(token_counts, "mix", lambda x: np.zeros_like(np.asarray(x, np.uint64)))
    texts = ["some plain words", "and others"]
    assert token_counts.count_texts(merges, merges.classes(), texts).tolist() == _lengths(tokenizer, texts)


def test_a_vocabulary_out_of_order_is_refused():
    letters = {chr(b if 33 <= b <= 126 else 256 + b): b for b in range(256)}
    spec = {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2, "abb": 3} | letters, "merges": [["ab", "b"], ["a", "b"]]},
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    with pytest.raises(ValueError, match="before"):
        token_counts.Merges(spec)


def test_token_counts_of_odd_rows(spark, merges, tokenizer):
    df = rows(spark, "a b c", "<|endoftext|>")
    got = token_counts.count_tokens(df, "text", "n", merges)
    assert got.columns == df.columns
    found = got.collect()
    assert len(found) == 9 and [r.n for r in found] == _lengths(tokenizer, [r.text or "" for r in found])
    assert token_counts.count_tokens(empty(spark), "text", "n", merges).count() == 0


def test_token_count_query(spark, tokenizer):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = registered_queries()["op11_rank_merge_counts"](spark, SMALL).collect()
    want = dict(zip(texts, _lengths(tokenizer, list(texts.values()))))
    assert len(got) == len(texts) and all(r.n_tokens == want[r.doc_id] and r.over_limit == (r.n_tokens > 512) for r in got)
    assert all(r.n_bytes == len(texts[r.doc_id].encode()) for r in got)


# --- 12 ----------------------------------------------------------------------------------------


def _audit_by_hand(docs, labels):
    def fails(doc_id, text):
        words, out = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w], ""
        out += "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        out += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        return out + "E" * any(i is not None and doc_id is not None and i < doc_id and (t or "") == text for i, t, _ in docs)

    judged = [(part or "", fails(i, text or ""), labels.get(i, (0, 0))) for i, text, part in docs]
    out = {}
    for part in {p for p, _, _ in judged}:
        mine = [(f, flags) for p, f, flags in judged if p == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                removed[x] += len(gone)
                earlier = sum(x in f and any(y in f for y in order[: step - 1]) for f, _ in mine)
                out[part, order, step] = [len(left), len(gone), earlier, sum(f == x for f, _ in mine), sum(g[0] for _, g in gone), sum(g[1] for _, g in gone), x]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = removed[out[key][-1]]
    return out


def test_filter_audit_against_brute_force(spark):
    random.seed(12)
    texts = ["a b", "A#", LONG, "x " * 300, " ".join(map(str, range(250))), "", None, "ONE " + " ".join(map(str, range(220))), " \t\n "]
    docs = [(i if random.random() < 0.9 else None, random.choice(texts), random.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [docs[0], docs[5], (3, "other text of a repeated id", "en")]
    labels = [(i, random.randint(0, 1), random.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1)]
    known = {}
    for i, q, t in labels:
        if i is not None:
            a, b = known.get(i, (0, 0))
            known[i] = (max(a, int(q == 1)), max(b, int(t == 1)))
    df = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, lang string, part long, mask string")
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "doc_id", "text", "lang").collect()
    want = _audit_by_hand(docs, known)
    assert len(got) == len(want) == 600 * 3
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step]


def test_filter_audit_of_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(rows(spark), labels, "doc_id", "text", "lang").collect()
    assert len(got) == 600 * 3 and {r.part for r in got} == {"", "en", "de"} and not any(r.good_lost or r.toxic_lost for r in got)
    assert filter_audit.audit(empty(spark), labels, "doc_id", "text", "lang").count() == 0


def test_packed_fields_do_not_run_over():
    largest = (1 << 63) - 1
    removed, redundant = filter_audit.packed(31)
    assert (filter_audit.unpacked(removed * largest)[:, 0] == largest).all() and not filter_audit.unpacked(removed * largest)[:, 1:].any()
    assert (filter_audit.unpacked(redundant * largest)[:, 1:] == largest).all()


# --- 13 ----------------------------------------------------------------------------------------


def _nearest_by_hand(x, book):
    far = [sum((int(a) - int(b)) ** 2 for a, b in zip(x, e)) for e in book]
    return far.index(min(far)), min(far)


@pytest.mark.parametrize("size, spread", [(4, 3), (3, 1000), (2, 1 << 40), (1, (1 << 63) - 1)])
def test_slices_find_the_nearest_entry(size, spread):
    rng = random.Random(size)
    x = np.array([[rng.randint(-spread, spread) for _ in range(size)] for _ in range(400)], np.int64)
    books = x[:16].reshape(1, 16, size)
    index, far = vector_codes.nearest_entries(x.reshape(-1, 1, size), books)
    assert [(int(i), int(f)) for i, f in zip(index[:, 0], far[:, 0])] == [_nearest_by_hand(v, books[0]) for v in x]


def test_masks_hold_every_entry_that_can_be_nearest_and_leave_others_out():
    rng = np.random.default_rng(3)
    entries = rng.integers(-1000, 1000, (16, 4))
    x = entries[rng.integers(0, 16, 500)] + rng.integers(-30, 30, (500, 4))
    masks = vector_codes.Slices(entries).candidates(x)
    held = np.bitwise_count(masks)
    assert held.min() >= 1 and held.mean() < 4
    with pytest.raises(ValueError):
        vector_codes.Slices(np.zeros((65, 2), np.int64))


def _codes_by_hand(vectors, parts, entries, rounds, scale):
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = -(-max(len(v) for _, v in kept) // parts)
    whole = [[max(-(1 << 63), min((1 << 63) - 1, math.floor(scale * c))) for c in v] + [0] * (parts * size - len(v)) for _, v in kept]
    cut = [[w[p * size : (p + 1) * size] for p in range(parts)] for w in whole]
    start = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in start] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(_nearest_by_hand(c[p], books[p])[0], []).append(c[p])
            books[p] = [[sum(col) // len(members[e]) for col in zip(*members[e])] if e in members else entry for e, entry in enumerate(books[p])]
    found = [[_nearest_by_hand(c[p], books[p]) for p in range(parts)] for c in cut]
    return books, [(kept[k][0], "".join(f"{i:02x}" for i, _ in f), sum(d for _, d in f)) for k, f in enumerate(found)]


@pytest.mark.parametrize("reach", [1.0, 2e5, 1e9])
def test_codes_against_brute_force(spark, reach):
    rng = random.Random(7)
    vectors = [(i if i % 9 else None, [rng.uniform(-reach, reach) for _ in range(6)]) for i in range(150)]
    vectors += [(3, vectors[3][1]), (200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, []), (205, [reach])]
    df = spark.createDataFrame([(i, v, "kept", 5) for i, v in vectors], "vec_id long, embedding array<double>, code string, error int")
    books = vector_codes.fit(df, "vec_id", "embedding", parts=4, entries=5, rounds=3)
    want_books, want = _codes_by_hand(vectors, 4, 5, 3, vector_codes.SCALE)
    assert books.tolist() == want_books
    got = vector_codes.compress(df, "embedding", books)
    assert set(got.columns) == set(df.columns) and len(got.columns) == 4
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    fits = lambda e: e if e < 1 << 63 else None
    assert sorted([(r.vec_id, r.code, r.error) for r in got.collect()], key=order) == sorted([(i, c, fits(e)) for i, c, e in want], key=order)
    text = ",".join(str(x) for book in want_books for entry in book for x in entry)
    assert vector_codes.digest(books) == hashlib.sha256(text.encode()).hexdigest()


def test_codes_of_huge_components_and_small_tables(spark):
    huge = spark.createDataFrame([(1, [1e300, -1e300]), (2, [1e17, 3.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    books = vector_codes.fit(huge, "vec_id", "embedding", parts=2, entries=2, rounds=1)
    want_books, want = _codes_by_hand([(r.vec_id, r.embedding) for r in huge.collect()], 2, 2, 1, vector_codes.SCALE)
    assert books.tolist() == want_books
    assert [(r.vec_id, r.code, r.error) for r in vector_codes.compress(huge, "embedding", books).orderBy("vec_id").collect()] == [
        (i, c, e if e < 1 << 63 else None) for i, c, e in want]
    none = spark.createDataFrame([(1, None), (2, [float("nan")])], "vec_id long, embedding array<double>")
    assert vector_codes.fit(none, "vec_id", "embedding") is None
    one = spark.createDataFrame([(None, [0.5] * 8)], "vec_id long, embedding array<float>")
    books = vector_codes.fit(one, "vec_id", "embedding")
    assert [(r.code, r.error) for r in vector_codes.compress(one, "embedding", books).collect()] == [("00" * 8, 0)]


def test_errors_by_label(spark):
    coded = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3, f"{i:02x}", i) for i in range(90)], "vec_id long, label int, code string, error long")
    got = {r.vec_id: r.label_error for r in vector_codes.with_group_error(coded, "label").collect()}
    assert got == {i: sum(j for j in range(90) if j % 3 == i % 3) for i in range(90)}


def test_code_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registered_queries()["op13_slice_mask_codes"](spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
