"""The pipeline: every stage on its own input, odd rows included."""

import corpus_pipeline
from test_llm_operators import _library, empty, rows

SMALL = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SMALL)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
        after = spark.createDataFrame(after.collect(), after.schema)
        seen[name] = {r.doc_id for r in after.select("doc_id").collect()}
        assert seen[name] <= {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    start = {r.doc_id: r.text for r in docs.collect()}
    # Every text with a letter has a language here.
    assert seen["language_id"] == {i for i, t in start.items() if any(map(str.isalpha, t))}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, w in ((i, start[i].lower().split()) for i in seen["language_id"])}
    gone = seen["language_id"] - seen["near_dedup"]
    assert gone and all(any(j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets) for i in gone)
    kept = sorted(seen["near_dedup"])
    assert not any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for i in kept for j in kept if i < j)
    assert seen["pii"] == seen["near_dedup"] and seen["mixture"] == seen["sentencepiece"]
    library = _library()
    texts = {r.doc_id: r.text for r in corpus_pipeline.private(spark, docs, SMALL).collect()}
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in before.collect())


def test_stages_on_odd_rows(spark):
    df = rows(spark, "the same words over and over again here", "the same words over and over again here", "call +1 (017) 555-7713 today please")
    for docs in (df, empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SMALL).columns == df.columns, name
            stage(spark, docs, SMALL).count()
        assert corpus_pipeline.ids(spark, docs, SMALL).count() == docs.count()
