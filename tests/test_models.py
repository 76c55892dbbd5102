"""Selection, verdict gates and whole runs on data whose answer is known."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colgauge.operators import metrics, ranks
from colgauge.operators.clean import FeatureSet
from colgauge.plans import models, screening, selection, validation, verdict


@pytest.fixture(scope="module")
def known(spark):
    """Two signals in the candidates, a copy of an incumbent, and noise."""
    rng = np.random.default_rng(7)
    n = 3000
    old = rng.normal(size=(n, 3))
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = (old[:, 0] + 1.5 * a + 1.2 * b + rng.normal(size=n) > 0.8).astype(int)
    split = np.array(["train", "valid", "test"])[np.searchsorted([0.6, 0.8], rng.random(n))]
    frame = pd.DataFrame({
        "id": range(n), "split": split, "y": y, "old_0": old[:, 0], "old_1": old[:, 1], "old_2": old[:, 2], "new_a": a,
        "new_b": np.where(rng.random(n) < 0.08, -9999, b), "new_copy": old[:, 0] * 2 + rng.normal(size=n) * 0.01, "new_noise": rng.normal(size=n)})
    return spark.createDataFrame(frame)


FEATURES = FeatureSet("y", ("old_0", "old_1", "old_2"), ("new_a", "new_b", "new_copy", "new_noise"), ("id",))
OPTIONS = validation.RunOptions(
    fit=models.FitOptions(rounds=12, depth=3), selection=selection.SelectionOptions(target_min_abs=0.05, max_abs_rho=0.9))


@pytest.fixture(scope="module")
def run(known):
    return validation.validate(known, FEATURES, OPTIONS)


def test_known_truth(run):
    kept = {r.feature: (r.kept, r.decided_by) for r in run.selected.collect()}
    assert kept["new_a"][0] and kept["new_b"][0]
    assert kept["new_copy"] == (False, "redundancy screen") and kept["new_noise"] == (False, "signal screen")
    gain = {r.variant: r.gini_gain_test for r in run.comparison.collect()}
    assert gain["base_plus_new"] > 0.05 and gain["loi__new_a"] > 0.05 and abs(gain["loi__new_copy"]) < 0.05
    judged = {r.feature: r for r in run.verdicts.collect()}
    assert judged["new_a"].verdict == "PASS" and judged["new_copy"].failed_at == "feature selection"
    batch = run.batch.first()
    assert batch.verdict == "KEEP" and set(batch.passed) == {"new_a", "new_b"}
    assert run.new_share.filter("variant = 'base_plus_new'").first().new_share > 0.3


def test_together_and_results(known, run):
    together = validation.evaluate_together(run, known, "passing", OPTIONS)
    assert {r.variant for r in together.collect()} == {"base", "combo__all_passing"}


def test_results_explain_every_model(known, run):
    """Each variant's row says where its candidates stand in its own model, and where the column nearest to its feature does."""
    clean = known.withColumn("new_b", F.when(F.col("new_b") != -9999, F.col("new_b")))
    out = validation.evaluation_results(run, ranks.feature_stats(clean, "id", FEATURES.new, FEATURES.base, "y"))
    got = {r.variant: r for r in out.collect()}
    assert set(got) == {"base_plus_new", *[f"loi__{f}" for f in FEATURES.new]}
    of = {f.variant.name: f for f in run.fits}
    for name, r in got.items():
        alone = models.mean_attribution([of[name]], run.table).collect()
        place = {a.feature: i + 1 for i, a in enumerate(sorted(alone, key=lambda a: (-a.mean_abs_attr, a.feature)))}
        share = {a.feature: a.attr_share for a in alone}
        new = sorted((place[f], f) for f in of[name].variant.features if f in FEATURES.new)
        assert [(x.rank, x.feature, x.of) for x in r.new_ranks] == [(k, f, len(place)) for k, f in new]
        assert [x.share for x in r.new_ranks] == pytest.approx([share[f] for _, f in new])
        if r.feature:
            assert r.nearest_rank_in_variant == place[r.max_corr_with] and r.nearest_rank_in_base is not None
    assert got["loi__new_copy"].max_corr_with == "old_0" and got["loi__new_a"].new_ranks[0].rank == 1


def test_together_fits_nothing_twice(known, run, monkeypatch):
    """All candidates together are the run's own model of all candidates."""
    fresh = {r.variant: r.asDict() for r in validation.evaluate_together(replace(run, fits=[]), known, "all", OPTIONS).collect()}
    monkeypatch.setattr(models, "fit_variant", lambda *_: pytest.fail("fitted again"))
    again = {r.variant: r.asDict() for r in validation.evaluate_together(run, known, "all", OPTIONS).collect()}
    assert set(again) == {"base", "combo__all_new"} == set(fresh)
    for name, row in fresh.items():
        assert again[name] == {k: v if isinstance(v, str) else pytest.approx(v) for k, v in row.items()}


def test_a_model_is_read_as_sql(run, monkeypatch):
    """The sum of the trees as SQL is what Spark's model says of every row; a larger model is scored by Spark's own."""
    from pyspark.ml.functions import vector_to_array

    fitted = next(f for f in run.fits if f.variant.name == "base_plus_new")
    model = fitted.model.transform(models._vectors(run.table, fitted.variant.features)).select(
        F.col("_id").alias("id"), vector_to_array("probability")[1].alias("p"), vector_to_array("rawPrediction")[1].alias("m"))
    both = models.with_margin(fitted, run.table).withColumnRenamed("_id", "id").join(model, "id").join(
        fitted.predictions.select("id", "score"), "id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("m") - F.col("_margin"))).alias("m"), F.max(F.abs(F.col("p") - F.col("score"))).alias("p")).first()
    assert fitted.margin and both.n == 3000 and both.m < 1e-12 and both.p < 1e-12
    monkeypatch.setattr(models, "WRITTEN", 3)
    large = replace(fitted, margin=None)
    assert large.margin is None
    a, b = (models.mean_attribution([f], run.table).orderBy("feature").collect() for f in (fitted, large))
    assert [r.feature for r in a] == [r.feature for r in b] and [r.mean_abs_attr for r in a] == pytest.approx([r.mean_abs_attr for r in b])


def test_rows_are_scored_where_they_are_read(run):
    """A run keeps no table of a row for each variant and model row, and as few cells as there are scores."""
    assert all("laid-out-" in path for path in run.predictions.inputFiles())
    cells = metrics.score_cells(run.predictions)
    assert cells.agg(F.sum("rows")).first()[0] == 3000 * len(run.fits)
    assert cells.count() == run.predictions.select("variant", "split", "score", "y").distinct().count()


def test_ids_in_two_splits(spark):
    from colgauge.operators.linkage import disjoint_splits

    rows = [(1, "a", "train"), (1, "a", "test"), (2, "a", "train"), (2, "b", "test"), (3, None, "valid"), (3, None, "test"), (3, None, "train"), (4, "a", None)]
    got = {(r.left_split, r.right_split): (r.shared_ids, r.example) for r in disjoint_splits(spark.createDataFrame(rows, "k int, m string, split string"), ["k", "m"]).collect()}
    assert got == {("test", "train"): (2, "1|a"), ("test", "valid"): (1, "3"), ("train", "valid"): (1, "3")}


def test_cascade_stops_where_it_should(spark, known):
    rows = known.filter("split <> 'test'").withColumn("ready", F.when(F.col("new_b") != -9999, F.col("new_b"))).withColumn("flat", F.lit(1.0))
    base = list(FEATURES.base)
    options = screening.ScreenOptions(fit=models.FitOptions(rounds=8, depth=3))
    stage = lambda f, **k: screening.check_cascade(rows, "id", f, base, "y", options=options, **k).first()
    assert stage("new_copy").stage == "C1"
    assert stage("ready", earlier=["ready"]).stage == "C0"
    passed = stage("ready")
    assert passed.stage == "passed" and passed.gini_gain > 0
    assert stage("flat").stage == "gate"


def test_candidates_share_the_base_fit(known, monkeypatch):
    """Two candidates of one table are three fits, with the gains of four."""
    rows = known.filter("split <> 'test'").withColumn("new_b", F.when(F.col("new_b") != -9999, F.col("new_b")))
    base, fit = list(FEATURES.base), models.FitOptions(rounds=4, depth=3)
    table = models.training_table(rows, FEATURES)
    alone = {f: models.screen_gain(table, base, f, fit).first().gini_gain for f in ("new_a", "new_b")}
    plain, fitted = models.fit_variant, []
    monkeypatch.setattr(models, "fit_variant", lambda t, v, o: fitted.append(v.name) or plain(t, v, o))
    shared = models.screen_base(table, base, fit)
    options = screening.ScreenOptions(fit=fit)
    for f in alone:
        got = screening.check_cascade(rows, "id", f, base, "y", options=options, table=table, fitted_base=shared).first()
        assert got.stage == "passed" and got.gini_gain == pytest.approx(alone[f])
    assert fitted == ["base", "with", "with"]


def test_variants():
    names = [v.name for v in models.build_variants(["a"], ["x", "z"], ("base", "base_plus_new", "new_only", "leave_one_in", "leave_one_out", "base"), {"both": ["x", "z"], "odd": ["q"]})]
    assert names == ["base", "base_plus_new", "new_only", "loi__x", "loi__z", "loo__x", "loo__z", "combo__both"]
    assert models.build_variants([], [], ("base",)) == []


GATES = "feature string, quality_passed boolean, kept boolean, decided_by string, reason string, gain double, gain_valid double, attr_rank int, n_ranked long"
CASES = [
    ("good", True, True, None, None, 0.02, 0.02, 1, 10), ("dirty", False, True, None, None, 0.02, 0.02, 1, 10),
    ("dropped", True, False, "signal screen", "weak", 0.0, 0.0, 9, 10), ("flat", True, True, None, None, 0.004, 0.02, 1, 10),
    ("edge", True, True, None, None, 0.005, 0.0, 5, 10), ("low", True, True, None, None, 0.02, 0.02, 6, 10), ("unseen", None, True, None, None, None, None, None, None),
]


@pytest.mark.parametrize("enforce", [True, False])
def test_each_gate_can_fail(spark, enforce):
    rows = spark.createDataFrame(CASES, GATES)
    got = {r.feature: r for r in verdict.candidate_verdicts(rows, verdict.VerdictOptions(enforce=enforce)).collect()}
    assert {f: r.failed_at for f, r in got.items()} == {
        "good": "", "dirty": "data quality", "dropped": "feature selection", "flat": "gini gain", "edge": "", "low": "attribution rank", "unseen": ""}
    assert got["dropped"].gini_gain == ("not reached" if enforce else "FAIL")
    assert got["dropped"].n_gates_failed == (1 if enforce else 3)
    assert got["unseen"].gini_gain == "not evaluable" and got["unseen"].verdict == "PASS"
    strict = verdict.candidate_verdicts(rows, verdict.VerdictOptions(require_valid_too=True)).filter("feature = 'edge'").first()
    assert strict.failed_at == "gini gain"


def test_batch_names_the_worst_gate(spark):
    rows = spark.createDataFrame([c for c in CASES if c[0] in ("dirty", "flat", "low")] + [("flat2", True, True, None, None, 0.0, 0.0, 1, 10)], GATES)
    batch = verdict.decide_batch(verdict.candidate_verdicts(rows)).first()
    assert (batch.verdict, batch.worst_gate, batch.n_passed) == ("TRY A NEW BATCH", "gini gain", 0)


def test_mrmr_order(known):
    options = selection.SelectionOptions(ranking="mrmr", bins=10)
    rows = known.withColumn("new_b", F.when(F.col("new_b") != -9999, F.col("new_b")))
    stats, matrix = selection.measure(rows, FEATURES, options)
    order = [r.feature for r in selection.select_features(stats, matrix, FEATURES, options).orderBy("place").collect()]
    assert order[0] in ("new_a", "new_b") and order[-1] == "new_copy"
