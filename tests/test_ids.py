"""Ids of any kind, samples without moving the table, and the numbers that used to be wrong."""

import json

import pytest
from pyspark.sql import functions as F

from colgauge import session
from colgauge.functions.scalars import require_ids
from colgauge.operators import evidence, linkage, metrics, sampling
from colgauge.operators.clean import FeatureSet, snake_name
from colgauge.plans import models, selection
from colgauge.sources import attempts


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).select(
        (F.col("id") % 100).alias("cust"), F.floor(F.col("id") / 100).alias("month"), "id",
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("b"))
    df = df.withColumns({"c": F.col("a") + 0.3 * F.col("b"), "y": (F.col("a") > 0.5).cast("int"), "split": F.lit("train")})
    return df.cache()


def _rho(rows, ids):
    stats, matrix = selection.measure(rows, FeatureSet("y", base=("a", "b"), new=("c",), id_cols=ids))
    return {(r.feature, r.other): (round(r.rho, 9), r.n) for r in matrix.collect()}


def test_composite_and_absent_ids_measure_alike(rows):
    want = _rho(rows, ("id",))
    assert want["c", "a"][1] == 400
    assert _rho(rows, ("cust", "month")) == want and _rho(rows.drop("id", "cust", "month"), ()) == want


def test_repeated_ids_are_refused(rows):
    with pytest.raises(ValueError, match="blank or repeated id"):
        _rho(rows, ("cust",))
    with pytest.raises(ValueError, match="for example"):
        require_ids(rows.select(F.lit(" ").alias("id")))
    assert require_ids(rows, "id") is rows


def test_text_ids_in_metrics(spark):
    data = [("base", "test", i, i % 2, round(i / 7) / 10.0) for i in range(60)]
    df = spark.createDataFrame(data, "variant string, split string, id long, y int, score double")
    text = df.withColumn("id", F.concat(F.lit("c"), F.col("id").cast("string"), F.lit("_20240101_A")))
    a, b = (metrics.evaluate_predictions(d).first() for d in (df, text))
    assert a.adj_gini == pytest.approx(b.adj_gini) and 0 <= b["capture_rate_0.1"] <= 1 and b.accuracy is not None


def test_training_table_layout_and_fill(spark, rows):
    gaps = rows.withColumn("a", F.when(F.col("id") % 5 > 0, F.col("a")))
    features = FeatureSet("y", base=("a", "b"), new=("c",), id_cols=("cust", "month"))
    table = models.training_table(gaps, features)
    variant = models.Variant("base", ("a", "b"))
    fill = models.fill_values(table, variant)
    low = gaps.agg(F.min("a"), F.min("b")).first()
    assert fill == {"a": low[0] - 1, "b": low[1] - 1} and table.count() == table.select("_id").distinct().count() == 400
    fitted = models.fit_variant(table, variant, models.FitOptions(rounds=2, depth=2))
    cases = spark.createDataFrame([(1, None, None)], "id long, a double, b double")
    filled = spark.createDataFrame([(1, fill["a"], fill["b"])], "id long, a double, b double")
    score = lambda d: models.score_cases(d, [fitted], table, ["id"]).first().score
    assert score(cases) == score(filled)


def test_samples_leave_the_table_where_it_is(rows):
    for df in (sampling.uniform_sample(rows, ["id"], 50), sampling.balanced_sample(rows, "y", ["id"], 50),
               sampling.stratified_split(rows, "y", ["id"], name="part")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Exchange hashpartitioning" not in plan and "NestedLoop" not in plan
    assert sampling.uniform_sample(rows, ["id"], 50).count() == 50 and sampling.uniform_sample(rows, ["id"], 9999).count() == 400
    assert sampling.uniform_sample(rows.limit(0), ["id"], 5).count() == 0


def test_window_totals_keep_small_amounts(spark):
    ids = spark.createDataFrame([(1, "k", "2024-02-01"), (2, None, "2024-02-01"), (3, "k", None)], "id int, key string, as_of string")
    ids = ids.withColumn("as_of", F.col("as_of").cast("timestamp"))
    events = spark.createDataFrame(
        [("k", "2020-01-01", float("nan")), ("k", "2021-01-01", 1e17), ("k", "2024-01-20", 10.25)], "key string, at string, amount double"
    ).withColumn("at", F.col("at").cast("timestamp"))
    got = {r.id: (r.n_events_30d, r.amount_sum_30d) for r in linkage.window_totals(
        ids, events, key="key", time="at", measure="amount", windows=[30]).collect()}
    assert got == {1: (1, 10.25), 2: (0, 0.0), 3: (0, 0.0)}


def test_attach_feature_multiplies_nothing(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    feature = spark.createDataFrame([(1, 5), (1, 7), (3, 1)], "id int, f int")
    assert sorted((r.id, r.f) for r in linkage.attach_feature(rows, feature).collect() if r.f) == [(1, 7), (1, 7)]
    two = spark.createDataFrame([(1, 5, 9), (1, 7, 2)], "id int, f int, g int")
    assert {(r.f, r.g) for r in linkage.attach_feature(rows, two).collect() if r.f} == {(7, 2)}


def test_runs_named_by_text(spark):
    items = spark.createDataFrame([("run_b", 1, False), ("run_a", 1, False), ("run_a", 2, True), ("run_b", 2, False)],
                                  "run string, round int, repeats boolean")
    got = {(r.run, r.round): r.cumulative_new for r in evidence.novelty_per_round(items).collect()}
    assert got == {("run_a", 1): 1, ("run_a", 2): 1, ("run_b", 1): 2, ("run_b", 2): 3}


def test_approvals_and_whole_details(spark, tmp_path):
    long = "why " * 200
    events = [
        {"event": "run_started", "run_id": "r", "ts": 0.0, "direction": "d", "params": {"model": "m"}},
        {"event": "tool_started", "run_id": "r", "ts": 1.0, "call_id": "c1", "args": json.dumps({"source_name": "s1"})},
        {"event": "tool_completed", "run_id": "r", "ts": 2.0, "call_id": "c1", "tool": "propose_new_data",
         "output": json.dumps({"ok": True, "approved": False, "user_note": long})},
        {"event": "tool_completed", "run_id": "r", "ts": 3.0, "call_id": "c2", "tool": "screen_request", "output": json.dumps({"ok": True, "approved": True})},
        {"event": "tool_completed", "run_id": "r", "ts": 4.0, "call_id": "c3", "tool": "other", "output": json.dumps({"approved": True})},
    ]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(map(json.dumps, events)))
    got = attempts.read_attempt_log(spark, str(path)).orderBy("ts").collect()
    assert [(r.kind, r.name, r.outcome, r.scope, r.tool, r.direction, r.model) for r in got] == [
        ("request", "s1", "rejected", "beyond_scope", "propose_new_data", "d", "m"),
        ("request", None, "approved", "in_scope", "screen_request", "d", "m")]
    assert got[0].detail == long.strip()


def test_challenges_and_engines(spark, tmp_path):
    events = [
        {"event": "run_started", "run_id": "r", "ts": 0.0, "direction": "d", "params": {"model": "m", "engine": "e"}},
        {"event": "data_request", "run_id": "r", "ts": 1.0, "intent": "i1", "source_name": "s1", "scope": "in_scope"},
        {"event": "request_challenged", "run_id": "r", "ts": 2.0, "intent": "i1", "status": "open", "verdict": "weak", "reasoning": "too little"},
        {"event": "request_challenged", "run_id": "r", "ts": 3.0, "intent": "i1", "status": "kept", "verdict": "sound", "reasoning": "enough"},
        {"event": "feature_screened", "run_id": "r", "ts": 4.0, "intent": "i2", "name": "f", "verified": True},
    ]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(map(json.dumps, events)))
    got = attempts.read_attempt_log(spark, str(path)).orderBy("ts").collect()
    assert [(r.kind, r.outcome, r.verdict, r.detail, r.engine) for r in got] == [
        ("request", "kept", "sound", "enough", "e"), ("feature", "verified", None, "", "e")]


def test_names():
    assert snake_name(" ROA(C) % & more__x ") == "roa_c_pct_and_more_x"


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):  # noqa: N802
            return None

    for master in ("spark://host:7077", "local-cluster[3,2,1000]", "yarn"):
        fake = type("S", (), {"conf": Conf(), "sparkContext": Context(master)})()
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(fake)
