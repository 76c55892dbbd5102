"""Windows, n-th events, sliced links, families and reports against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from colgauge.operators import blocks, binning, evidence, linkage, sampling
from colgauge.operators.order import quantiles

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def history(spark):
    """One busy key, ties of an instant, events exactly a window apart, and rows without key or time."""
    rng = random.Random(9)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", START + timedelta(hours=12 * rng.randint(0, 400)), float(i % 17)) for i in range(600)]
    rows += [(1000, None, START, 1.0), (1001, "hot", None, 1.0)]
    return rows, spark.createDataFrame(rows, "event_id long, who string, at timestamp, v double")


def test_rolling_totals(history):
    rows, df = history
    got = {r.event_id: (r.n_events, r.v_sum) for r in linkage.rolling_totals(df, key="who", time="at", measure="v", days=7, id_col="event_id").collect()}
    assert got.pop(1000) == got.pop(1001) == (None, None)
    for i, who, at, _ in rows[:600]:
        near = [v for _, w, t, v in rows[:600] if w == who and at - timedelta(days=7) <= t <= at]
        assert got[i] == (len(near), pytest.approx(sum(near)))


@pytest.mark.parametrize("rule", [linkage.STRICT, linkage.INCLUSIVE])
def test_nth_event_before(spark, history, rule):
    rows, df = history
    asked = [(i, "hot" if i % 2 else "k3", START + timedelta(hours=12 * i)) for i in range(0, 420, 7)] + [(900, None, START), (901, "hot", None), (902, "none", START)]
    ids = spark.createDataFrame(asked, "id long, who string, as_of timestamp")
    for n in (1, 3):
        found = linkage.nth_event_before(ids, df, n, key="who", time="at", tie="event_id", payload=["v"], rule=rule)
        got = {r.id: (r.event_id, r.v) for r in found.collect()}
        want = {}
        for i, who, at in asked:
            past = sorted(((t, e, v) for e, w, t, v in rows if None not in (w, t, who, at) and w == who and (t < at or (t == at and rule == linkage.INCLUSIVE))), reverse=True)
            if len(past) >= n:
                want[i] = past[n - 1][1:]
        assert got == want
    assert "SortMergeJoin" not in found._jdf.queryExecution().optimizedPlan().toString() and found.columns == ["id", "as_of", "at", "event_id", "v"]


def test_sliced_links_are_the_same_pairs(spark, history):
    _, df = history
    ids = spark.createDataFrame([(i, "hot" if i % 2 else "k3", START + timedelta(days=i)) for i in range(0, 210, 9)], "id long, who string, as_of timestamp")
    pairs = lambda **more: sorted((r.id, r.event_id) for r in linkage.link_point_in_time(ids, df, key="who", time="at", **more).collect())
    assert pairs(slice_rows=25) == pairs() and len(pairs()) > 1000
    base, events = linkage._sliced(ids, df.filter("at IS NOT NULL"), ["who"], "at", 25)
    assert events.filter("who = 'hot'").groupBy("_slice").count().count() > 10 and base.filter("who = 'hot'").count() > 100


def test_bounded_source_reaches_the_scan(spark, history, tmp_path):
    _, df = history
    df.write.parquet(str(tmp_path / "events"))
    ids = spark.createDataFrame([(1, START + timedelta(days=90))], "id long, as_of timestamp")
    kept = linkage.bounded_source(spark.read.parquet(str(tmp_path / "events")), ids, "at", days=30)
    low, high = kept.agg(F.min("at"), F.max("at")).first()
    assert low >= START + timedelta(days=60) and high < START + timedelta(days=90)
    assert "at" in kept._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_inherited_evidence(spark):
    records = spark.createDataFrame(
        [("a", None, 1, 0, 9, 9), ("b", "a", 0, 1, 9, 9), ("c", "gone", 0, 0, 2, 1), ("d", "c", 1, 1, 9, None), ("e", "lost", None, 3, None, 4)],
        "key string, same_as string, signal int, none int, was int, wasnt int")
    got = {r.key: (r.family, r.signal, r.none) for r in evidence.pool_families(records, inherited_signal="was", inherited_none="wasnt").collect()}
    assert got == {"a": ("a", 1, 1), "b": ("a", 1, 1), "c": ("c", 3, 2), "d": ("c", 3, 2), "e": ("e", 0, 7)}


def test_head_report_keeps_pinned_rows(spark):
    df = spark.createDataFrame([(i, 100 - i, i in (1, 7, 9)) for i in range(12)], "id int, score int, new boolean")
    got = [r.id for r in sampling.head_report(df, "id", [F.desc("score")], 3, F.col("new")).collect()]
    assert sorted(got) == [0, 1, 2, 7, 9]


def test_block_table_gives_what_the_rows_give(spark):
    rng = random.Random(4)
    rows = [(("train", "valid", "test")[i % 3], None if i % 11 == 0 else float(rng.randint(0, 40)), rng.gauss(0, 1) * 10 ** rng.randint(-3, 3), i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "split string, a double, b double, y int").withColumn("gone", F.lit(None).cast("double"))
    table = blocks.value_blocks(df, ["a", "b", "gone"], "split", "y")
    train = df.filter("split = 'train'")
    exact = {r.feature: r["values"] for r in quantiles(train, ["a", "b"], binning.interior(10)).collect()}
    assert {c: e for c, e in blocks.block_edges(table, ["a", "b"], 10).items()} == {c: sorted(set(v)) for c, v in exact.items()}
    psi = lambda out: {(r.feature, r.split): r.psi and round(r.psi, 12) for r in out.collect()}
    assert psi(blocks.block_psi(table, ["a", "b", "gone"], "split", "train")) == psi(binning.psi(df, ["a", "b", "gone"], "split", "train"))
    assert table.agg(F.sum("n"), F.sum("pos")).first() == (9000, 4500)


def test_joint_counts_hold_nulls_and_new_codes(spark):
    rng = random.Random(6)
    rows = [(rng.choice([0, 1, 5, None]), rng.choice([-9999, 0, 1]), rng.randint(0, 30)) for _ in range(5000)]
    codes = spark.createDataFrame(rows, "a int, b int, c int")
    got = {(r.feature, r.other, r.a, r.b): r.n for r in binning.joint_counts(codes, [("a", "b"), ("c", "b"), ("a", "a")]).collect()}
    want = {}
    for a, b, c in rows:
        for key in (("a", "b", a, b), ("c", "b", c, b), ("a", "a", a, a)):
            want[key] = want.get(key, 0) + 1
    assert got == want
    assert binning.joint_counts(codes.limit(0), [("a", "b")]).count() == 0
