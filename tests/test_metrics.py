"""Ranking metrics: perfect, inverted and degenerate orders, and ties split exactly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colgauge.operators import cases, metrics, order


def frame(spark, y, score):
    rows = [("v", "test", i, None if a is None else float(a), float(s)) for i, (a, s) in enumerate(zip(y, score))]
    return spark.createDataFrame(rows, "variant string, split string, id long, y double, score double")


def test_perfect_and_inverted(spark):
    y = np.random.default_rng(1).gamma(2, size=500)
    assert metrics.adjusted_gini(frame(spark, y, y)).first().adj_gini == pytest.approx(1)
    assert metrics.adjusted_gini(frame(spark, y, -y)).first().adj_gini == pytest.approx(-1)
    out = metrics.evaluate_predictions(frame(spark, y, y), [0.1, 1.0]).first()
    assert out["capture_rate_1"] == pytest.approx(1) and out.accuracy == pytest.approx(1)
    assert out["capture_rate_0.1"] == pytest.approx(np.sort(y)[::-1][:50].sum() / y.sum())


@pytest.mark.parametrize("y", [[0, 0, 0, 0], [None, None]])
def test_degenerate_is_null(spark, y):
    out = metrics.evaluate_predictions(frame(spark, y, range(len(y))), [0.5]).first()
    assert out.adj_gini is None and out.accuracy is None and out["capture_rate_0.5"] is None and out.n_rows == len(y)


def test_coded_outcomes_leave_accuracy(spark):
    good = metrics.calibration_accuracy(frame(spark, [1, 2, 3, 4], [1, 2, 3, 4]), bins=2).first().accuracy
    coded = metrics.calibration_accuracy(frame(spark, [1, 2, 3, 4, -9999], [1, 2, 3, 4, 9]), bins=2).first().accuracy
    assert good == pytest.approx(1) and coded == pytest.approx(1)


def test_ties_split_by_id_or_shared(spark):
    y = [1.0 if i % 4 == 0 else 0.0 for i in range(1000)]
    tied = frame(spark, y, [2.0] * 100 + [1.0] * 900)
    by_id = metrics.capture_rate(tied, [0.5]).first()["capture_rate_0.5"]
    assert by_id == pytest.approx(sum(y[:500]) / sum(y))
    shared = metrics.capture_rate(tied, [0.5], tie=None).first()["capture_rate_0.5"]
    assert shared == pytest.approx((25 + 400 / 900 * 225) / 250)


def test_brute_force_with_many_ties(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 2000), rng.integers(0, 7, 2000)
    order = sorted(range(2000), key=lambda i: (-s[i], i))
    out = metrics.evaluate_predictions(frame(spark, y, s), [0.03], bins=7).first()
    assert out["capture_rate_0.03"] == pytest.approx(sum(y[i] for i in order[:60]) / y.sum())
    groups = [[i for r, i in enumerate(order) if 7 * r // 2000 == g] for g in range(7)]
    gap = sum(abs(np.mean(s[g]) - np.mean(y[g])) for g in groups)
    assert out.accuracy == pytest.approx(1 - gap / sum(np.mean(y[g]) for g in groups))


def test_flag_outcomes(spark):
    df = spark.createDataFrame(
        [("a", 1, False, True), ("a", 2, True, False), ("b", 1, True, False), ("c", 1, False, False), ("d", 1, True, True)],
        "k string, day int, f0 boolean, f1 boolean")
    from pyspark.sql import functions as F

    df = df.withColumn("t", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)))
    seq = cases.sequence_cases(df, "k", "t", "day")
    got = {r.k: (r.outcome, r.rows_sooner, r.days_sooner) for r in cases.flag_outcomes(
        cases.first_flags(seq, "k", "t", {"base": F.col("f0"), "variant": F.col("f1")})).collect()}
    assert got == {"a": ("earlier", 1, 1), "b": ("only_base", None, None), "c": ("neither", None, None), "d": ("same", 0, 0)}


def test_blocks_of_a_group_stay_apart_where_medians_are_looked_up(spark, monkeypatch):
    """The medians, one row for each group, come to the blocks; the blocks are not dealt by group."""
    from colgauge.operators import ranks

    plans = []

    def stop(filled, *_):
        plans.append(filled._jdf.queryExecution().executedPlan().toString())
        raise StopIteration

    monkeypatch.setattr(ranks, "running_totals", stop)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).selectExpr("id % 2 AS y", "if(id % 7 = 0, NULL, id) AS a", "'all' AS split")
        with pytest.raises(StopIteration):
            ranks.variable_gini(df, ["a"], "y", by=["split"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[0]


def test_tied_rows_are_counted_before_they_are_put_in_order(spark, monkeypatch):
    """A cut inside one score of all rows puts few rows in order, and takes the rows of the first ids."""
    n, ordered = 50_000, []
    plain = metrics.running_totals

    def watched(blocks, group, order, sums, **given):
        if order == "_tie":
            ordered.append(blocks.count())
        return plain(blocks, group, order, sums, **given)

    monkeypatch.setattr(metrics, "running_totals", watched)
    pred = spark.range(n).selectExpr("'a' AS variant", "'test' AS split", "id * 7 % 50000 AS id", "CAST(id % 3 = 0 AS INT) AS y", "0.5D AS score")
    rows = pred.toPandas().sort_values("id")
    got = metrics.evaluate_predictions(pred, [0.01, 0.333]).first()
    for share in (0.01, 0.333):
        assert got[f"capture_rate_{share:g}"] == pytest.approx(rows.y[: int(n * share)].sum() / rows.y.sum(), abs=1e-12)
    assert ordered and max(ordered) < n / 50


def test_running_totals_add_up_repeated_blocks(spark):
    """Blocks that repeat, with NULL, NaN and both zeros among the values, against pandas."""
    odd = [None, float("nan"), float("inf"), 0.0, -0.0, -1.5, 2.0]
    rows = [(g, odd[i % 7], i, float(i) / 8) for g in ("a", "b") for i in range(70)] + [(None, 1.0, 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, value double, n long, s double")
    place = lambda v: (0, 0.0) if v is None else (1, v) if v == v else (2, 0.0)
    for down in (False, True):
        sums = {}
        for g, v, n, s in rows[:-1]:
            key = (g, *place(v))
            sums[key] = [a + b for a, b in zip(sums.get(key, (0, 0.0)), (n, s))]
        got = order.running_totals(order.add_up(df, ["g", "value"], ["n", "s"]), ["g"], "value", ["n", "s"], descending=down, merge=True).collect()
        assert len(got) == len(sums)
        for r in got:
            me = (r.g, *place(r.value))
            earlier = [v for k, v in sums.items() if k[0] == me[0] and (k > me if down else k < me)]
            assert [r.n, r.s] == sums[me] and r.n_before == sum(v[0] for v in earlier) and r.s_before == sum(v[1] for v in earlier)
            assert r.n_total == sum(v[0] for k, v in sums.items() if k[0] == me[0])


def test_feature_stats_ask_test_rows_too(spark):
    """The query gives each candidate's Gini on test; a feature without one comes with the reason."""
    import __spark_entry__ as entry
    from colgauge.operators import ranks
    from conftest import SMALL

    got = entry.queries()["feature_stats"](spark, SMALL).collect()
    assert len(got) == 3 and all((r.variable_gini is None) == (r.variable_gini_note is not None) for r in got)
    assert any(r.variable_gini is not None for r in got)
    n = 300
    rows = spark.range(n).selectExpr(
        "id", "CASE WHEN id < 100 THEN 'train' WHEN id < 200 THEN 'valid' ELSE 'test' END AS split", "CAST(id % 2 AS INT) AS y", "CAST(id AS DOUBLE) AS b",
        "CAST(id % 2 AS DOUBLE) AS answer", "IF(id < 100, id % 5, 2.5D) AS ends", "IF(id < 200, id % 5, NULL) AS gone")
    stats = {r.feature: (r.variable_gini, r.variable_gini_note) for r in ranks.feature_stats(rows, "id", ["answer", "ends", "gone"], ["b"], "y").collect()}
    hint = "; it does vary on train, so its source may end too early"
    assert stats == {"answer": (1.0, None), "ends": (None, "one value (2.5) on valid and test" + hint), "gone": (None, "empty on test" + hint)}
    one_class = ranks.feature_stats(rows.withColumn("y", F.lit(0)), "id", ["answer"], ["b"], "y").first()
    assert (one_class.variable_gini, one_class.variable_gini_note) == (None, "no signal on test")


def test_rows_are_made_once_for_all_that_is_asked_of_them(spark):
    """Selection and a feature's statistics run what makes their rows once."""
    from colgauge.operators import ranks
    from colgauge.operators.clean import FeatureSet
    from colgauge.plans import selection

    n, made = 300, spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        made.add(1)
        return float(x % 17)

    rows = spark.range(n).select("id", F.lit("train").alias("split"), (F.col("id") % 2).alias("y"), seen("id").alias("a"), (F.col("id") % 5).alias("b"))
    for ask in (lambda: selection.measure(rows, FeatureSet("y", ("b",), ("a",), ("id",)))[0].collect(),
                lambda: ranks.feature_stats(rows, "id", ["a"], ["b"], "y").collect()):
        made.value = 0
        ask()
        assert made.value == n
