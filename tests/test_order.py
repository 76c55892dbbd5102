"""Running totals, quantiles, ranks and codes against NumPy and pandas, hot values included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colgauge.operators import binning, order, ranks


@pytest.fixture(scope="module")
def values():
    """Heavy tails, both signs, a value that fills a third of the rows, and gaps."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=6000) * np.exp(rng.normal(size=6000) * 4)
    x[:2000] = 0.0
    x[2000:2300] = np.nan
    y = rng.normal(size=6000) + x.clip(-1, 1)
    y[5000:5400] = np.nan
    return pd.DataFrame({"id": range(6000), "x": x, "y": y, "g": np.arange(6000) % 2})


@pytest.fixture(scope="module")
def df(spark, values):
    made = spark.createDataFrame(values)
    return made.select("id", "g", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "xy"])


def test_bucket_never_decreases(df):
    spread = order.range_buckets(df.select("g", "x").distinct(), ["g"], "x")
    for g in (0, 1):
        rows = spread.filter(F.col("g") == g).toPandas().sort_values("x", na_position="first")
        assert (rows._bucket.diff().dropna() >= 0).all()


def test_quantiles(df, values):
    probs = [0.0, 0.05, 0.31, 0.5, 0.95, 1.0]
    got = {(r.g, r.feature): r["values"] for r in order.quantiles(df, ["x", "y"], probs, by=["g"]).collect()}
    for g in (0, 1):
        for c in "xy":
            v = values.loc[values.g == g, c].dropna()
            assert np.allclose(got[g, c], np.quantile(v, probs), rtol=1e-12)


def test_average_rank(df, values):
    got = ranks.average_rank(df, "id", ["x"]).toPandas().set_index("id").avg_rank
    expected = values.set_index("id").x.rank().dropna()
    assert (got.sort_index() == expected.sort_index()).all() and len(got) == len(expected)


@pytest.mark.parametrize("method", ["aggregates", "blocks"])
def test_spearman(df, values, method):
    got = ranks.spearman_pairs(df, "id", [("x", "y")], method).first()
    r = values[["x", "y"]].rank()
    both = r.dropna()
    assert got.n == len(both) and got.rho == pytest.approx(both.x.corr(both.y), abs=1e-9)


def test_same_values_drops_before_ranking(df, values):
    both = values.dropna()
    got = ranks.same_values(df, "id", "x", "y").first()
    assert got.rho == pytest.approx(both.x.rank().corr(both.y.rank()), abs=1e-9) and got.same == 0


def test_nearest_column_fills_the_centre(df, values):
    r = values[["x", "y"]].rank()
    r = (r - r.mean()).fillna(0)
    expected = (r.x * r.y).sum() / np.sqrt((r.x**2).sum() * (r.y**2).sum())
    got = ranks.nearest_column(df.withColumn("flat", F.lit(1.0)), "id", ["x"], ["y", "flat"]).first()
    assert got.nearest == "y" and got.nearest_rho == pytest.approx(expected, abs=1e-9)


def test_codes_follow_searchsorted(df, values):
    edges = binning.quantile_edges(df, ["x"], 10)
    got = binning.quantile_codes(df, ["id"], edges).toPandas().sort_values("id").x.to_numpy()
    v = values.x.to_numpy()
    finite = np.unique(np.quantile(v[~np.isnan(v)], np.linspace(0, 1, 11)[1:-1]))
    expected = np.where(np.isnan(v), len(finite) + 1, np.searchsorted(finite, v, side="right"))
    assert np.allclose(edges["x"], finite) and (got == expected).mean() > 0.999


def test_positions_cross_buckets(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i * 7 % 50, i) for i in range(200)], "k string, v int, id int")
    got = order.positions(rows, ["k"], [F.asc("v"), F.asc("id")], F.floor(F.col("v") / 5)).toPandas()
    expected = got.sort_values(["v", "id"]).groupby("k").cumcount() + 1
    assert (got.position.sort_index() == expected.sort_index()).all()


def test_psi(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    gaps = np.where(rng.random(3000) < 0.4, None, x)
    rows = [("train", float(v), float(v)) for v in x] + [("test", float(v), None if g is None else float(g)) for v, g in zip(x, gaps)]
    df = spark.createDataFrame(rows, "split string, same double, gone double").withColumn("empty", F.lit(None).cast("double"))
    got = {r.feature: r.psi for r in binning.psi(df, ["same", "gone", "empty"], "split", "train").collect()}
    assert got["same"] == pytest.approx(0, abs=1e-12) and got["gone"] > 1.0 and got["empty"] is None


SPREADS = {
    "pressures": "101325D + id * 5e-6",
    "microseconds": "1700000000000000D + id",
    "negative": "-8D + id * 1e-7",
    # A cluster, and outliers on both sides of it.
    "cluster": "1e6 + if(id < 10, id * 40D - 200, id * 1e-6)",
    # Bursts, each a millionth as wide as the way to the next.
    "bursts": "floor(id / 20000) * 1e6 + id % 20000 * 1e-5",
    "magnitudes": "exp(id / 1000) - exp((200000 - id) / 1000)",
}


@pytest.mark.parametrize("kind", SPREADS)
def test_clustered_values_are_spread(spark, kind):
    """However close together most values lie, no bucket holds more than a fiftieth of them."""
    blocks = spark.range(200_000).select(F.lit("x").alias("g"), "id", F.expr(SPREADS[kind]).alias("value"), F.lit(1).alias("n"))
    spread = order.range_buckets(blocks, ["g"], "value")
    assert spread.groupBy("_bucket").count().agg(F.max("count")).first()[0] < 0.02 * 200_000
    wanted = blocks.toPandas().value.rank(method="first").to_numpy() - 1
    for down in (False, True):
        ranked = order.running_totals(blocks, ["g"], "value", ["n"], descending=down).toPandas().sort_values("id")
        assert (ranked.n_before.to_numpy() == (199_999 - wanted if down else wanted)).all()
