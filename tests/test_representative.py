"""Clusters of all classes at once, against Lloyd's rounds in numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from colgauge.operators import representative as rep


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "id long, y string, x array<double>")
    return df.select("id", "y", array_to_vector("x").alias("encoded"))


def lloyd(x, centres, rounds):
    centres = np.array(centres, float)
    for _ in range(rounds):
        at = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[at == j].mean(axis=0) if (at == j).any() else c for j, c in enumerate(centres)])
    return centres


def test_rounds_equal_numpy_in_every_class(spark):
    rng = np.random.default_rng(7)
    data = {"a": rng.normal(size=(300, 3)), "b": rng.normal(size=(12, 3)) + 5, "c": np.zeros((9, 3))}
    rows = [(i * 10 + k, y, v.tolist()) for k, (y, x) in enumerate(data.items()) for i, v in enumerate(x)]
    # The last start of each class is too far from every row to win one, and stays.
    starts = {y: [*x[:3].tolist(), [99.0, 99.0, 99.0]] for y, x in data.items()}
    start = spark.createDataFrame([(y, j, c) for y, cs in starts.items() for j, c in enumerate(cs)], "y string, cluster int, centre array<double>")
    df = vectors(spark, rows)
    found = {(r.y, r.cluster): r.centre for r in rep.grouped_kmeans(df, "y", start, rounds=4, close=0.0).collect()}
    for y, x in data.items():
        for j, c in enumerate(lloyd(x, starts[y], 4)):
            assert found[y, j] == pytest.approx(c)
    centres = spark.createDataFrame([(y, j, list(c)) for (y, j), c in found.items()], "y string, cluster int, centre array<double>")
    gaps = {r.id: (r.cluster, r.distance) for r in rep.nearest_centres(df, "y", centres).collect()}
    for i, y, v in rows:
        all_gaps = [float(((np.array(v) - np.array(found[y, j])) ** 2).sum()) for j in range(4)]
        assert gaps[i][1] == pytest.approx(min(all_gaps)) and all_gaps[gaps[i][0]] == pytest.approx(min(all_gaps))


def test_representative_rows_of_uneven_classes(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "many", (rng.normal(size=2) + 20 * (i % 3)).tolist()) for i in range(240)]
    rows += [(1000, "one", [0.0, 0.0]), (2000, None, [1.0, 1.0])] + [(3000 + i, "same", [4.0, 4.0]) for i in range(8)]
    got = rep.representative_rows(vectors(spark, rows), "id", "y", shots=9, batches=2).collect()
    by = {y: [r for r in got if r.y == y] for y in ("many", "one", "same")}
    assert len(got) == sum(map(len, by.values()))
    # Three far groups are found as they are; a batch has one row of each.
    for b in (0, 1):
        assert sorted(r.id % 3 for r in by["many"] if r.batch == b) == [0, 1, 2]
    assert [(r.id, r.distance, r.batch) for r in sorted(by["one"], key=lambda r: r.batch)] == [(1000, 0.0, 0), (1000, 0.0, 1)]
    assert {r.distance for r in by["same"]} == {0.0}


def test_empty_table(spark):
    assert rep.representative_rows(vectors(spark, []), "id", "y", shots=4, batches=2).count() == 0
