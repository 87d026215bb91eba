import numpy as np
import pytest

from flowspark.operators import nearest


@pytest.mark.parametrize("metric,p", [("euclidean", 2.0), ("manhattan", 1.0), ("minkowski", 3.0)])
def test_bounds_lose_no_neighbour(metric, p, monkeypatch):
    """Equal to plain sorting, with equal distances, great offsets, and a reach that is just met."""
    monkeypatch.setattr(nearest, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(3)
    for shift in (0.0, 1e6):
        stored = np.repeat(rng.normal(size=(40, 6)), 3, axis=0) + shift
        asked = np.concatenate([stored[::7], rng.normal(size=(9, 6)) + shift])
        d = nearest.distances(asked, stored, metric, p)
        want = np.lexsort((np.broadcast_to(np.arange(len(stored)), d.shape), d), axis=1)[:, :5]
        reach = np.take_along_axis(d, want, axis=1)[:, -1]
        for limit in (None, reach):
            row, far, at = nearest.nearest_places(asked, stored, 5, metric, p, limit)
            assert (row == np.repeat(np.arange(len(asked)), 5)).all() and (at.reshape(-1, 5) == want).all()
            assert (far == d[row, at]).all()


def test_rows_without_clusters_are_not_sent_once_a_visit(spark, monkeypatch):
    """Pivots rule nothing out among vectors of many dimensions; every block then meets every other, once."""
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(rng.normal(size=(300, 40)))]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    calls, places = [], nearest.settle
    monkeypatch.setattr(nearest, "settle", lambda d: calls.append(d.columns) or places(d))
    got = nearest.nearest_rows(df.where("id < 60"), df.where("id >= 60"), "id", "v", "label", 3, block_rows=20).collect()
    assert sum(c == ["qkey", "vector", "cell"] for c in calls) == 1  # the first visits only
    x = np.array([r[1] for r in rows])
    d = nearest.distances(x[:60], x[60:], "euclidean", 2.0)
    want = {(i, n + 1): int(j) + 60 for i in range(60) for n, j in enumerate(d[i].argsort(kind="stable")[:3])}
    assert {(r["id"], r["rank"]): r["neighbor"] for r in got} == want


@pytest.mark.parametrize("bucket", [4.0, 0.2])
def test_nearest_by_hashing_equals_its_pairs(spark, monkeypatch, bucket):
    """Also where buckets hold most rows, and then without a row per pair."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    sides = df.where("id < 50"), df.where("id >= 50")
    pairs = nearest.approximate_rows(*sides, "id", "v", 3.0, bucket)
    want = {r["id"]: r["d"] for r in pairs.groupBy("id").agg(F.min("distance").alias("d")).collect()}
    if bucket > 1:
        monkeypatch.setattr(nearest, "approximate_rows", None)
    got = nearest.approximate_nearest(*sides, "id", "v", 3.0, bucket)
    assert want and {r["id"]: r["nearest"] for r in got.collect()} == want
