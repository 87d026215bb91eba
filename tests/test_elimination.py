"""Feature elimination in full: one feature a round, ten folds, and rounds that share a job but find what single fits find."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowspark import catalog
from flowspark.plans import deep_forest, models
from flowspark.plans import features as selection


def rows_of(n, d, classes=2, seed=3):
    """Coded rows: bins, labels that the first two features tell, bootstrap counts."""
    draw = np.random.default_rng(seed)
    x = draw.integers(0, deep_forest.BINS, (n, d)).astype(np.uint8)
    return x, (x[:, 0].astype(np.int64) // 7 + x[:, 1] // 11 + draw.integers(0, 2, n)) % classes, draw.poisson(1.0, (6, n)).astype(float)


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(8)
    x = np.round(draw.normal(size=(160, 6)), 1)
    y = (x[:, 1] > 0).astype(float) + (x[:, 4] > 0.4)
    rows = [(i, float(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))] + [(160 + i, 1.0, [0.5] * 6) for i in range(8)]
    return spark.createDataFrame(rows, "id long, y double, v array<double>").select("id", "y", array_to_vector("v").alias("features")).cache()


@pytest.mark.parametrize("name", ["m8_recursive_elimination", "m8_elimination_result"])
def test_queries_eliminate_one_feature_a_round_in_ten_folds(spark, tmp_path, monkeypatch, name):
    catalog.load()
    draw = np.random.default_rng(1)
    v = draw.normal(size=(80, 64)) + 3.0 * (np.arange(80)[:, None] % 2) * (np.arange(64) < 8)
    rows = [(i, [float(c) for c in r], i % 2) for i, r in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole, seen = selection.recursive_elimination, []

    def watched(*args, **kwargs):
        seen.append(whole(*args, **kwargs))
        return seen[-1]

    monkeypatch.setattr(selection, "recursive_elimination", watched)
    monkeypatch.setattr(selection, "forest", lambda: models.forest(2))
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() in (1, 64)
    folds = {}
    for r in seen[0][1].collect():
        folds.setdefault(r["fold"], []).append(r["ranking"])
    assert len(folds) == 10 and all(sorted(f) == [1] * 9 + list(range(1, 56)) for f in folds.values())


@pytest.mark.parametrize("limit", [50_000, 40])
def test_rounds_find_what_single_fits_find(table, monkeypatch, limit):
    monkeypatch.setattr(deep_forest, "LOCAL_ROWS", limit)
    sides, left = [table.where("id % 3 > 0"), table.where("id % 3 < 2")], [[0, 1, 2, 3, 4, 5], [1, 4, 5, 0]]
    rounds = deep_forest.Rounds(models.forest(5), sides)
    assert all((t[1] is None) == (limit == 40) for t in rounds.tables)
    for kept in (left, [[4, 1], [5]]):
        fits = selection._fitted_importances(sides, kept, lambda: models.forest(5), 2)
        assert all((a == b).all() for a, b in zip(fits, rounds.importances(kept)))
    rounds.close()


def test_elimination_asks_once_a_round(table, monkeypatch):
    asked, whole = [], deep_forest.Rounds.importances
    monkeypatch.setattr(deep_forest.Rounds, "importances", lambda self, left: asked.append([len(own) for own in left]) or whole(self, left))
    first, second = selection.eliminate_all([table, table.where("id % 2 = 0")], list("abcdef"), 2, make=lambda: models.forest(5))
    assert asked == [[6, 6], [5, 5], [4, 4], [3, 3]]
    assert [n for n, kept, _ in first if kept] == ["b", "e"] and sorted(r for _, _, r in second) == [1, 1, 2, 3, 4, 5]


def test_row_hashes_are_those_of_the_engine(spark):
    draw = np.random.default_rng(2)
    for d in (1, 3, 4, 7, 8, 13, 31, 32, 45, 64, 79):
        x, y = draw.integers(0, 256, (5, d)).astype(np.uint8), draw.integers(0, 9, 5)
        df = spark.createDataFrame([(i, int(c), bytearray(r.tobytes())) for i, (c, r) in enumerate(zip(y, x))], "i int, y int, bins binary")
        asked = [r["h"] for r in df.select("i", F.xxhash64("y", "bins").alias("h")).orderBy("i").collect()]
        assert deep_forest.row_hashes(y, x).tolist() == asked


def test_equal_rows_are_merged():
    x, y = np.array([[1, 2], [3, 4], [1, 2], [1, 2]], np.uint8), np.array([0, 0, 0, 1])
    got = list(zip(*(c.tolist() for c in deep_forest.merged(y, x, np.array([2, 1, 5, 1]))[:3])))
    assert sorted(got) == [(0, [1, 2], 7), (0, [3, 4], 1), (1, [1, 2], 1)]


@pytest.mark.parametrize("classes", [2, 7])
@pytest.mark.parametrize("dense", [0, 1, float("inf")])
def test_trees_side_by_side_are_those_grown_alone(monkeypatch, dense, classes):
    x, y, w = rows_of(300, 9, classes)
    w[4] = 0  # a tree whose bootstrap is empty
    draws = lambda: [np.random.default_rng([1, t]) for t in range(6)]
    monkeypatch.setattr(deep_forest, "DENSE", float("inf"))
    alone = [deep_forest.grow_part(x[w[t] > 0], y[w[t] > 0], w[t][w[t] > 0], classes, 3, 12, draws()[t]) for t in (0, 1, 2, 3, 5)]
    monkeypatch.setattr(deep_forest, "DENSE", dense)
    at, rows = np.nonzero(w)
    gains = deep_forest.gains_of(x[rows], y[rows], w[at, rows], at, classes, 3, 12, draws())
    assert (gains[[0, 1, 2, 3, 5]] == np.array([a[4] for a in alone])).all() and not gains[4].any()
    again = deep_forest.grow_part(x[w[0] > 0], y[w[0] > 0], w[0][w[0] > 0], classes, 3, 12, draws()[0])
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(alone[0], again))
