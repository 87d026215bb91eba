import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import explain, nearest, scoring
from flowspark.operators.sample import stratified_folds
from flowspark.plans import features as selection
from flowspark.plans import models, search, tuning
from flowspark.plans.prepare import prepare
from flowspark.session import settle

NAMES = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def blobs(spark):
    """Two classes that f0 tells apart; the other features are noise."""
    rng = np.random.default_rng(42)
    rows = [(i, "b" if i % 3 else "a", float(rng.normal(4 if i % 3 else 0)), *map(float, rng.normal(size=3))) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, label string, f0 double, f1 double, f2 double, f3 double")
    return stratified_folds(df, "label", ["id"], 4).cache()


def loop_fitness(rows, mask, scorer):
    """Fold accuracies by plain loops."""
    on = [i for i, b in enumerate(mask) if b]
    accuracy = []
    for fold in range(4):
        train = [r for r in rows if r["fold"] != fold]
        stats = {}
        for c in ("a", "b"):
            x = np.array([[r[f] for f in NAMES] for r in train if r["label"] == c])
            stats[c] = (x.mean(axis=0), x.var(axis=0), len(x) / len(train))
        hits = []
        for r in (r for r in rows if r["fold"] == fold):
            x = np.array([r[f] for f in NAMES])
            if scorer == "centroid":
                cost = {c: ((x - m)[on] ** 2).sum() for c, (m, _, _) in stats.items()}
            else:
                cost = {c: (0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v))[on].sum() - np.log(p) for c, (m, v, p) in stats.items()}
            hits.append(min(cost, key=cost.get) == r["label"])
        accuracy.append(np.mean(hits))
    return np.mean(accuracy)


@pytest.mark.parametrize("scorer", ["centroid", "naive_bayes"])
def test_mask_fitness_equals_loops(blobs, scorer):
    masks = [[1, 1, 1, 1], [1, 0, 0, 0], [0, 1, 1, 0], [1, 0, 0, 0], [0, 0, 0, 0]]
    got = {r["id"]: r for r in scoring.score_masks(blobs, "fold", "label", NAMES, masks, scorer, early_accuracy=0.0).collect()}
    rows = blobs.collect()
    for i, m in enumerate(masks[:3]):
        assert got[i]["accuracy"] == pytest.approx(loop_fitness(rows, m, scorer), abs=1e-9)
    assert got[3]["f1"] == got[1]["f1"] and got[4]["f1"] == 0.0 and got[4]["fpr"] == 1.0 and got[4]["n_features"] == 0


def test_early_rejection(blobs):
    rows = scoring.score_masks(blobs, "fold", "label", NAMES, [[1, 0, 0, 0], [0, 1, 0, 0]]).orderBy("id").collect()
    assert rows[0]["f1"] > 0.9 and (rows[1]["f1"], rows[1]["fnr"]) == (0.0, 1.0)


def test_only_empty_masks(blobs):
    assert scoring.score_masks(blobs, "fold", "label", NAMES, [[0] * 4]).first()["fpr"] == 1.0


def test_search_finds_the_feature_and_repeats(blobs):
    one = search.evolve(blobs, "fold", "label", NAMES, 8, 5, 3, early_accuracy=0.0)
    two = search.evolve(blobs, "fold", "label", NAMES, 8, 5, 3, early_accuracy=0.0)
    assert one.best == two.best and one.history == two.history
    assert one.best[0] == 1 and one.scores["f1"] > 0.9
    f1 = [h["best_f1"] for h in one.history]
    assert f1 == sorted(f1)


def test_survivors_prefer_the_front():
    masks = [(1, 0), (0, 1), (1, 1), (0, 0)]
    points = [(0.9, -1.0), (0.5, -1.0), (0.9, -2.0), (0.0, 0.0)]
    assert set(search.survivors(masks, points, 2)) == {(1, 0), (0, 0)}
    assert search.fronts(points)[0] == [0, 3]


@pytest.mark.parametrize("metric,p", [("euclidean", 2), ("manhattan", 1), ("minkowski", 3)])
def test_neighbours_equal_brute_force(spark, metric, p):
    rng = random.Random(9)
    vectors = [[rng.gauss(c, 0.3) for _ in range(5)] for c in (0, 0, 0, 0, 5, 9) for _ in range(30)]
    vectors += [[1.0] * 5] * 60  # a third of the rows are copies of one point
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)]
    train = spark.createDataFrame(rows, "id long, v array<double>, label int")
    asked = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors[::7])], "id long, v array<double>, label int")
    got = nearest.nearest_rows(asked, train, "id", "v", "label", 4, metric, p, pivots=5, block_rows=10, slice_rows=6)
    found = {}
    for r in got.collect():
        found.setdefault(r["id"], {})[r["rank"]] = (r["neighbor"], r["label"])
    for i, v in enumerate(vectors[::7]):
        far = sorted((sum(abs(a - b) ** p for a, b in zip(v, w)) ** (1 / p), j) for j, w in enumerate(vectors))
        want = {n + 1: (j, j % 3) for n, (_, j) in enumerate(far[:4])}
        close = sorted(far[:4]) == far[:4]
        assert close and {n: x[1] for n, x in found[i].items()}.keys() == want.keys()
        d = lambda j: sum(abs(a - b) ** p for a, b in zip(v, vectors[j])) ** (1 / p)
        assert [d(found[i][n][0]) for n in sorted(want)] == pytest.approx([x for x, _ in far[:4]], abs=1e-9)


def test_fewer_training_rows_than_k(spark):
    df = spark.createDataFrame([(1, [0.0], "a"), (2, [1.0], "b")], "id long, v array<double>, label string")
    assert nearest.nearest_rows(df, df, "id", "v", "label", 5).count() == 4


def test_zero_distance_takes_the_vote(spark):
    near = spark.createDataFrame([(1, 0.0, "z"), (1, 0.1, "a"), (1, 0.1, "a")], "id int, distance double, label string")
    assert nearest.vote(near, "id", "distance").first()["prediction"] == "z"
    assert nearest.vote(near, "id").first()["prediction"] == "a"


def test_centroid_ties_go_to_smaller_label(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("b", 2.0)], "label string, x double")
    model = scoring.fit_centroids(df, "label", ["x"])
    asked = spark.createDataFrame([(1.0,)], "x double")
    assert scoring.predict_centroid(asked, model, ["x"]).first()["prediction"] == "a"


def test_shrinking_pulls_to_the_mean(blobs):
    plain = scoring.fit_centroids(blobs, "label", NAMES)
    small = scoring.fit_centroids(blobs, "label", NAMES, shrink=1e6)
    assert np.ptp(small.centers, axis=0).max() < 1e-9 < np.ptp(plain.centers, axis=0).max()


def test_permutation_points_at_the_feature(blobs):
    model = scoring.fit_centroids(blobs, "label", NAMES)
    drop = {r["feature"]: r["drop"] for r in explain.permutation_importance(blobs, "label", NAMES, ["id"], model.labels, model.index).collect()}
    assert max(drop, key=drop.get) == "f0" and drop["f0"] > 0.2


def test_dependence_is_the_mean_of_expectations(blobs):
    model = scoring.fit_centroids(blobs, "label", NAMES)
    ice = explain.individual_expectation(blobs, ["id"], NAMES, "f0", [0.0, 4.0], model.labels, model.index)
    share = {(r["value"], r["prediction"]): r["share"] for r in explain.partial_dependence(blobs, NAMES, "f0", [0.0, 4.0], model.labels, model.index).collect()}
    for r in ice.groupBy("value", "prediction").count().collect():
        assert share[r["value"], r["prediction"]] == pytest.approx(r["count"] / 240)


def test_contribution_signs(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0)], "id int, x double")
    one = explain.linear_contributions(df, ["id"], {"o": {"x": 2.0}}, {"x": 2.0})
    assert sorted(r["value"] for r in explain.normalized_contributions(one, ["id"]).collect()) == [-2.0, 2.0]
    two = explain.linear_contributions(df, ["id"], {"o": {"x": 2.0}, "p": {"x": -4.0}}, {"x": 2.0})
    assert {r["value"] for r in explain.normalized_contributions(two, ["id"]).collect()} == {3.0}
    assert explain.mean_contribution(two).first()["importance"] == 3.0


@pytest.fixture(scope="module")
def sides(blobs):
    coded = blobs.withColumn("y", (F.col("label") == "b").cast("int"))
    table = models.vector_table(coded, "y", NAMES, ["id"], ["fold"])
    return table.filter("fold > 0").drop("fold"), table.filter("fold = 0").drop("fold")


def test_model_floors_and_repeats(sides):
    line_up = {"rf": models.forest(20, 5), "lr": models.logistic(), "svc": models.linear_svc(), "gbt": models.boosted(2, 5, 3), "mlp": models.perceptron(4, 2, (8,), 50)}
    one = {r["model"]: r["accuracy"] for r in models.train_and_score(*sides, line_up).collect()}
    assert min(one.values()) > 0.85
    two = {r["model"]: r["accuracy"] for r in models.train_and_score(*sides, {"rf": models.forest(20, 5)}).collect()}
    assert two["rf"] == one["rf"]


def test_stacking(sides):
    out = models.stacked(*sides, ["id"], {"rf": lambda: models.forest(5, 3), "lr": lambda: models.logistic(rounds=10)}, 2)
    assert out.count() == sides[1].count()
    assert out.filter("prediction = y").count() / out.count() > 0.85


def test_elimination_keeps_the_feature(blobs):
    coded = blobs.withColumn("y", (F.col("label") == "b").cast("int")).drop("fold")
    votes, rows, metrics = selection.recursive_elimination(coded, "y", NAMES, ["id"], keep=1, folds=2, make=lambda: models.forest(5, 3))
    kept = {r["feature"] for r in votes.filter("kept").collect()}
    assert kept == {"f0"} and metrics.count() == 2
    assert sorted(r["ranking"] for r in rows.filter("fold = 0").collect()) == [1, 2, 3, 4]


def test_importance_needs_features_and_classes(blobs):
    coded = blobs.withColumn("y", F.lit(1))
    with pytest.raises(ValueError):
        selection.tree_importance(coded, "y", NAMES, ["id"], 20)
    with pytest.raises(ValueError):
        selection.tree_importance(coded, "y", NAMES, ["id"], 2)


def test_components(blobs):
    coded = blobs.withColumn("y", (F.col("label") == "b").cast("int")).drop("fold")
    rows = selection.component_sweep(coded, "y", NAMES, ["id"], [2, 4, 8], 2, make=lambda: models.forest(5, 3)).orderBy("n_components").collect()
    assert [r["n_components"] for r in rows] == [2, 4]
    assert rows[1]["explained_variance"] == pytest.approx(1.0) and rows[0]["explained_variance"] < 1
    with pytest.raises(ValueError):
        selection.component_sweep(coded, "y", NAMES, ["id"], [9], 2)


def test_grid_search_skips_cached(spark, blobs):
    coded = blobs.withColumn("y", (F.col("label") == "b").cast("int")).drop("fold")
    grids = {"RF": {"trees": [2, 4]}}
    cache = spark.createDataFrame([("RF", '{"trees": 2}')], "model string, params_json string")
    got = tuning.grid_search(coded, "y", NAMES, ["id"], grids, {"RF": lambda trees: models.forest(trees, 3)}, cache, folds=2)
    assert [r["params_json"] for r in got.collect()] == ['{"trees": 4}']
    assert tuning.winners(got).first()["f1"] > 0.8


def test_prepare_learns_on_train_only(spark):
    rows = [(i, 0, float(i), "c1" if i % 2 else "c2", "x" if i % 4 else "y") for i in range(80)]
    train = spark.createDataFrame(rows, "id long, Timestamp int, num double, cat string, label string")
    test = spark.createDataFrame([(900, 0, 0.0, "unseen", "x")], train.schema)
    ready = prepare(train, test, keys=["id"])
    assert ready.features == ["num", "cat_c1", "cat_c2"] and ready.stats["num"][0] == pytest.approx(39.5)
    row = ready.test.first()
    assert row["cat_c1"] == pytest.approx((0 - 0.5) / 0.5) and row["label_index"] == 0
    with pytest.raises(Exception, match="unseen label"):
        prepare(train, test.withColumn("label", F.lit("new")), keys=["id"]).test.collect()
    split = prepare(train, keys=["id"])
    assert split.train.count() == 60 and split.test.count() == 20
    with pytest.raises(ValueError):
        prepare(train.drop("label"), keys=["id"])


def test_settle_survives_without_its_source(spark, tmp_path):
    path = str(tmp_path / "gone")
    spark.range(5).write.parquet(path)
    kept = settle(spark.read.parquet(path))
    assert spark.sparkContext.getCheckpointDir() and kept.count() == 5
