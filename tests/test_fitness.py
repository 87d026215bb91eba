"""Own estimators, fitness by estimators, stored searches, extremely randomized trees and sparse categories."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from flowspark.operators import encode, nearest, scoring
from flowspark.operators.sample import stratified_folds
from flowspark.plans import extra_trees, fitness, models, search, tuning
from flowspark.plans import features as selection
from flowspark.plans.estimators import NearestCentroid, Neighbours, NeighboursModel
from flowspark.plans.prepare import prepare
from flowspark.session import scratch_path, settle

NAMES = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def blobs(spark):
    """Two classes that f0 tells apart; the other features are noise."""
    rng = np.random.default_rng(42)
    rows = [(i, float(i % 3 > 0), float(rng.normal(4 if i % 3 else 0)), *map(float, rng.normal(size=3))) for i in range(240)]
    return settle(spark.createDataFrame(rows, "id long, y double, f0 double, f1 double, f2 double, f3 double"))


# ---- estimators
@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_centroid_estimator_equals_operator(blobs, metric):
    table = models.vector_table(blobs, "y", NAMES, ["id"])
    got = models.nearest_centroid(metric).fit(table).transform(table).select("id", "prediction").collect()
    plain = scoring.predict_centroid(blobs, scoring.fit_centroids(blobs, "y", NAMES, metric), NAMES).select("id", "prediction").collect()
    assert sorted(got) == sorted(plain)


def test_estimators_in_a_stored_pipeline(spark, blobs):
    for estimator in (models.nearest_centroid(shrink_threshold=0.1), models.neighbours(3, "distance")):
        fitted = models.pipeline(NAMES, estimator).fit(blobs)
        path = scratch_path(spark, "model")
        fitted.write().save(path)
        again = PipelineModel.load(path)
        key = lambda d: sorted(models.predict(d, blobs).select("id", "prediction").collect())
        assert key(again) == key(fitted)
        assert models.score_stored(path, blobs, "y").first()["accuracy"] > 0.95


def test_neighbours_of_nothing_and_null_labels(spark):
    rows = [(1, Vectors.dense([0.0]), 0.0), (2, Vectors.dense([1.0]), None), (3, Vectors.dense([5.0]), 1.0)]
    df = spark.createDataFrame(rows, ["id", "features", "label"])
    model = Neighbours(k=1).fit(df)
    assert {r["id"]: r["prediction"] for r in model.transform(df).collect()} == {1: 0.0, 2: 0.0, 3: 1.0}
    none = Neighbours(k=1).fit(df.where("id > 9"))
    assert isinstance(none, NeighboursModel) and none.transform(df).where("prediction is null").count() == 3
    with pytest.raises(ValueError):
        NearestCentroid().fit(df.where("id > 9"))


def test_line_up_and_grid_have_the_own_estimators(spark, blobs):
    assert {"KNN", "Nearest Centroid"} <= set(models.default_models(4, 2, 100))
    grid = {"Nearest Centroid": {"metric": ["euclidean", "manhattan"], "shrink_threshold": [None, 0.5]}}
    found = tuning.grid_search(blobs, "y", NAMES, ["id"], grid, tuning.OWN_MAKERS, folds=2)
    assert found.count() == 4 and found.agg(F.min("f1")).first()[0] > 0.85


def test_neighbours_in_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, (50, 3)).astype(float), rng.integers(0, 4, (333, 3)).astype(float)  # very many ties
    monkeypatch.setattr(nearest, "CHUNK_ROWS", 17)
    monkeypatch.setattr(nearest, "NUMBERS", 500)
    row, far, at = nearest.nearest_places(a, b, 5, "manhattan", 1)
    d = np.abs(a[:, None] - b[None]).sum(axis=2)
    want = d.argsort(axis=1, kind="stable")[:, :5]
    assert at.reshape(50, 5).tolist() == want.tolist() and far.tolist() == np.take_along_axis(d, want, 1).ravel().tolist()


def test_neighbours_without_training_rows(spark):
    df = spark.createDataFrame([(1, [0.0], "a")], "id long, v array<double>, label string")
    assert nearest.nearest_rows(df, df.where("id > 1"), "id", "v", "label", 3).count() == 0


# ---- fitness
def test_estimator_fitness_equals_statistics(blobs):
    folded = settle(stratified_folds(blobs, "y", ["id"], 4))
    masks = [(1, 1, 1, 1), (1, 0, 0, 0), (0, 1, 1, 0), (1, 0, 0, 0), (0, 0, 0, 0)]
    table = fitness.fitness_table(blobs, "y", NAMES, ["id"], 4, None)
    for bound in (0.0, 0.75):
        one = scoring.score_masks(folded, "fold", "y", NAMES, masks, early_accuracy=bound).orderBy("id").collect()
        two = fitness.estimator_scores(table, masks, models.nearest_centroid, early_accuracy=bound).orderBy("id").collect()
        assert [r["n_features"] for r in one] == [r["n_features"] for r in two]
        for a, b in zip(one, two):
            assert [a[c] for c in scoring.PENALTY] == pytest.approx([b[c] for c in scoring.PENALTY], abs=1e-12)
    stats = scoring.fold_statistics(folded, "fold", "y", NAMES)
    again = scoring.score_masks(folded, "fold", "y", NAMES, masks, early_accuracy=0.0, stats=stats).collect()
    assert sorted(again) == sorted(scoring.score_masks(folded, "fold", "y", NAMES, masks, early_accuracy=0.0).collect())


def test_rejected_subset_is_not_fitted_further(blobs):
    made = []
    make = lambda: made.append(1) or models.nearest_centroid()
    table = fitness.fitness_table(blobs, "y", NAMES, ["id"], 6, None)
    row = fitness.estimator_scores(table, [(0, 1, 0, 0)], make, early_accuracy=0.99).first()
    assert len(made) == 1 and (row["f1"], row["fpr"]) == (0.0, 1.0)


def test_test_side_and_holdout(spark, blobs):
    table = fitness.fitness_table(blobs, "y", NAMES, ["id"], 3)
    assert table.where("part = 'test'").count() == 48 and table.where("part = 'test' and fold is not null").count() == 0
    row = fitness.estimator_scores(table, [(1, 0, 0, 0), (0, 0, 0, 0)], lambda: models.forest(5, 4), test=True).orderBy("id").collect()
    assert row[0]["test_f1"] > 0.9 and row[0]["f1"] > 0.9 and (row[1]["test_fnr"], row[1]["test_f1"]) == (1.0, 0.0)
    rare = blobs.where("y = 1").limit(19).unionByName(blobs.where("y = 0").limit(1))
    alone = fitness.fitness_table(rare, "y", NAMES, ["id"], 3, None)
    assert sorted(r["n"] for r in alone.groupBy("fold").agg(F.count("*").alias("n")).collect()) == [4, 16]
    counts = fitness.estimator_counts(alone, [(1, 1, 1, 1)], models.nearest_centroid)
    assert counts.agg(F.sum("n")).first()[0] == 4


def test_null_labels_and_folds_are_passed_over(blobs):
    folded = settle(stratified_folds(blobs, "y", ["id"], 4))
    holes = folded.withColumn("y", F.when(F.col("id") % 10 > 0, F.col("y"))).withColumn("fold", F.when(F.col("id") % 11 > 0, F.col("fold")))
    left = holes.dropna(subset=["y", "fold"])
    scores = lambda d: scoring.score_masks(d, "fold", "y", NAMES, [(1, 1, 0, 0)], early_accuracy=0.0).collect()
    assert scores(holes) == scores(left)


# ---- store
def test_store_keeps_scores_by_study(spark):
    path = scratch_path(spark, "fitness")
    one, two = fitness.FitnessStore(spark, path, "one"), fitness.FitnessStore(spark, path, "two")
    assert one.known([(1, 0)]) == {} and one.load_state() is None
    score = dict.fromkeys(scoring.PENALTY, 0.5) | {"n_features": 1}
    one.add({(1, 0): score, (0, 1): score})
    one.add({(1, 0): score})  # twice is once
    assert one.known([(1, 0), (1, 1)]) == {(1, 0): score} and two.known([(1, 0)]) == {}
    assert one.missing([(1, 1), (0, 1), (1, 1)]) == [(1, 1)]
    one.save_state(1, {"a": 1})
    one.save_state(2, {"a": 2})
    assert one.load_state() == (2, {"a": 2}) and two.load_state() is None


def test_stopped_search_ends_as_one_that_went_on(spark, blobs):
    folded = settle(stratified_folds(blobs, "y", ["id"], 4))
    run = lambda store, generations: search.evolve(folded, "fold", "y", NAMES, 6, generations, seed=3, early_accuracy=0.0, store=store)
    straight = search.evolve(folded, "fold", "y", NAMES, 6, 7, seed=3, early_accuracy=0.0)
    store = fitness.new_store(spark, "blobs")
    for generations in (2, 3, 7):
        resumed = run(store, generations)
    assert (resumed.best, resumed.history, resumed.population) == (straight.best, straight.history, straight.population)
    calls = []
    rate = lambda masks: calls.append(masks) or search.statistics_fitness(folded, "fold", "y", NAMES, early_accuracy=0.0)(masks)
    other = fitness.FitnessStore(spark, store.path, "blobs")
    done = search.evolve(None, "fold", "y", NAMES, 6, 7, seed=3, fitness=rate, store=other)
    assert done.history == straight.history and not calls  # every subset was stored


# ---- elimination and components
def test_elimination_result_row(blobs):
    row = selection.elimination_result(blobs, "y", NAMES, ["id"], keep=1, folds=2, make=lambda: models.forest(5, 3)).first()
    assert row["features"] == ["f0"] and row["cv_f1"] > 0.9 and row["test_f1"] > 0.9


def test_best_components(spark):
    rows = spark.createDataFrame([(2, 0.5, 0.1), (4, 0.9, 0.2), (8, 0.9, 0.3)], "n_components int, cv_f1 double, explained_variance double")
    assert selection.best_components(rows).first()["n_components"] == 4


# ---- trees
def test_extra_trees_find_the_feature(blobs):
    ranked, result = selection.tree_importance(blobs, "y", NAMES, ["id"], 1, trees=20, depth=4)
    rows = ranked.orderBy("rank").collect()
    assert rows[0]["feature"] == "f0" and rows[0]["selected"] and sum(r["importance"] for r in rows) == pytest.approx(1)
    row = result.first()
    assert row["test_f1"] > 0.9 and row["cv_f1"] > 0.9
    one, two = (extra_trees.grow(d, "y", NAMES, 3, 3) for d in (blobs, blobs.repartition(7)))
    assert (one.feature == two.feature).all() and (one.threshold == two.threshold).all()


def test_extra_trees_split_like_plain_counts(blobs):
    """Every split is between the least and greatest value of its node, and the shares below it are those of its rows."""
    model = extra_trees.grow(blobs, "y", NAMES, 2, 3)
    data = blobs.collect()
    x, y = np.array([[r[f] for f in NAMES] for r in data]), np.array([r["y"] for r in data])
    for t in range(2):
        inside = {1: np.ones(len(x), bool)}
        for n in range(1, 8):
            f = model.feature[t, n]
            if f < 0:
                continue
            at, cut = inside[n], model.threshold[t, n]
            assert x[at, f].min() <= cut < x[at, f].max()
            inside[2 * n], inside[2 * n + 1] = at & (x[:, f] <= cut), at & (x[:, f] > cut)
            for side in (2 * n, 2 * n + 1):
                assert model.votes[t, side].tolist() == pytest.approx([(y[inside[side]] == c).mean() for c in model.labels])


def test_extra_trees_odd_rows(spark):
    rows = [(1, 1.0, 0), (1, 1.0, 1), (2, None, 1), (3, float("nan"), 0), (4, 2.0, None)]
    df = spark.createDataFrame(rows, "id int, a double, y int")
    model = extra_trees.grow(df, "y", ["a"], 2, 2)  # constant: no split
    assert (model.feature == -1).all() and [r["prediction"] for r in extra_trees.predict(df, model).orderBy("id").collect()] == [0, 0, None, None, 0]
    with pytest.raises(ValueError):
        extra_trees.grow(df.where("id > 9"), "y", ["a"], 2, 2)


# ---- categories
def test_many_categories_stay_sparse(spark):
    df = spark.range(0, 120_000, 1, 6).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    fitted = encode.fit_categories(df, ["a", "b"])
    assert fitted.sizes == {"a": 120_000, "b": 3}
    asked = spark.createDataFrame([("v000000", "2"), ("v119999", None), ("new", "0"), (None, "9")], "a string, b string")
    rows = {tuple(r["categories"].indices.tolist()) for r in encode.sparse_one_hot(asked, fitted).collect()}
    assert rows == {(0, 120_002), (119_999,), (120_000,), ()}
    only = encode.sparse_one_hot(asked.drop("a"), fitted)
    assert only.columns == ["categories"] and {tuple(r[0].indices.tolist()) for r in only.collect()} == {(120_002,), (), (120_000,)}
    names = {r["slot"]: r["name"] for r in fitted.slots().where("slot in (0, 119999, 120000)").collect()}
    assert names == {0: "a_v000000", 119_999: "a_v119999", 120_000: "b_0"}
    with pytest.raises(ValueError):
        encode.category_values(df, ["a"])


def test_text_column_absent_from_the_test_side(spark):
    train = spark.createDataFrame([(i, "xy"[i % 2], float(i), "ab"[i % 2]) for i in range(12)], "id long, t string, x double, label string")
    ready = prepare(train, train.drop("t"), "label", keys=["id"])
    assert {"t_x", "t_y"} <= set(ready.test.columns) and ready.test.count() == 12
    assert math.isclose(ready.test.agg(F.count_distinct("t_x")).first()[0], 1)


def test_ranking_grows_the_train_side_once(blobs, monkeypatch):
    grown, grow = [], extra_trees.grow
    monkeypatch.setattr(extra_trees, "grow", lambda *a: grown.append(1) or grow(*a))
    alone = selection.tree_ranking(blobs, "y", NAMES, ["id"], 1, trees=20, depth=4).orderBy("rank").collect()
    assert len(grown) == 1
    assert alone == selection.tree_importance(blobs, "y", NAMES, ["id"], 1, trees=20, depth=4)[0].orderBy("rank").collect()


def test_extra_trees_route_like_the_model(blobs):
    """Rows pass a fixed number of levels, leaves included, and end where the grown trees say."""
    model = extra_trees.grow(blobs, "y", NAMES, 4, 5)
    x = np.array([[r[n] for n in NAMES] for r in blobs.collect()])
    router = extra_trees.Router.of(model, 5)
    for t in range(4):
        nodes = model.nodes_of(x, t)
        deep = np.unique(nodes[nodes >= 32])
        at, own, values = router.drawn_values(x, t, deep, np.zeros((len(deep), 1), int))
        assert (deep[at] == nodes[nodes >= 32]).all() and (values[0] == x[nodes >= 32, 0]).all()
