"""Explanations of fitted pipelines, sketches in profile states, mode coverage, orders and cuts without a single task."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowspark.operators import augment, clean, compare, explain, ordering, profile, sample, scoring, select
from flowspark.plans import explanations, models
from flowspark.session import scratch_path, settle
from flowspark.sources import readers
from flowspark.streaming import jobs

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, float(i % 2), float(rng.normal(3 * (i % 2))), float(rng.normal())) for i in range(120)]
    return settle(spark.createDataFrame(data, "id long, y double, a double, b double"))


def assembled(df, estimator):
    return Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol=models.FEATURES, handleInvalid="skip"), estimator]).fit(df)


# ---- explanations
def test_pipeline_explanations_equal_the_plain_ones(rows):
    model, plain = assembled(rows, models.nearest_centroid()), scoring.fit_centroids(rows, "y", NAMES)
    grid = [-1.0, 0.5, 2.0]
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(explanations.individual_expectation(model, rows, ["id"], "a", grid)) == key(explain.individual_expectation(rows, ["id"], NAMES, "a", grid, plain.labels, plain.index))
    assert key(explanations.partial_dependence(model, rows, "a", grid)) == key(explain.partial_dependence(rows, NAMES, "a", grid, plain.labels, plain.index))
    falls = lambda d: {r["feature"]: pytest.approx(r["drop"], abs=1e-12) for r in d.collect()}
    assert falls(explanations.permutation_importance(model, rows, "y", NAMES, ["id"])) == {
        r["feature"]: r["drop"] for r in explain.permutation_importance(rows, "y", NAMES, ["id"], plain.labels, plain.index).collect()}


def test_any_pipeline_is_explained(rows):
    for estimator in (models.logistic(), models.forest(5, 3)):
        falls = {r["feature"]: r["drop"] for r in explanations.permutation_importance(assembled(rows, estimator), rows, "y", NAMES, ["id"]).collect()}
        assert falls["a"] > 0.2 > falls["b"]


def test_explanations_of_rows_that_lack_a_feature(rows):
    holes = rows.withColumn("b", F.when(F.col("id") > 9, F.col("b")))
    model = assembled(rows, models.nearest_centroid())
    found = explanations.individual_expectation(model, holes, ["id"], "a", [0.0]).collect()
    assert len(found) == 120 and all((r["prediction"] is None) == (r["id"] <= 9) for r in found)
    assert explanations.partial_dependence(model, holes.where("id < 0"), "a", [0.0]).count() == 0


# ---- sketches
def test_sketches_merge_over_batches(spark):
    rng = random.Random(2)
    data = [(i, rng.choice("ab"), float(rng.randrange(5000)), None if i % 7 == 0 else float(i)) for i in range(9000)]
    df = spark.createDataFrame(data, "i long, label string, x double, z double")
    folder, state = scratch_path(spark, "landing"), scratch_path(spark, "state")
    for part in range(3):
        df.where(f"i % 3 = {part}").coalesce(1).write.mode("append").parquet(folder)
    jobs.keep_profile(jobs.landing(spark, folder, df.schema, files=1), "label", state, sketches=True)
    found = {r["column"]: r for r in jobs.current_approximations(spark, state, df).collect()}
    kept = [r for r in data if r[3] is not None]
    assert found["x"]["distinct"] == pytest.approx(len({r[2] for r in kept}), rel=0.03) and found["label"]["distinct"] == 2
    for share, value in zip((0.25, 0.5, 0.75), found["x"]["quantiles"]):
        assert sum(r[2] <= value for r in kept) / len(kept) == pytest.approx(share, abs=0.02)
    assert found["label"]["quantiles"] is None
    plain = profile.merge_states(spark.read.parquet(state).drop("batch"))
    assert profile.profile_from_state(plain, df, "label").collect() == profile.profile(df, "label").collect()
    sizes = lambda d: profile.profile_state(d, "label", sketches=True).select(F.length("hll_2") + F.length("kll_2")).first()[0]
    assert sizes(spark.range(0, 200_000).selectExpr("id AS i", "'a' AS label", "CAST(id AS DOUBLE) AS x")) < 200_000


def test_sketches_without_clean_rows(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan"))], "label string, x double")
    found = {r["column"]: r for r in profile.approximate_table(profile.profile_state(df, "label", sketches=True), df).collect()}
    assert found["x"]["distinct"] == 0 and found["x"]["quantiles"] is None


# ---- modes
def test_missing_mode_is_found(spark):
    rng = np.random.default_rng(4)
    places = [(0, 0), (20, 0), (0, 20), (20, 20)]
    make = lambda n, left_out: [(c, float(rng.normal(x)), float(rng.normal(y)))
                                for c in ("p", "q") for i, (x, y) in enumerate(places) if not (c == "q" and i == left_out) for _ in range(n)]
    schema = "class string, u double, v double"
    original, generated = spark.createDataFrame(make(60, None), schema), spark.createDataFrame(make(25, 2) + [("q", 500.0, 500.0), ("r", 0.0, 0.0), ("p", None, 1.0)], schema)
    found = augment.mode_coverage(original, generated, "class", ["u", "v"], modes=4).collect()
    assert {(r["class"], r["original"]) for r in found} == {("p", 60), ("q", 60)} and len(found) == 8
    missed = [r for r in found if not r["reached"]]
    assert len(missed) == 1 and missed[0]["class"] == "q" and missed[0]["generated"] == 0


# ---- orders and cuts
def test_positions_over_all_tasks(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("v"))
    found = ordering.ordered_positions(df.repartition(9), [F.desc("v")], "at").collect()
    assert sorted((r["at"], r["v"]) for r in found) == [(i + 1, 4999 - i) for i in range(5000)]
    assert ordering.ordered_positions(df.limit(0), [F.asc("v")]).count() == 0


@pytest.mark.parametrize("quota", [0, 1, 37, 299, 300, 1000])
def test_cuts_take_the_first_rows_of_each_group(spark, quota):
    df = spark.range(0, 400, 1, 5).select("id", F.when(F.col("id") % 4 > 0, "big").otherwise(F.when(F.col("id") % 8 > 0, "small")).alias("g"))
    quotas = spark.createDataFrame([("big", quota), (None, 3)], "g string, quota long")
    marked = ordering.hash_marked(df, ["g"], ["id"], 1, quotas)
    ranked = {r["id"]: r["rn"] for r in ordering.hash_ranked(df, ["g"], ["id"], 1).collect()}
    limit = {"big": quota, None: 3, "small": 0}
    rows = marked.collect()
    assert len(rows) == 400 and all(r["taken"] == (ranked[r["id"]] <= limit[r["g"]]) for r in rows)


def test_no_plan_moves_all_rows_to_one_task(spark):
    """At 4,000 partitions and 20 classes, no exchange of these plans gathers rows of the table in a single partition."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "4000")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        df = spark.range(0, 2000, 1, 4).select("id", (F.col("id") % 20).alias("c"), F.rand(1).alias("x"))
        quotas = spark.createDataFrame([(i, 10) for i in range(20)], "c long, quota long")
        plans = {
            "marked": ordering.hash_marked(df, ["c"], ["id"], 1, quotas),
            "majority": select.majority_features(df.withColumn("s", F.col("x") > 0.5), "id", "c", "s", "x"),
        }
        for name, plan in plans.items():
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert "SinglePartition" not in text and "NestedLoop" not in text and "CartesianProduct" not in text, (name, text)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_split_of_many_classes_keeps_quotas(spark):
    df = spark.range(0, 3000, 1, 4).select("id", (F.col("id") % 100).alias("c"))
    split = sample.stratified_split(df, "c", ["id"], 0.2)
    assert split.where("part = 'test'").groupBy("c").count().select("count").distinct().collect() == [(6,)]


def test_pairs_by_index_equal_sets(spark):
    rng = random.Random(8)
    data = [(g, f"f{rng.randrange(12)}", f"s{rng.randrange(3)}") for g in "dacb" for _ in range(6)] + [("e", None, "s0")]
    found = compare.group_pairs(spark.createDataFrame(data, "g string, f string, s string"), "g", "f", "s").collect()
    sets = {g: {f for h, f, _ in data if h == g and f} for g in "abcde"}
    assert len(found) == 10
    for r in found:
        one, two = sets[r["dataset_a"]], sets[r["dataset_b"]]
        text = lambda s: ", ".join(sorted(s)) or "None"
        assert (r["n_common"], r["n_extra_a"], r["n_extra_b"]) == (len(one & two), len(one - two), len(two - one))
        assert (r["common_features"], r["extra_features_a"], r["extra_features_b"]) == (text(one & two), text(one - two), text(two - one))


# ---- missing values and types
def test_statistics_of_present_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("a", None)], "c string, x double")
    assert select.class_feature_stats(df, "c", ["x"]).first()["x_mean"] == 2.0
    assert {r["share"]: r["q"] for r in select.class_feature_quartiles(df, "c", ["x"]).collect()} == {0.25: 1.5, 0.5: 2.0, 0.75: 2.5}
    assert clean.scale_stats(df, ["x"]) == {"x": (2.0, 1.0)}


def test_codes_keep_their_zeros_beside_text(spark):
    folder = scratch_path(spark, "csv")
    for name, text in (("one", "code,n\n00123,1\n"), ("two", "n,code\n2.5,abc\n")):
        spark.createDataFrame([(text.strip(),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    found = readers.read_flows(spark, [f"{folder}/one", f"{folder}/two"])
    assert sorted((r["code"], r["n"]) for r in found.collect()) == [("00123", 1.0), ("abc", 2.5)]


def test_quoted_question_mark_is_text(spark):
    path = scratch_path(spark, "arff")
    text = "@relation r\n@attribute a string\n@attribute b string\n@attribute n numeric\n@data\n'?', ?, 1\n'a,?,b', '?' ,?\n?,'\\'?\\'',2"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    rows = [tuple(r) for r in readers.read_arff(spark, path).collect()]
    assert rows == [("?", None, 1.0), ("a,?,b", "?", None), (None, "'?'", 2.0)]
