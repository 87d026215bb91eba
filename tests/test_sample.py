import pytest
from pyspark.sql import functions as F

from flowspark.operators import sample


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, "one" if i == 0 else "three" if i < 4 else "many") for i in range(1004)]
    return spark.createDataFrame(rows, "id long, label string").cache()


def counts(spark, **n):
    return spark.createDataFrame(list(n.items()), "label string, n long")


def quotas(df):
    return {r["label"]: r["quota"] for r in df.collect()}


def test_quota_sums_to_budget(spark):
    got = quotas(sample.largest_remainder(counts(spark, a=10, b=20, c=70), "label", 33))
    assert sum(got.values()) == 33 and got == {"a": 3, "b": 7, "c": 23}


def test_quota_minima_exceed_budget(spark):
    assert quotas(sample.largest_remainder(counts(spark, a=1, b=3, c=1000), "label", 10, 50)) == {"a": 1, "b": 3, "c": 50}


def test_quota_caps_at_class_size(spark):
    assert quotas(sample.largest_remainder(counts(spark, a=2, b=3), "label", 100)) == {"a": 2, "b": 3}


def test_equal_fractions_prefer_larger_then_label(spark):
    assert quotas(sample.largest_remainder(counts(spark, a=5, b=5), "label", 3)) == {"a": 2, "b": 1}


def test_synthetic_quota(spark):
    got = quotas(sample.synthetic_quota(counts(spark, big=1000, small=20), "label", 0.5))
    assert got["small"] >= 10 and sum(got.values()) == 510
    assert sum(quotas(sample.synthetic_quota(counts(spark, a=3), "label", 0.1)).values()) == 1
    assert quotas(sample.synthetic_quota(counts(spark, a=3, b=9), "label", 7)) == {"a": 4, "b": 3}


def test_folds_are_balanced_and_repeatable(labelled):
    folds = sample.stratified_folds(labelled, "label", ["id"], 10)
    sizes = folds.groupBy("label", "fold").count().filter("label = 'many'").agg(F.max("count") - F.min("count")).first()[0]
    assert sizes <= 1 and folds.count() == 1004
    assert sorted(folds.collect()) == sorted(sample.stratified_folds(labelled.repartition(13), "label", ["id"], 10).collect())


def test_fold_count(spark, labelled):
    assert sample.fold_count(labelled, "label", 10) is None
    assert sample.fold_count(labelled.filter("label != 'one'"), "label", 10) == 3
    assert sample.fold_count(labelled.limit(0), "label", 10) is None


def test_split_is_disjoint_and_whole(labelled):
    parts = sample.stratified_split(labelled, "label", ["id"], 0.25)
    assert parts.count() == 1004 and parts.filter("part = 'test'").count() == 251
    assert parts.select("id").distinct().count() == 1004


def test_sample_takes_all_of_small_classes(labelled):
    got = {r["label"]: r["count"] for r in sample.class_aware_sample(labelled, "label", ["id"], 100, 50).groupBy("label").count().collect()}
    assert got == {"one": 1, "three": 3, "many": 96}


def test_capped_sample(labelled):
    assert sample.capped_sample(labelled, ["id"], 10).count() == 10
    assert sample.capped_sample(labelled, ["id"], 10_000).count() == 1004
