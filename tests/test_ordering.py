"""Ranks and running totals in buckets equal the plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowspark.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value a third of them; a null group and null values too."""
    rng = random.Random(1)
    rows = [(i, None if i % 97 == 0 else ("hot" if i % 10 else f"g{i % 30}"),
             None if i % 53 == 0 else (5.0 if i % 3 == 0 else float(rng.randint(0, 500)))) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(7).cache()


def test_hash_ranked_equals_window(skewed):
    out = ordering.hash_ranked(skewed, ["g"], ["id"], 42)
    w = Window.partitionBy("g").orderBy(ordering.hash_key(42, ["id"]), "id")
    plain = skewed.withColumn("rn", F.row_number().over(w))
    assert sorted(out.select("id", "rn").collect()) == sorted(plain.select("id", "rn").collect())


def test_hash_ranked_without_groups(skewed):
    assert sorted(r["rn"] for r in ordering.hash_ranked(skewed, [], ["id"], 1).collect()) == list(range(1, 3001))


def test_hash_take_equals_window(skewed):
    quotas = skewed.groupBy("g").agg((F.count(F.lit(1)) / 3).cast("long").alias("quota"))
    got = ordering.hash_take(skewed, ["g"], ["id"], 7, quotas)
    ranked = ordering.hash_ranked(skewed, ["g"], ["id"], 7).join(quotas.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")))
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in ranked.filter("rn <= quota").collect())
    assert got.columns == skewed.columns


def test_value_ranked_equals_window(skewed):
    out = ordering.value_ranked(skewed, ["g"], "v", ["id"], size="n")
    w = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_last(), "id")
    plain = skewed.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g")))
    assert sorted(out.select("id", "rn", "n").collect()) == sorted(plain.select("id", "rn", "n").collect())


@pytest.mark.parametrize("how,inclusive", [("sum", True), ("sum", False), ("max", True), ("max", False)])
def test_running_equals_window(skewed, how, inclusive):
    counted = skewed.filter("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    out = ordering.running(counted, ["g"], "v", ["n"], how, inclusive)
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    agg = {"sum": lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)), "max": lambda c: F.max(c).over(w)}[how]
    plain = counted.withColumn("run_n", agg("n"))
    key = lambda r: (r["g"] or "", r["v"], r["run_n"] if r["run_n"] is not None else -1)
    assert sorted(map(key, out.collect())) == sorted(map(key, plain.collect()))


def test_quantiles_equal_exact_percentile(skewed):
    out = ordering.exact_quantiles(skewed, ["g"], "v", [0.0, 0.25, 0.5, 1.0])
    plain = skewed.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.0), F.lit(0.25), F.lit(0.5), F.lit(1.0))).alias("q"))
    want = {(r["g"], s): q for r in plain.collect() for s, q in zip((0.0, 0.25, 0.5, 1.0), r["q"])}
    got = {(r["g"], r["share"]): r["q"] for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_split_points_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert ordering.split_points(empty, "v") == []
    assert ordering.value_ranked(empty, [], "v", []).count() == 0


def test_numbered_copies(spark):
    df = spark.createDataFrame([("a", 1)] * 25 + [("b", None)] * 3 + [("c", 2)], "k string, v int")
    out = ordering.numbered_copies(df, step=10)
    got = {}
    for r in out.collect():
        got.setdefault(r["k"], []).append(r["copy"])
    assert {k: sorted(v) for k, v in got.items()} == {"a": list(range(25)), "b": [0, 1, 2], "c": [0]}


def test_marks_without_broadcast(skewed, monkeypatch):
    """Side tables above the size bound are joined, with the same rows."""
    quotas = skewed.groupBy("g").agg((F.count(F.lit(1)) / 3).cast("long").alias("quota"))
    small = sorted(ordering.hash_marked(skewed, ["g"], ["id"], 7, quotas).collect(), key=str)
    monkeypatch.setattr(ordering, "bounded", lambda df: df)
    assert sorted(ordering.hash_marked(skewed, ["g"], ["id"], 7, quotas).collect(), key=str) == small


def test_hot_value_is_cut_by_ties(spark):
    """Most rows share one order value: the largest range still holds a fraction of them."""
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") * 1.0).otherwise(700.0).alias("v"))
    spread = ordering._quantiles(df, "v")
    d = ordering.with_bucket(df, "v", sorted(set(spread)))
    cut = ordering._with_tie_buckets(d, "v", "id", [700.0])
    assert cut.groupBy("_b").count().agg(F.max("count")).first()[0] < 500
    out = ordering.value_ranked(df, [], "v", ["id"])
    plain = df.withColumn("rn", F.row_number().over(Window.orderBy("v", "id")))
    assert sorted(out.select("id", "rn").collect()) == sorted(plain.select("id", "rn").collect())
