"""Rows that must neither be lost nor counted twice, and numbers that must not be clipped."""

import json

from pyspark.sql import functions as F

from flowspark.functions import text
from flowspark.operators import augment, grid
from flowspark.plans import models
from flowspark.streaming import jobs


def land(spark, folder, low, high):
    spark.range(low, high).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label")).write.mode("append").parquet(folder)


def test_second_call_of_a_file_stream_keeps_all_rows(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], "id long, label string").schema
    land(spark, folder, 0, 5)
    assert jobs.run_to_files(jobs.landing(spark, folder, schema), out).count() == 5
    land(spark, folder, 5, 12)
    assert jobs.run_to_files(jobs.landing(spark, folder, schema), out).count() == 12
    assert jobs.run_to_files(jobs.landing(spark, folder, schema), out).count() == 12


def test_second_call_of_a_profile_counts_once(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = spark.createDataFrame([], "id long, label string").schema
    land(spark, folder, 0, 8)

    def rows():
        jobs.keep_profile(jobs.landing(spark, folder, schema), "label", state)
        return jobs.current_profile(spark, state, spark.createDataFrame([], schema), "label").first().asDict()
    first = rows()
    assert rows() == first
    land(spark, folder, 8, 11)
    assert rows() != first


def test_every_row_gets_a_prediction_or_null(spark, tmp_path):
    df = spark.range(40).select("id", F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("x"), (F.col("id") % 7).cast("double").alias("z"),
                                (F.col("id") > 20).cast("double").alias("y"))
    path = str(tmp_path / "model")
    models.pipeline(["x", "z"], models.logistic(rows=32)).fit(df.withColumn(models.LABEL, F.col("y"))).write().overwrite().save(path)
    from pyspark.ml import PipelineModel
    out = models.predict(PipelineModel.load(path), df)
    assert out.count() == 40 and out.where("prediction is null").count() == 8 and out.where("x is null").count() == 8
    assert models.score_stored(path, df, "y").first()["unusable"] == 8


def test_draws_reach_past_32_bits(spark):
    top = spark.range(200).select(augment._draw(1, "p", F.col("id")).alias("d")).agg(F.max("d"), F.min("d")).first()
    assert (1 << 59) < top[0] < (1 << 60) and top[1] >= 0


def test_truncation_of_large_small_and_endless_values(spark):
    df = spark.createDataFrame([(1e20,), (-0.00001,), (float("inf"),), (float("-inf"),), (12.34567,)], "v double")
    assert [r[0] for r in df.select(text.truncated("v")).collect()] == ["100000000000000000000.0000", "0.0000", None, None, "12.3456"]


def test_grid_combinations_against_conditions(spark):
    rows = [("Logistic Regression", {"solver": json.dumps(s), "penalty": json.dumps(p), "l1_ratio": json.dumps(r)})
            for s in ("lbfgs", "saga", "liblinear", "newton-cg") for p in ("l1", "l2", "elasticnet", None) for r in (None, 0.0, 0.5)]
    rows += [("SVM", {"kernel": json.dumps(k), "gamma": json.dumps(g)}) for k in ("linear", "rbf") for g in ("scale", "auto", None, 0.1)]
    rows += [("SVM", {"kernel": json.dumps("linear")}), ("KNN", {"p": "1"})]
    got = spark.createDataFrame(rows, "model string, params map<string,string>").select("model", "params", grid.valid_combination().alias("ok")).collect()
    for r in got:
        p = {k: json.loads(v) for k, v in r["params"].items()}
        if r["model"] == "SVM":
            want = p["kernel"] != "linear" or p.get("gamma") in ("scale", None)
        elif r["model"] == "KNN":
            want = True
        else:
            want = not (p["penalty"] == "l1" and p["solver"] not in ("saga", "liblinear")) and not (p["penalty"] == "elasticnet" and p["solver"] != "saga") \
                and not (p["l1_ratio"] and p["penalty"] != "elasticnet")
        assert r["ok"] == want, (r["model"], p)
