import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowspark.plans import deep_forest, models
from flowspark.session import scratch_path


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] > 0).astype(int) + (x[:, 3] > 0.5)
    rows = [(i, float(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "id long, y double, v array<double>").select("id", "y", array_to_vector("v").alias("features")).cache()


def share_right(df):
    return df.agg(F.avg((F.col("y") == F.col("prediction")).cast("int"))).first()[0]


@pytest.mark.parametrize("limit", [50_000, 100])
def test_deep_forest_is_a_table(table, monkeypatch, limit):
    monkeypatch.setattr(deep_forest, "LOCAL_ROWS", limit)
    learn, held = table.where("id < 400"), table.where("id >= 400")
    model = models.forest(20).fit(learn)
    trees = model.parts.groupBy("t").count().collect()
    assert len(trees) == 20 and (min(r["count"] for r in trees) > 1) == (limit == 100)
    for r in model.parts.collect():  # grown out: leaves are pure, but for rows of equal bins
        share = np.frombuffer(r["share"], np.float32).reshape(-1, 3)[np.frombuffer(r["feature"], np.int32) < 0]
        assert share.max(axis=1).mean() > 0.99
    assert share_right(model.transform(learn)) > 0.98 and share_right(model.transform(held)) > 0.9
    weights = model.featureImportances.toArray()
    assert weights.sum() == pytest.approx(1) and set(weights.argsort()[-2:]) == {0, 3}
    chance = model.transform(held).select(vector_to_array("probability").alias("p")).collect()
    assert all(len(r["p"]) == 3 and sum(r["p"]) == pytest.approx(1, abs=1e-5) for r in chance)


def test_stored_forest_predicts_the_same(spark, table):
    path, flat = scratch_path(spark, "model"), table.select("id", "y", *[F.get(vector_to_array("features"), F.lit(i)).alias(f"f{i}") for i in range(5)])
    fitted = models.pipeline([f"f{i}" for i in range(5)], models.forest(5)).fit(flat)
    fitted.write().overwrite().save(path)
    found = lambda m: {r["id"]: r["prediction"] for r in m.transform(flat).collect()}
    assert found(PipelineModel.load(path)) == found(fitted)


def test_one_class_and_repeated_rows(spark):
    df = spark.createDataFrame([(1.0, [2.0])] * 9, "y double, v array<double>").select("y", array_to_vector("v").alias("features"))
    out = models.forest(3).fit(df).transform(df.union(df)).collect()
    assert len(out) == 18 and {r["prediction"] for r in out} == {1.0}
