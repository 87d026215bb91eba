import math

import pytest
from pyspark.sql import functions as F

from flowspark.functions import names
from flowspark.operators import clean, profile

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [("null", None, 1.0, "a"), ("nan", NAN, 1.0, "a"), ("inf", INF, 1.0, "a"), ("-inf", -INF, 1.0, "b"),
            ("big", 1e39, 1.0, "b"), ("clean", 2.0, 1.0, "b"), ("clean2", 4.0, 1.0, None)]
    return spark.createDataFrame(rows, "id string, x double, flat double, label string")


def ids(df):
    return {r["id"] for r in df.collect()}


def test_row_rules(dirty):
    assert ids(clean.drop_missing(dirty)) == {"inf", "-inf", "big", "clean"}
    assert ids(clean.drop_infinite(dirty)) == {"null", "nan", "big", "clean", "clean2"}
    assert ids(clean.drop_unusable(dirty)) == {"big", "clean"}
    assert ids(clean.drop_unusable(dirty, "features", "label")) == {"big", "clean", "clean2"}
    assert ids(clean.drop_out_of_range(dirty)) == {"clean"}


def test_nothing_left_is_an_error(dirty):
    with pytest.raises(ValueError):
        clean.drop_out_of_range(dirty.filter("id = 'inf'"), check=True)


def test_unknown_policy(dirty):
    with pytest.raises(ValueError):
        clean.drop_unusable(dirty, "some")


def test_constant_columns_stay_when_text(spark, dirty):
    assert clean.constant_columns(dirty) == ["flat"]
    df = spark.createDataFrame([(1, "s", None), (1, "s", 2)], "a int, t string, n int")
    assert clean.constant_columns(df) == ["a", "n"]
    assert clean.drop_constant(df).columns == ["t"]
    assert clean.clean(dirty).columns == ["id", "x", "label"]


def test_empty_table(spark, dirty):
    empty = dirty.limit(0)
    assert clean.drop_unusable(empty).count() == 0
    assert clean.constant_columns(empty) == []
    assert clean.exact_medians(empty, ["x"]) == {"x": None}
    assert profile.profile(empty, "label").count() == 1 or profile.profile(empty, "label").count() == 0


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0, 1.0, 2.0], [5.0] * 10, [1.0, 1.0, 9.0, 9.0], list(map(float, range(1001)))])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None, NAN, INF]], "x double")
    ordered = sorted(values)
    n = len(ordered)
    want = ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2
    assert clean.exact_medians(df, ["x"])["x"] == want


def test_median_impute(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, INF, None), (3, None, None), (4, 3.0, None)], "id int, x double, gone double")
    rows = {r["id"]: r["x"] for r in clean.median_impute(df, ["x", "gone"]).collect()}
    assert rows == {1: 1.0, 2: 2.0, 3: 2.0, 4: 3.0}
    assert clean.median_impute(df, ["x", "gone"], exact=False).columns == ["id", "x"]


def test_coerce_numeric(spark):
    mixed = spark.createDataFrame([(1, "x")], "n int, t string")
    assert clean.coerce_numeric(mixed).columns == ["n"]
    text = spark.createDataFrame([("1", "x"), (" 2 ", "y")], "a string, b string")
    assert [r["a"] for r in clean.coerce_numeric(text).collect()] == [1.0, 2.0]


def test_normalize_types(spark):
    df = spark.createDataFrame([("1", "true", "x", b"a\xff", None), ("2.5", "FALSE", "1", b"b", None)],
                               "n string, b string, t string, raw binary, empty string")
    assert [t for _, t in clean.normalize_types(df).dtypes] == ["double", "boolean", "string", "string", "string"]


def test_scale_round_trip(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, flat double")
    stats = clean.scale_stats(df, ["x", "flat"])
    scaled = clean.scale(df, stats)
    assert sorted(r["x"] for r in scaled.collect()) == [-1.0, 1.0]
    assert {r["flat"] for r in scaled.collect()} == {0.0}
    assert sorted(clean.unscale(scaled, stats).collect()) == sorted(df.collect())


def test_sanitize_names():
    assert names.sanitize_names(['a{b}:c,"d"\\e', "_x__y_", "Flow Bytes/s"]) == ["a_b_c_d_e", "x_y", "Flow Bytes/s"]
    with pytest.raises(ValueError):
        names.sanitize_names(["a:b", "a,b"])


def test_normalized_text():
    assert names.normalized_text("﻿  Source   IP​") == "source ip"


def test_label_rules(spark):
    make = lambda *columns: spark.createDataFrame([], ", ".join(f"`{c}` double" for c in columns))
    df = make("a", " Label ", "class")
    assert names.resolve_label(df, "main") == "class"
    assert names.resolve_label(df, "descriptor") == " Label "
    assert names.resolve_label(df, "alias") == "class"
    assert names.resolve_label(df, "last") == "class"
    assert names.resolve_label(make("a", "my_target_x"), "descriptor") == "my_target_x"
    assert names.resolve_label(make("a", "b"), "main") is None
    assert names.resolve_label(spark.createDataFrame([], "a double, z string"), "descriptor") == "z"
    with pytest.raises(ValueError):
        names.resolve_label(df, "other")


def test_profile_of_dirty_frame(spark, dirty):
    row = profile.profile(dirty, "label").first()
    assert (row["original_num_rows"], row["rows_after_nan_removal"], row["samples"]) == (7, 4, 2)
    assert row["removed_zero_variance_features"] == 1 and row["features"] == 3
    assert row["class_distribution"] == "{b: 2 (100%)}" and row["classes"] == "b: 2 (100.00%)"
    assert row["missing_values"] == "x (2), label (1)"


def test_merge_of_chunks_equals_whole(spark, dirty):
    state = profile.profile_state(dirty, "label")
    parts = None
    for some in (["null", "clean"], ["nan", "inf", "big"], ["-inf", "clean2"]):
        part = profile.profile_state(dirty.filter(F.col("id").isin(some)), "label")
        parts = part if parts is None else parts.unionByName(part)
    key = lambda r: str(r["_class"])
    merged = sorted(profile.merge_states(parts).select(state.columns).collect(), key=key)
    assert merged == sorted(state.collect(), key=key)


def test_summary_average(spark, dirty):
    rows = profile.preprocessing_summary(profile.profile(dirty.withColumn("file", F.col("label")), "label", ["file"]).na.fill({"file": "none"}), "file").collect()
    assert [r["filename"] for r in rows][-1] == "AVERAGE" and tuple(rows[0].asDict()) == profile.SUMMARY_COLUMNS
    assert math.isclose(rows[-1]["original_num_rows"], round(7 / 3, 6))


def test_chunk_bounds():
    assert profile.chunk_bounds(10, 100, 4) == (3, 34)
    assert profile.chunk_bounds(3, 100, 4) == (1, 100)


def test_wide_rows_are_tested_like_narrow_ones(spark, dirty, monkeypatch):
    want = (ids(clean.drop_missing(dirty)), ids(clean.drop_infinite(dirty)), ids(clean.drop_unusable(dirty)))
    monkeypatch.setattr(clean, "WIDE", 0)
    assert (ids(clean.drop_missing(dirty)), ids(clean.drop_infinite(dirty)), ids(clean.drop_unusable(dirty))) == want


def test_median_when_the_sample_misleads(spark, monkeypatch):
    monkeypatch.setattr(clean, "SKETCH_ROWS", 3)
    df = spark.range(2001).select((F.col("id") * 1.0).alias("x"), F.when(F.col("id") < 1500, 7.0).otherwise(9.0).alias("y"))
    assert clean.exact_medians(df, ["x", "y"]) == {"x": 1000.0, "y": 7.0}
