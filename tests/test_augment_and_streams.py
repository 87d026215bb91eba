import math
import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators import augment, profile, windows
from flowspark.session import scratch_path
from flowspark.streaming import jobs
from flowspark.streaming.windows import keep_row_windows


def test_one_source_at_half(spark):
    source = spark.createDataFrame([(1, 10, "A"), (2, 20, "B"), (3, 30, "A"), (4, 40, "B")], "feature_a int, feature_b int, label string")
    out = augment.augmented_union({"s": source}, 4, "label", ["feature_a"], 0.5)
    assert out.count() == 2


def test_sources_share_the_budget(spark):
    make = lambda at, label: spark.createDataFrame([(at + i, 10 + at + i, label) for i in range(4)], "feature_a int, feature_b int, label string")
    out = augment.augmented_union({"one": make(1, "A"), "two": make(5, "B")}, 8, "label", ["feature_a"], 0.5)
    assert out.columns == ["feature_a", "feature_b", "attack_type"]
    assert out.count() == 4 and {r["attack_type"] for r in out.collect()} == {"A", "B"}


def test_uniform_quotas():
    assert augment.uniform_quotas({"a": 10, "b": 1, "c": 10}, 8) == {"a": 3, "b": 1, "c": 2}


@pytest.fixture(scope="module")
def balanced(spark):
    return spark.createDataFrame([(i, float(i), 3.0 * i, "AB"[i % 2]) for i in range(20)], "id long, feature_a double, feature_b double, attack_type string")


def test_synthetic_rows_lie_between_parents(balanced):
    made = augment.synthetic_rows(balanced, "attack_type", ["feature_a", "feature_b"], ["id"], 0.5, small_below=0)
    rows = made.collect()
    assert len(rows) == 10 and {r["attack_type"] for r in rows} == {"A", "B"}
    assert all(0 <= r["feature_a"] <= 19 and math.isclose(r["feature_b"], 3 * r["feature_a"], abs_tol=1e-9) for r in rows)
    again = augment.synthetic_rows(balanced.repartition(5), "attack_type", ["feature_a", "feature_b"], ["id"], 0.5, small_below=0)
    assert sorted(rows) == sorted(again.collect())


def test_synthetic_rows_of_one_class_and_of_none(balanced):
    one = balanced.filter("attack_type = 'A'")
    assert augment.synthetic_rows(one, "attack_type", ["feature_a"], ["id"], 0.2).count() == 2
    assert augment.synthetic_rows(one.limit(0), "attack_type", ["feature_a"], ["id"], 0.2).count() == 0


def test_union_and_totals(balanced):
    made = augment.synthetic_rows(balanced, "attack_type", ["feature_a", "feature_b"], ["id"], 0.5)
    both = augment.union_aligned(balanced, made.drop("id"))
    assert both.columns == ["feature_a", "feature_b", "attack_type"]
    augment.validate_totals(balanced, both, 10)
    with pytest.raises(ValueError):
        augment.validate_totals(balanced, both, 9)


def test_ks_of_equal_and_disjoint(spark):
    a = spark.createDataFrame([(float(i),) for i in range(50)], "x double")
    b = a.select((F.col("x") + 100).alias("x"))
    assert augment.ks_distance(a, a, ["x"]).first()["ks"] == 0.0
    assert augment.ks_distance(a, b, ["x"]).first()["ks"] == 1.0


@pytest.fixture()
def landed(spark):
    rng = random.Random(11)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", None if i % 29 == 0 else float(rng.randint(0, 9)), rng.choice("ab")) for i in range(300)]
    df = spark.createDataFrame(rows, "at long, s string, x double, label string")
    folder = scratch_path(spark, "landing")
    for low in range(0, 300, 100):
        df.filter(f"at >= {low} and at < {low + 100}").coalesce(1).write.mode("append").parquet(folder)
    return df, jobs.landing(spark, folder, df.schema, files=1)


def test_stream_profile_equals_batch(spark, landed):
    df, stream = landed
    state = scratch_path(spark, "state")
    jobs.keep_profile(stream, "label", state)
    assert len([c for c in spark.read.parquet(state).select("batch").distinct().collect()]) == 3
    assert jobs.current_profile(spark, state, df, "label").collect() == profile.profile(df, "label").collect()


def test_stream_cleaning_equals_batch(spark, landed):
    df, stream = landed
    out = jobs.run_to_files(jobs.clean_stream(stream), scratch_path(spark, "clean"))
    assert sorted(out.collect()) == sorted(df.filter("x is not null").collect())


@pytest.mark.parametrize("length,stride,minimum,mixed", [(4, 1, None, "keep"), (4, 3, 30, "drop"), (2, 5, None, "keep")])
def test_stream_windows_equal_batch(spark, landed, length, stride, minimum, mixed):
    df, stream = landed
    full, flow = df.na.fill({"x": 0.0}), stream.na.fill({"x": 0.0})
    batch = windows.row_windows(full, "s", "at", [], ["x"], "label", length, stride, minimum, mixed)
    out = keep_row_windows(flow, scratch_path(spark, "rows"), "s", "at", [], ["x"], "label", length, stride, minimum, mixed)
    key = lambda r: (r["s"], r["start"])
    assert sorted(out.select(batch.columns).collect(), key=key) == sorted(batch.collect(), key=key)


def test_stream_windows_repeat_and_forget(spark):
    """A batch that runs again replaces itself; a source without rows for two batches counts from 0 again; null labels stay null."""
    folder, path = scratch_path(spark, "landing"), scratch_path(spark, "rows")
    batches = [[(0, "a", 1.0, None), (1, "a", 2.0, "x"), (2, "b", 1.0, "x")], [(3, "b", 2.0, "y")], [(4, "b", 3.0, "y")], [(5, "a", 5.0, "x"), (6, "a", 6.0, "x")]]
    schema = "at long, s string, x double, label string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: keep_row_windows(jobs.landing(spark, folder, spark.createDataFrame([], schema).schema, files=1), path, "s", "at", [], ["x"], "label", 2, idle=2)
    want = [("a", 0, [[1.0], [2.0]], "x", True), ("a", 0, [[5.0], [6.0]], "x", False), ("b", 0, [[1.0], [2.0]], "y", True), ("b", 1, [[2.0], [3.0]], "y", False)]
    assert sorted(map(tuple, run().collect())) == want
    assert sorted(map(tuple, run().collect())) == want  # nothing new has landed
    spark.createDataFrame([(9, "a", 7.0, "x")], schema).coalesce(1).write.mode("append").parquet(folder)
    assert ("a", 1, [[6.0], [7.0]], "x", False) in list(map(tuple, run().collect()))


def _minutes(spark, rows):
    return spark.createDataFrame(rows, "m long, k string").selectExpr("timestamp_seconds(1700000000 + 60 * m) AS ts", "k")


def test_window_counts_keep_open_windows_and_drop_late_rows(spark):
    folder, path = scratch_path(spark, "landing"), scratch_path(spark, "windows")
    batches = [[(0, "a"), (1, "a"), (70, "b")], [(2, "a"), (65, "b"), (130, "a")], [(131, "a"), (60, "b"), (125, "b"), (3, "a")]]
    for rows in batches:
        _minutes(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.landing(spark, folder, _minutes(spark, []).schema, files=1)
    found = jobs.keep_class_counts(stream, path, "ts", "k", "60 minutes", late="10 minutes").collect()
    base = min(r["start"] for r in found)
    hours = {((r["start"] - base).total_seconds() // 3600, r["k"]): r["n"] for r in found}
    want = {}
    for m, k in sum(batches, []):
        # 1700000000 is 13 min 20 s past the hour; the third batch knows the watermark of the first, minute 60: (3, "a") is late, (60, "b") is not
        hour = (800 + 60 * m) // 3600
        if (m, k) != (3, "a"):
            want[(float(hour), k)] = want.get((float(hour), k), 0) + 1
    assert hours == want and want[(2.0, "a")] == 2


def _plain_sessions(rows, gap):
    out = []
    for k in sorted({k for _, k in rows}):
        for m in sorted(m for m, x in rows if x == k):
            if out and out[-1][0] == k and m < out[-1][2]:
                out[-1] = (k, out[-1][1], m + gap, out[-1][3] + 1)
            else:
                out.append((k, m, m + gap, 1))
    return out


def test_sessions_join_over_batches(spark):
    rng = random.Random(5)
    rows = sorted((rng.randrange(3000), rng.choice("aaab")) for _ in range(250)) + [(3100, "a"), (3130, "a")]
    folder, path = scratch_path(spark, "landing"), scratch_path(spark, "sessions")
    for part in (rows[:90], rows[90:170], rows[170:]):
        _minutes(spark, part).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: jobs.keep_sessions(jobs.landing(spark, folder, _minutes(spark, []).schema, files=1), path, "ts", ["k"], "30 minutes")
    plain = lambda d: sorted((r["k"], int((r["start"].timestamp() - 1700000000) // 60), int((r["end"].timestamp() - 1700000000) // 60), r["n"]) for r in d.collect())
    want = _plain_sessions(rows, 30)
    assert plain(run()) == want and plain(jobs.class_counts_in_sessions(_minutes(spark, rows), "ts", ["k"], "30 minutes")) == want
    _minutes(spark, [(3135, "a"), (5, "b")]).coalesce(1).write.mode("append").parquet(folder)  # one joins an open session, one is late
    assert plain(run()) == _plain_sessions([*rows, (3135, "a")], 30)
