import random

import pytest

from flowspark.operators import windows


def brute(rows, length, stride, minimum, mixed):
    out = []
    for source in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == source), key=lambda r: (r[1], r[2]))
        if len(group) < minimum:
            continue
        for start in range(0, len(group) - length + 1, stride):
            part = group[start:start + length]
            several = len({r[4] for r in part}) > 1
            if not (several and mixed == "drop"):
                out.append((source, start, part[-1][4], several, tuple(r[3] for r in part)))
    return sorted(out)


def got(df):
    return sorted((r["s"], r["start"], r["label"], r["mixed"], tuple(f[0] for f in r["features"])) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    hot = [("hot", i // 2, i, float(i), rng.choice("ab")) for i in range(300)]
    return hot + [("exact", i, i, float(i), "a") for i in range(4)] + [("short", i, i, float(i), "a") for i in range(3)]


@pytest.mark.parametrize("length,stride,minimum,mixed", [(4, 1, None, "keep"), (4, 3, None, "drop"), (3, 2, 4, "keep"), (2, 5, None, "keep"), (4, 4, 100, "keep")])
@pytest.mark.parametrize("block", [4096, 7])
def test_windows_equal_loops(spark, rows, monkeypatch, length, stride, minimum, mixed, block):
    monkeypatch.setattr(windows, "BLOCK_ROWS", block)
    df = spark.createDataFrame(rows, "s string, at int, id int, x double, label string").repartition(5)
    made = windows.row_windows(df, "s", "at", ["id"], ["x"], "label", length, stride, minimum, mixed)
    assert got(made) == brute(rows, length, stride, minimum or length, mixed)


def test_reject_mixed(spark, rows):
    df = spark.createDataFrame(rows, "s string, at int, id int, x double, label string")
    with pytest.raises(Exception, match="mixed labels"):
        windows.row_windows(df, "s", "at", ["id"], ["x"], "label", 4, mixed="reject").collect()


@pytest.mark.parametrize("options", [{"length": 1}, {"length": 3, "stride": 0}, {"length": 3, "minimum": 2}, {"length": 3, "mixed": "x"}])
def test_bad_arguments(spark, rows, options):
    df = spark.createDataFrame(rows[:1], "s string, at int, id int, x double, label string")
    with pytest.raises(ValueError):
        windows.row_windows(df, "s", "at", ["id"], ["x"], "label", **options)
