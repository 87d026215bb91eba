import pytest

from flowspark.functions import text
from flowspark.sources import readers, results, writers


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def test_csv_header_trim_and_missing_file(spark, folder):
    with open(f"{folder}/a.csv", "w") as f:
        f.write(" x , Label \n1,a\n2,b\n")
    df = readers.read_flows(spark, f"{folder}/a.csv")
    assert df.columns == ["x", "Label"] and df.count() == 2
    assert readers.read_flows(spark, f"{folder}/none.csv") is None


def test_latin1_fallback(spark, folder):
    with open(f"{folder}/l.csv", "wb") as f:
        f.write("name\ncafé\n".encode("latin-1"))
    assert readers.detect_encoding(spark, f"{folder}/l.csv") == "ISO-8859-1"
    assert readers.read_flows(spark, f"{folder}/l.csv").first()[0] == "café"


def test_arff_types_and_quotes(spark, folder):
    with open(f"{folder}/t.arff", "w") as f:
        f.write("% note\n@RELATION r\n\n@attribute 'a b' NUMERIC\n@ATTRIBUTE n integer\n@attribute c { x , y }\n@attribute s string\n@DATA\n"
                "1.5,2,x,'hi, you'\n?,3, y ,?\n% end\n")
    df = readers.read_arff(spark, f"{folder}/t.arff")
    assert df.dtypes == [("a b", "double"), ("n", "bigint"), ("c", "string"), ("s", "string")]
    rows = sorted(map(tuple, df.collect()), key=lambda r: r[1])
    assert rows == [(1.5, 2, "x", "hi, you"), (None, 3, "y", None)]


def test_arff_round_trip(spark, folder):
    df = spark.createDataFrame([("it's, a \\ test", None, 1), ("?plain", "z", 2)], "t string, u string, n int")
    writers.write_arff(df, f"{folder}/out.arff")
    rows = sorted(map(tuple, readers.read_arff(spark, f"{folder}/out.arff").collect()), key=lambda r: r[2])
    assert rows == [("it's, a \\ test", None, "1"), ("?plain", "z", "2")]


def test_stats_shapes(spark, folder):
    def write(name, content):
        with open(f"{folder}/{name}", "w") as f:
            f.write(content)
        return readers.read_stats(spark, f"{folder}/{name}")

    pairs = write("a.stats", "# head\n\nrate : 5: fast\nlonely\n")
    assert [tuple(r) for r in pairs.collect()] == [("rate", "5: fast"), ("lonely", None)]
    table = write("b.stats", "a,b\n1,2\n")
    assert table.columns == ["a", "b"] and table.count() == 1
    only = write("c.stats", "# one\n# two\n")
    assert only.columns == ["line"] and only.count() == 2


def test_common_columns_and_orders(spark, folder):
    for name, content in (("big.csv", "a,b,c\n1,2,3\n4,5,6\n7,8,9\n"), ("small.csv", "c,a\n9,7\n")):
        with open(f"{folder}/{name}", "w") as f:
            f.write(content)
    paths = readers.discover(spark, folder, ".csv")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["big.csv", "small.csv"]
    assert [p.rsplit("/", 1)[1] for p in readers.discover(spark, folder, ".csv", order="size_asc")] == ["small.csv", "big.csv"]
    assert readers.discover(spark, folder, ".csv", ignore=["big.csv"]) == [paths[1]]
    both = readers.read_common(spark, paths)
    assert both.columns == ["a", "c"] and sorted(map(tuple, both.collect())) == [(1, 3), (4, 6), (7, 9), (7, 9)]
    with open(f"{folder}/other.csv", "w") as f:
        f.write("zzz\n1\n")
    with pytest.raises(ValueError):
        readers.read_common(spark, readers.discover(spark, folder, ".csv"))


def test_sink_leaves_existing_target(spark, folder):
    df = spark.createDataFrame([(1,)], "a int")
    writers.write_csv(df, f"{folder}/x")
    writers.write_csv(df.limit(0), f"{folder}/x")
    assert readers.read_flows(spark, f"{folder}/x").count() == 1


def test_best_first_order(spark):
    rows = spark.createDataFrame([("d", "p", v) for v in ("10", "x", "1", "best")], "dataset string, dataset_path string, run_index string")
    assert [r["run_index"] for r in results.best_first(rows).collect()] == ["best", "1", "10", "x"]


def test_append_orders_bad_stamps_last(spark):
    old = spark.createDataFrame([("a", "2024-01-01_00_00_00"), ("b", "bad")], "k string, timestamp string")
    new = spark.createDataFrame([("c", "2025-01-01_00_00_00")], "k string, timestamp string")
    out = results.append_rows(old, new, ["k", "timestamp", "extra"])
    assert [r["k"] for r in out.collect()] == ["c", "a", "b"] and out.columns == ["k", "timestamp", "extra"]


def test_swap_keeps_backup(spark, folder):
    path = f"{folder}/r"
    assert results.load_results(spark, path) is None
    results.swap_in(spark, spark.createDataFrame([(1,)], "a int"), path)
    merged = results.load_results(spark, path).unionByName(spark.createDataFrame([(2,)], "a int"))
    results.swap_in(spark, merged, path)
    assert sorted(r[0] for r in results.load_results(spark, path).collect()) == [1, 2]
    assert spark.read.parquet(f"{path}.bak").count() == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("1.23456",), ("-1.23456",), ("x",), (None,), ("0",)], "v string")
    assert [r[0] for r in df.select(text.truncated("v")).collect()] == ["1.2345", "-1.2345", None, None, "0.0000"]
    lines = spark.createDataFrame([("1. Flow Duration (RFE Ranking 2)",), ("2. Fwd Packets",), ("note",)], "value string")
    assert [tuple(r) for r in text.features_from_text(lines).collect()] == [(1, "Flow Duration", 2), (2, "Fwd Packets", None)]
    lists = spark.createDataFrame([(2, '["c","a"]'), (1, '["a","b"]')], "i int, f string")
    assert text.merged_list(lists, "f", "i") == ["a", "b", "c"]
    wide = spark.createDataFrame([(1, 2)], "a int, b int")
    assert text.select_features(wide, ["zz"], "known").columns == ["a", "b"]
    with pytest.raises(ValueError):
        text.select_features(wide, ["zz"])


def test_texts_survive_csv_and_arff(spark, folder):
    rows = [("a\\nb", "x\ny"), ("it's \\", "c\r\nd"), ('q "z", w', "  b  "), ("\\\\n", None), ("?!", "e\\\n'")]
    df = spark.createDataFrame(rows, "v string, w string")
    for write, read, name in ((writers.write_csv, readers.read_flows, "t.csv"), (writers.write_arff, readers.read_arff, "t.arff")):
        write(df, f"{folder}/{name}")
        write(df.limit(1), f"{folder}/{name}")  # an existing target stays
        assert {tuple(r) for r in read(spark, f"{folder}/{name}").collect()} == set(rows)


def test_files_are_matched_by_column_name(spark, folder):
    for name, text in (("a", "x,y\n1,2\n"), ("b", "y, x \n20,10\n"), ("c", "x,z\n5,\"caf\u00e9 \"\"s\"\"\nt\"\n"), ("d", "")):
        with open(f"{folder}/{name}.csv", "wb") as f:
            f.write(text.encode("latin-1" if name == "c" else "utf-8"))
    got = readers.read_flows(spark, f"{folder}/*.csv")
    assert {(r["x"], r["y"], r["z"]) for r in got.collect()} == {(1, 2, None), (10, 20, None), (5, None, 'caf\u00e9 "s"\nt')}


def test_conversion_in_place_reads_no_output(spark, folder):
    spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string").write.parquet(f"{folder}/in.parquet")
    assert len(writers.convert(spark, folder, folder)) == 3
    writers.convert(spark, folder, folder)
    assert sorted(writers.inputs(spark, folder)) == [("in.arff", "arff"), ("in.csv", "csv"), ("in.parquet", "parquet"), ("in.txt", "txt")]
    assert readers.read_flows(spark, f"{folder}/in.csv").count() == 2
