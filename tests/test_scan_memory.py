"""What a task of a scan holds does not grow with its lines."""

from flowspark.catalog import sources
from flowspark.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_grouped_without_a_sort_of_their_lines(spark, tmp_path, monkeypatch):
    for name, text in (("a", "x,y\n1,2\n"), ("b", "x,y\n3,4\n"), ("c", "y,x\n5,6\n"), ("d", 'x,y\n7,"8\n9"\n')):
        (tmp_path / f"{name}.csv").write_text(text)
    plans, frame = [], type(spark.range(0))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: plans.append(plan(self)) or collect(self))
    groups = readers.file_groups(spark, str(tmp_path))
    assert [([p.rsplit("/", 1)[-1] for p in files], open_) for files, _, open_ in groups] == [(["a.csv", "b.csv"], False), (["c.csv"], False), (["d.csv"], True)]
    assert plans and not any("SortAggregate" in p for p in plans)


def test_distinct_keys_are_counted_in_parts_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(sources, "PART_ROWS", 10)
    df = spark.range(1000).selectExpr("'A' l_returnflag", "1.0D l_quantity", "cast(id as double) l_extendedprice", "id % 300 l_orderkey")
    parts = sources.parts_of(df)
    assert parts == 100
    counted = sources.check(df, parts)
    assert ", 100), REPARTITION_BY_NUM" in plan(counted)
    assert [tuple(r) for r in counted.collect()] == [("A", 1000, 1000.0, 999.0, 300)]
