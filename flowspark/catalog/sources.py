"""Scans and sinks: every query writes a table out and reads it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.catalog.base import query, table
from flowspark.session import parallelism, scratch_path
from flowspark.sources import readers, results, writers

CHECK = """SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity,
  max(l_extendedprice) AS top_price, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_returnflag"""


PART_ROWS = 1_000_000  # rows in one part of a distinct count


def check(df, parts):
    """Per class: rows, an exact sum, an extreme and a distinct count, its keys dealt into `parts`."""
    rows = df.select("l_returnflag", F.col("l_quantity").cast("decimal(18,2)").alias("quantity"),
                     F.col("l_extendedprice").cast("double").alias("price"), F.col("l_orderkey").cast("long").alias("order"))
    return rows.repartition(parts, "l_returnflag", "order").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").cast("double").alias("quantity"),
        F.max("price").alias("top_price"), F.count_distinct("order").alias("orders"))


def parts_of(df):
    """Parts for `check`: as many as the session asks for, and more the more rows there are, so that none grows with the table."""
    return max(parallelism(df.sparkSession), -(-df.count() // PART_ROWS))


@query("s1_csv_scan", CHECK)
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "csv")
    df = table(spark, sf_dir, "lineitem")
    writers.write_csv(df.toDF(*[f" {c} " for c in df.columns]), path)
    return check(readers.read_flows(spark, path), parts_of(df))


@query("s1_quoted_text", """SELECT 'documents' AS source, doc_id AS id, md5(text) AS digest FROM documents
  UNION ALL SELECT 'pages', page_id, md5(html) FROM pages UNION ALL SELECT 'conversations', conv_id * 1000 + turn, md5(text) FROM conversations""")
def quoted_text(spark, sf_dir):
    out = None
    for name, key, column in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "turn_id", "text")):
        path = scratch_path(spark, "quoted")
        rows = table(spark, sf_dir, name)
        rows = rows.withColumn(key, F.col("conv_id") * 1000 + F.col("turn")) if name == "conversations" else rows
        writers.write_csv(rows.select(key, F.col(column).cast("string").alias(column)), path)
        back = readers.read_flows(spark, path, T.StructType().add(key, T.LongType()).add(column, T.StringType()))
        part = back.select(F.lit(name).alias("source"), F.col(key).alias("id"), F.md5(F.col(column).cast("binary")).alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


def _halves(df):
    return [df.where(F.col("c_custkey") % 2 == i) for i in (0, 1)]


@query("s1_mixed_headers", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS c_nationkey FROM customer")
def mixed_headers(spark, sf_dir):
    path = scratch_path(spark, "headers")
    even, odd = _halves(table(spark, sf_dir, "customer"))
    writers.write_csv(even.select("c_nationkey", "c_custkey", "c_name"), f"{path}/even")
    writers.write_csv(odd.select("c_name", "c_custkey"), f"{path}/odd")
    back = readers.read_flows(spark, f"{path}/*")
    return back.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("long"))


@query("s1_mixed_encodings", "SELECT c_custkey, 'é ' || c_name AS c_name FROM customer")
def mixed_encodings(spark, sf_dir):
    path = scratch_path(spark, "encodings")
    for i, half in enumerate(_halves(table(spark, sf_dir, "customer"))):
        named = half.select("c_custkey", F.concat(F.lit("é "), "c_name").alias("c_name"))
        named.write.option("header", True).option("encoding", readers.ENCODINGS[i]).csv(f"{path}/{i}")
    return readers.read_flows(spark, f"{path}/*").select(F.col("c_custkey").cast("long"), "c_name")


@query("s2_tab_scan", CHECK)
def tab_scan(spark, sf_dir):
    path = scratch_path(spark, "tab")
    df = table(spark, sf_dir, "lineitem")
    writers.write_tabbed(df, path)
    return check(readers.read_tabbed(spark, path), parts_of(df))


@query("s3_parquet_scan", CHECK)
def parquet_scan(spark, sf_dir):
    df = readers.read_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return check(df, parts_of(df))


@query("s4_s9_arff_round_trip", CHECK)
def arff_round_trip(spark, sf_dir):
    path = scratch_path(spark, "arff")
    df = table(spark, sf_dir, "lineitem")
    writers.write_arff(df, path)
    return check(readers.read_arff(spark, path), parts_of(df))


@query("s5_key_value_scan", """SELECT n_name AS key, 'region ' || n_regionkey || ': ' || n_nationkey AS value FROM nation
  UNION ALL SELECT 'plain ' || n_nationkey, NULL FROM nation""")
def key_value_scan(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    lines = nation.select(F.explode(F.array(
        F.concat(F.lit("  "), "n_name", F.lit(" : region "), F.col("n_regionkey").cast("string"), F.lit(": "),
                 F.col("n_nationkey").cast("string")),
        F.concat(F.lit("plain "), F.col("n_nationkey").cast("string")),
        F.lit("# a comment"), F.lit("   "))).alias("value"))
    path = scratch_path(spark, "stats")
    lines.write.text(path)
    return readers.read_stats(spark, path)


@query("s6_common_column_scan", """SELECT 'customer' AS source, count(*) AS n, round(sum(CAST(c_acctbal AS DECIMAL(18, 2))), 2)::DOUBLE AS balance
  FROM customer UNION ALL SELECT 'supplier', count(*), round(sum(CAST(s_acctbal AS DECIMAL(18, 2))), 2)::DOUBLE FROM supplier""")
def common_column_scan(spark, sf_dir):
    root = scratch_path(spark, "many")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    writers.write_csv(customer.toDF(*[c[2:] for c in customer.columns]), f"{root}/customer")
    writers.write_csv(supplier.toDF(*[c[2:] for c in supplier.columns]), f"{root}/supplier")
    paths = readers.discover(spark, root, ".csv", order="path")
    df = readers.read_common(spark, paths, source="path").withColumn("source", F.element_at(F.split("path", "/"), -2))
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"),
                                    F.sum(F.col("acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))


@query("s8_sink_formats", CHECK.replace("SELECT l_returnflag", "SELECT 'csv' AS sink, l_returnflag")
       + " UNION ALL " + CHECK.replace("SELECT l_returnflag", "SELECT 'parquet' AS sink, l_returnflag")
       + " UNION ALL " + CHECK.replace("SELECT l_returnflag", "SELECT 'txt' AS sink, l_returnflag"))
def sink_formats(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_orderkey")
    out, parts = None, parts_of(df)
    for kind in ("csv", "parquet", "txt"):
        path = scratch_path(spark, kind)
        writers.WRITERS[kind](df, path)
        writers.WRITERS[kind](df.limit(0), path)  # an existing target stays
        back = check(writers.READERS[kind](spark, path), parts).withColumn("sink", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


@query("s10_mirrored_conversion", """SELECT kind, part, n FROM (
  SELECT trim(c_mktsegment) AS part, count(*) AS n FROM customer GROUP BY 1), (VALUES ('csv'), ('txt'), ('arff')) AS k(kind)""")
def mirrored_conversion(spark, sf_dir):
    source, target = scratch_path(spark, "from"), scratch_path(spark, "to")
    padded = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))
    padded.coalesce(1).write.parquet(f"{source}/day=1")
    out = None
    for path in writers.convert(spark, source, target):
        kind = path.rsplit(".", 1)[-1]
        part = (writers.READERS[kind](spark, path).groupBy(F.col("c_mktsegment").alias("part"))
                .agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "part", "n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("s10_in_place", "SELECT kind, n_nationkey, n_name FROM nation, (VALUES ('csv'), ('txt'), ('arff'), ('parquet')) AS k(kind)")
def converted_in_place(spark, sf_dir):
    root = scratch_path(spark, "place")
    writers.write_parquet(table(spark, sf_dir, "nation"), f"{root}/nation.parquet")
    writers.convert(spark, root, root)
    writers.convert(spark, root, root)  # all formats are there: nothing changes
    parts = [writers.READERS[kind](spark, f"{root}/{found}").select(F.lit(kind).alias("kind"), F.col("n_nationkey").cast("long"), "n_name")
             for found, kind in writers.inputs(spark, root)]
    return reduce(DataFrame.unionByName, parts)


RESULT_ROWS = """SELECT 'd' || o_custkey AS dataset_path, o_orderpriority AS tool, o_totalprice AS f1,
  strftime(o_orderdate, '%Y-%m-%d_%H_%M_%S') AS stamp FROM orders WHERE o_orderstatus {s} 'P'"""


def _results(spark, sf_dir, new):
    """Orders in state P as the new batch, all others as the stored table."""
    return table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "P") == F.lit(new)).select(
        F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("dataset_path"),
        F.col("o_orderpriority").alias("tool"), F.col("o_totalprice").alias("f1"),
        F.date_format("o_orderdate", results.STAMP_FORMAT).alias("stamp"))


@query("s11_replace_rows", f"""WITH old AS ({RESULT_ROWS.format(s='<>')}), new AS ({RESULT_ROWS.format(s='=')})
  SELECT * FROM old WHERE dataset_path NOT IN (SELECT dataset_path FROM new) UNION ALL SELECT * FROM new""")
def replace_rows(spark, sf_dir):
    path = scratch_path(spark, "results")
    results.swap_in(spark, _results(spark, sf_dir, False), path)
    results.swap_in(spark, results.replace_rows(results.load_results(spark, path), _results(spark, sf_dir, True)), path)
    return results.load_results(spark, path)


@query("s11_append_rows", f"""WITH both_rows AS (SELECT dataset_path, stamp, f1 FROM ({RESULT_ROWS.format(s='<>')})
  UNION ALL SELECT dataset_path, stamp, NULL FROM ({RESULT_ROWS.format(s='=')}))
  SELECT dataset_path, stamp AS timestamp, f1, NULL::VARCHAR AS note FROM both_rows""")
def append_rows(spark, sf_dir):
    old = _results(spark, sf_dir, False).withColumnRenamed("stamp", "timestamp")
    new = _results(spark, sf_dir, True).withColumnRenamed("stamp", "timestamp").drop("f1")
    merged = results.append_rows(old, new, ["dataset_path", "timestamp", "f1", "note"])
    return merged.withColumn("f1", F.col("f1").cast("double"))
