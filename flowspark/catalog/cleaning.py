"""Cleaning, coercion, scaling, encoding and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import DIRTY, dirty_lineitem, query, table
from flowspark.functions import names, text
from flowspark.operators import clean, encode

SUM_PRICE = "count(*) AS n, CAST(sum(CAST(price AS DECIMAL(18, 2))) AS DOUBLE) AS price"


def _count(df, *by):
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("price"))


@query("p1_sanitize_names", f"WITH {DIRTY} SELECT flag AS flow_flag, {SUM_PRICE} FROM dirty GROUP BY flag")
def sanitize_names(spark, sf_dir):
    odd = dirty_lineitem(spark, sf_dir).withColumnRenamed("flag", '{flow}:,"flag"').withColumnRenamed("price", "[price]")
    return _count(names.sanitize(odd), "flow_flag")


@query("p2_normalize_names", """SELECT DISTINCT p_name AS raw, lower(p_name) AS trees, lower(p_name) AS search FROM part""")
def normalize_names(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("raw")).distinct()
    padded = F.concat(F.lit("\u200b "), F.upper(F.replace("raw", F.lit(" "), F.lit("  "))), F.lit("  "))
    plain = F.concat(F.lit("  "), F.upper(F.replace("raw", F.lit(" "), F.lit("  "))), F.lit(" "))
    return part.select("raw", names.normalized(padded).alias("trees"), names.normalized(plain, "search").alias("search"))


@query("p3_drop_metadata", "SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1")
def drop_metadata(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumnsRenamed(
        {"l_orderkey": "Flow ID", "l_partkey": " source  IP", "l_suppkey": "Destination IP", "l_shipdate": "Timestamp"})
    kept = names.drop_metadata(df, rule="normalized")
    assert not {"Flow ID", " source  IP", "Destination IP", "Timestamp"} & set(kept.columns)
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("p4_label_rules", """SELECT 'alias' AS rule, p_type AS label, count(*) AS n FROM part GROUP BY 2 UNION ALL
  SELECT 'descriptor', p_brand, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'last', p_name, count(*) FROM part GROUP BY 2
  UNION ALL SELECT 'main', p_type, count(*) FROM part GROUP BY 2""")
def label_rules(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("Category"), F.col("p_type").alias("Class"), F.col("p_size"), F.col("p_name"))
    out = None
    for rule in ("alias", "descriptor", "last", "main"):
        label = names.resolve_label(df, rule)
        part = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "label", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("p5_drop_missing", f"WITH {DIRTY} SELECT flag, {SUM_PRICE} FROM marked WHERE NOT absent GROUP BY flag")
def drop_missing(spark, sf_dir):
    return _count(clean.drop_missing(dirty_lineitem(spark, sf_dir)), "flag")


@query("p6_drop_infinite", f"WITH {DIRTY} SELECT flag, {SUM_PRICE} FROM marked WHERE NOT endless GROUP BY flag")
def drop_infinite(spark, sf_dir):
    return _count(clean.drop_infinite(dirty_lineitem(spark, sf_dir)), "flag")


@query("p6_drop_unusable", f"WITH {DIRTY} SELECT flag, {SUM_PRICE} FROM marked WHERE NOT absent AND NOT endless GROUP BY flag")
def drop_unusable(spark, sf_dir):
    return _count(clean.drop_unusable(dirty_lineitem(spark, sf_dir), "features", "flag"), "flag")


@query("p7_drop_out_of_range", f"""WITH {DIRTY} SELECT flag, {SUM_PRICE} FROM marked
  WHERE NOT absent AND NOT endless AND abs(quantity) <= 3.4028234663852886e38 GROUP BY flag""")
def drop_out_of_range(spark, sf_dir):
    return _count(clean.drop_out_of_range(dirty_lineitem(spark, sf_dir), check=True), "flag")


@query("p8_drop_constant", f"""WITH {DIRTY}, kept AS (SELECT * FROM marked WHERE NOT absent AND NOT endless)
  SELECT constant_text, count(*) AS n, 8::BIGINT + CASE WHEN (SELECT min(constant) <> max(constant) FROM kept) THEN 1 ELSE 0 END
    + CASE WHEN (SELECT min(tax) <> max(tax) FROM kept) THEN 1 ELSE 0 END AS columns FROM kept GROUP BY 1""")
def drop_constant(spark, sf_dir):
    kept = clean.drop_constant(clean.drop_unusable(dirty_lineitem(spark, sf_dir)))
    return kept.groupBy("constant_text").agg(F.count(F.lit(1)).alias("n"), F.lit(len(kept.columns)).cast("long").alias("columns"))


@query("p9_coerce_numeric", """SELECT count(*) AS n, CAST(sum(k) AS DOUBLE) AS k, count(mixed) AS mixed FROM (
  SELECT try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CASE WHEN event_type = 'click' THEN value END AS mixed FROM events)""")
def coerce_numeric(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        F.get_json_object("props", "$.k").alias("k"), "event_type",
        F.when(F.col("event_type") == "click", F.col("value").cast("string")).otherwise(F.col("event_type")).alias("mixed"))
    out = clean.coerce_numeric(df)
    assert out.columns == ["k", "mixed"]
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.count("mixed").alias("mixed"))


@query("p10_median_impute", f"""WITH {DIRTY}, fin AS (SELECT flag, tax, CASE WHEN isfinite(quantity) THEN quantity END AS quantity FROM dirty),
  m AS (SELECT median(tax) AS mt, median(quantity) AS mq FROM fin)
  SELECT flag, round(avg(coalesce(tax, mt)), 6) AS tax, round(avg(CASE WHEN coalesce(quantity, mq) < 1e30 THEN coalesce(quantity, mq) END), 6) AS quantity
  FROM fin, m GROUP BY flag""")
def median_impute(spark, sf_dir):
    df = dirty_lineitem(spark, sf_dir).withColumn("nothing", F.lit(None).cast("double"))
    filled = clean.median_impute(df, ["tax", "quantity", "nothing"])
    return filled.groupBy("flag").agg(F.round(F.avg("tax"), 6).alias("tax"),
                                      F.round(F.avg(F.when(F.col("quantity") < 1e30, F.col("quantity"))), 6).alias("quantity"))


@query("p11_normalize_types", """SELECT CAST(sum(l_quantity) AS DOUBLE) AS numbers, count(*) FILTER (l_linestatus = 'O') AS flags,
  count(DISTINCT l_returnflag) AS texts, 'double boolean string' AS types FROM lineitem""")
def normalize_types(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("string").alias("q"), (F.col("l_linestatus") == "O").cast("string").alias("b"),
        F.encode("l_returnflag", "UTF-8").alias("f"))
    out = clean.normalize_types(df)
    kinds = " ".join(t for _, t in out.dtypes)
    return out.agg(F.sum("q").alias("numbers"), F.count_if(F.col("b")).alias("flags"),
                   F.count_distinct("f").alias("texts"), F.lit(kinds).alias("types"))


@query("p12_feature_lists", """WITH t AS (SELECT o_custkey, o_orderkey, 'f' || (o_orderkey % 7) AS f FROM orders)
  SELECT o_custkey, string_agg(f, ',' ORDER BY first_at) AS features FROM (
    SELECT o_custkey, f, min(o_orderkey) AS first_at FROM t GROUP BY 1, 2) GROUP BY 1""")
def feature_lists(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("f"), (F.col("o_orderkey") % 7).cast("string")).alias("f"))
    first = t.groupBy("o_custkey", "f").agg(F.min("o_orderkey").alias("at"))
    stored = first.groupBy("o_custkey").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "f"))), lambda s: s["f"])).alias("best_features"))
    return stored.select("o_custkey", F.array_join(text.feature_list("best_features"), ",").alias("features"))


@query("p12_numbered_lines", """SELECT p_partkey::INTEGER AS position, p_name AS feature, CASE WHEN p_size > 25 THEN p_size END AS ranking FROM part""")
def numbered_lines(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(". "), "p_name",
                    F.when(F.col("p_size") > 25, F.format_string(" (RFE Ranking %d)", "p_size")).otherwise(""))
    return text.features_from_text(part.select(line.alias("value")))


@query("u2_feature_rows", """SELECT p_brand, p_size::INTEGER AS position, p_name AS feature, CASE WHEN p_size > 25 THEN p_size END AS ranking, count(*) AS n
  FROM part GROUP BY ALL""")
def feature_rows(spark, sf_dir):
    line = F.concat(F.col("p_size").cast("string"), F.lit(". "), "p_name", F.when(F.col("p_size") > 25, F.format_string(" (RFE Ranking %d)", "p_size")).otherwise(""))
    texts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(line), "\n").alias("listing"))
    return text.feature_rows(texts, "listing").groupBy("p_brand", "position", "feature", "ranking").agg(F.count(F.lit(1)).alias("n"))


@query("p12_select_features", "SELECT l_returnflag, round(avg(l_tax), 6) AS tax, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1")
def select_features(spark, sf_dir):
    df = text.select_features(table(spark, sf_dir, "lineitem"), ["l_tax", "gone", "l_discount", "l_returnflag"], "known")
    return df.groupBy("l_returnflag").agg(F.round(F.avg("l_tax"), 6).alias("tax"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("p13_one_hot", """SELECT l_linestatus_F, l_linestatus_O, l_returnflag_A, l_returnflag_N, l_returnflag_R, count(*) AS n FROM (
  SELECT (l_linestatus = 'F')::INTEGER AS l_linestatus_F, (l_linestatus = 'O')::INTEGER AS l_linestatus_O,
    (l_returnflag = 'A')::INTEGER AS l_returnflag_A, (l_returnflag = 'N')::INTEGER AS l_returnflag_N,
    (l_returnflag = 'R')::INTEGER AS l_returnflag_R FROM lineitem) GROUP BY ALL""")
def one_hot(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag")
    values = encode.category_values(df, ["l_linestatus", "l_returnflag"])
    coded = encode.one_hot(df, values)
    return coded.groupBy(*coded.columns).agg(F.count(F.lit(1)).alias("n"))


@query("p13_sparse_one_hot", """WITH c AS (SELECT o_custkey::VARCHAR AS v, row_number() OVER (ORDER BY o_custkey::VARCHAR) - 1 AS i FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY o_custkey),
  p AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS i FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1),
  n AS (SELECT (SELECT count(*) FROM c) AS nc, (SELECT count(*) FROM p) AS np),
  s AS (SELECT o_orderkey, list_filter([c.i, nc + p.i], lambda x: x IS NOT NULL) AS hits, nc + np AS size FROM orders LEFT JOIN c ON c.v = o_custkey::VARCHAR LEFT JOIN p ON p.v = o_orderpriority, n)
  SELECT o_orderkey, '(' || size || ',[' || array_to_string(hits, ',') || '],[' || array_to_string(list_transform(hits, lambda x: '1.0'), ',') || '])' AS slots FROM s""")
def sparse_one_hot(spark, sf_dir):
    """Customers and priorities of all orders as sparse vectors, numbered on three quarters of them."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"), "o_orderpriority")
    fitted = encode.fit_categories(df.where("o_orderkey % 4 <> 0"), ["customer", "o_orderpriority"])
    return encode.sparse_one_hot(df, fitted).select("o_orderkey", F.col("categories").cast("string").alias("slots"))


@query("p14_label_encode", """WITH c AS (SELECT o_orderpriority AS label, count(*) AS n, min(o_orderkey) AS first_at FROM orders GROUP BY 1)
  SELECT label, n, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS by_text, (row_number() OVER (ORDER BY first_at) - 1)::INTEGER AS by_first, label AS decoded FROM c""")
def label_encode(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    by_text = encode.label_index(df, "label")
    by_first = encode.label_index(df, "label", order="o_orderkey")
    coded = encode.encode_label(encode.encode_label(df, "label", by_text, "by_text"), "label", by_first, "by_first")
    coded = encode.decode_label(coded, "by_text", by_text, "decoded")
    return coded.groupBy("label", "by_text", "by_first", "decoded").agg(F.count(F.lit(1)).alias("n"))


@query("p15_standard_scale", """WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d, avg(l_tax) AS mt, stddev_pop(l_tax) AS dt
    FROM lineitem WHERE l_linenumber <= 5)
  SELECT l_returnflag, round(avg((l_quantity - m) / d), 6) AS q, round(max((l_tax - mt) / dt), 6) AS t, round(avg(l_quantity), 6) AS back FROM lineitem, s GROUP BY 1""")
def standard_scale(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity", "l_tax", F.lit(3.0).alias("flat"))
    stats = clean.scale_stats(df.filter("l_linenumber <= 5"), ["l_quantity", "l_tax", "flat"])
    scaled = clean.scale(df, stats)
    restored = clean.unscale(scaled.withColumn("copy", F.col("l_quantity")), {"copy": stats["l_quantity"]})
    return restored.groupBy("l_returnflag").agg(
        F.round(F.avg("l_quantity"), 6).alias("q"), F.round(F.max("l_tax"), 6).alias("t"), F.round(F.avg("copy"), 6).alias("back"))


@query("c1_truncate", """SELECT l_linenumber, printf('%.4f', floor(abs(l_tax / 3) * 10000) / 10000) AS up,
  CASE WHEN l_tax > 0 THEN '-' ELSE '' END || printf('%.4f', floor(abs(l_tax / 3) * 10000) / 10000) AS down, count(*) AS n, count(NULL) AS bad
  FROM lineitem GROUP BY 1, 2, 3""")
def truncate(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_tax") / 3)
    down = F.when(F.col("l_tax") > 0, text.truncated(-F.col("v"))).otherwise(text.truncated("v"))
    return (df.withColumn("up", text.truncated("v")).withColumn("down", down).withColumn("bad", text.truncated(F.lit("x")))
            .groupBy("l_linenumber", "up", "down").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("bad")))


@query("c2_trial_ids", """SELECT o_orderkey, sha256(o_orderstatus || '|' || o_orderpriority || '|' || o_custkey) AS state,
  substr(sha256(o_orderstatus || '|' || o_orderpriority || '|' || o_custkey), 1, 16) AS trial FROM orders""")
def trial_ids(spark, sf_dir):
    parts = [F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey")]
    return table(spark, sf_dir, "orders").select("o_orderkey", text.state_id(*parts).alias("state"), text.trial_id(*parts).alias("trial"))


@query("c3_rank_text", "SELECT p_name AS feature, p_size AS rank, count(*) AS n FROM part GROUP BY 1, 2")
def rank_text(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.explode(F.array(
        F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit(". "), "p_name"), F.lit("no rank here"))).alias("value"))
    return text.ranks_from_text(lines).groupBy("feature", "rank").agg(F.count(F.lit(1)).alias("n"))


@query("c3_rank_json", "SELECT event_id, 'k' AS feature, json_extract_string(props, '$.k')::INTEGER AS rank FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def rank_json(spark, sf_dir):
    shape = F.when(F.col("event_type") == "click", F.concat(F.lit('{"rfe_ranking": '), "props", F.lit("}")))
    shape = shape.when(F.col("event_type") == "error", F.concat(F.lit('{"per_run": [{"ranking": '), "props", F.lit("}]}")))
    return text.ranks_from_json(table(spark, sf_dir, "events").select("event_id", shape.otherwise(F.col("props")).alias("cell")), "cell")
