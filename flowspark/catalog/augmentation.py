"""Synthetic rows, unions and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import query, table
from flowspark.catalog.evaluation import rounded
from flowspark.catalog.learning import ORDERS, orders
from flowspark.catalog.sampling import RANKED, SYNTHETIC, quota_sql
from flowspark.operators import augment

DRAW = "('0x' || substr(md5('42-{p}-' || id), 1, 15))::BIGINT"
MADE = f"""{ORDERS}, q AS {SYNTHETIC.format(counts='(SELECT y, count(*) AS n FROM o GROUP BY 1)', label='y', amount=0.5, small=100, floor=10)},
  e AS (SELECT *, sum(quota) OVER (ORDER BY y) - quota AS before FROM q),
  i AS (SELECT y, n, before + unnest(range(quota)) AS id FROM e),
  d AS (SELECT id, y, {DRAW.format(p='a')} % n + 1 AS ra, {DRAW.format(p='b')} % n + 1 AS rb, {DRAW.format(p='u')} / 1152921504606846976.0::DOUBLE AS u FROM i),
  r AS (SELECT *, {RANKED.format(by='y', seed=42, key='o_orderkey')} AS rn FROM o),
  made AS (SELECT d.id::BIGINT AS id, d.y, a.price + u * (b.price - a.price) AS price, a.cust + u * (b.cust - a.cust) AS cust
    FROM d JOIN r a ON a.y = d.y AND a.rn = d.ra JOIN r b ON b.y = d.y AND b.rn = d.rb)"""


def _made(spark, sf_dir):
    return augment.synthetic_rows(orders(spark, sf_dir), "y", ["price", "cust"], ["o_orderkey"], 0.5)


@query("m14_synthetic_rows", f"WITH {MADE} SELECT id, y, round(price, 6) AS price, round(cust, 6) AS cust FROM made")
def synthetic_rows(spark, sf_dir):
    return rounded(_made(spark, sf_dir), 6)


@query("x2_union_aligned", f"""WITH {MADE}, u AS (SELECT NULL::BIGINT AS id, y, price, cust FROM o UNION ALL SELECT id, y, price, cust FROM made)
  SELECT y, count(*) AS n, count(id) AS made, round(avg(price), 6) AS price FROM u GROUP BY y""")
def union_aligned(spark, sf_dir):
    original, generated = orders(spark, sf_dir), _made(spark, sf_dir)
    both = augment.union_aligned(original, generated)
    augment.validate_totals(original, both, generated.count())
    return both.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("made"), F.round(F.avg("price"), 6).alias("price"))


def _side(table_name: str, key: str, label: str, value: str, budget: str) -> str:
    counts = f"(SELECT {label}, count(*) AS n FROM {table_name} GROUP BY 1)"
    return f"""(SELECT {label} AS attack_type, {value} AS amount, {key} AS key FROM (SELECT *, {RANKED.format(by=label, seed=42, key=key)} AS rn FROM {table_name})
      JOIN {quota_sql(counts, label, budget, 1)} USING ({label}) WHERE rn <= quota)"""


BUDGET = "(SELECT least((SELECT count(*) FROM {t}), floor(count(*) * 0.1::DOUBLE)::BIGINT // 2 + CASE WHEN {i} < floor(count(*) * 0.1::DOUBLE)::BIGINT % 2 THEN 1 ELSE 0 END) FROM orders)"


@query("x3_augmented_union", f"""SELECT attack_type, count(*) AS n, round(sum(CAST(amount AS DECIMAL(18, 2))), 2)::DOUBLE AS amount FROM (
  SELECT * FROM {_side('customer', 'c_custkey', 'c_mktsegment', 'c_acctbal', BUDGET.format(t='customer', i=0))} UNION ALL
  SELECT * FROM {_side('part', 'p_partkey', 'p_type', 'p_retailprice', BUDGET.format(t='part', i=1))}) GROUP BY 1""")
def augmented_union(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("kind"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("amount"), F.col("p_type").alias("kind"))
    whole = table(spark, sf_dir, "orders").count()
    out = augment.augmented_union({"customer": customer, "part": part}, whole, "kind", ["key"], 0.1)
    return out.groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))


@query("m15_ks_distance", """WITH v AS (SELECT feature, value, a, b FROM (
    SELECT 'l_quantity' AS feature, l_quantity AS value, (l_linestatus = 'F')::INTEGER AS a, (l_linestatus = 'O')::INTEGER AS b FROM lineitem
    UNION ALL SELECT 'l_extendedprice', l_extendedprice, (l_linestatus = 'F')::INTEGER, (l_linestatus = 'O')::INTEGER FROM lineitem)),
  c AS (SELECT feature, value, sum(sum(a)) OVER w AS ca, sum(sum(b)) OVER w AS cb FROM v GROUP BY feature, value WINDOW w AS (PARTITION BY feature ORDER BY value)),
  t AS (SELECT feature, sum(a) AS ta, sum(b) AS tb FROM v GROUP BY 1)
  SELECT feature, round(max(abs(ca / ta - cb / tb)), 9) AS ks FROM c JOIN t USING (feature) GROUP BY feature""")
def ks_distance(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(augment.ks_distance(li.filter("l_linestatus = 'F'"), li.filter("l_linestatus = 'O'"), ["l_quantity", "l_extendedprice"]))


@query("m15_class_coverage", """SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0)::BIGINT AS original, coalesce(b.n, 0)::BIGINT AS generated, b.n IS NOT NULL AS covered
  FROM (SELECT lang, count(*) AS n FROM documents WHERE n_chars <= 2000 GROUP BY 1) a FULL JOIN (SELECT lang, count(*) AS n FROM documents WHERE n_chars > 2000 GROUP BY 1) b ON a.lang = b.lang""")
def class_coverage(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("lang", "n_chars")
    return augment.class_coverage(documents.filter("n_chars <= 2000"), documents.filter("n_chars > 2000"), "lang")


@query("m15_mode_coverage", """SELECT l_linestatus AS class, 5::BIGINT AS modes, count(*) AS original FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1""")
def mode_coverage(spark, sf_dir):
    """Lines of even orders against those of odd ones: modes and rows of either state; the modes reached are in the tests."""
    li = table(spark, sf_dir, "lineitem")
    found = augment.mode_coverage(li.where("l_orderkey % 2 = 0"), li.where("l_orderkey % 2 = 1"), "l_linestatus", ["l_quantity", "l_extendedprice", "l_tax"])
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("modes"), F.sum("original").alias("original"))


@query("m15_correlation_gap", """WITH c AS (SELECT corr(l_extendedprice, l_quantity) FILTER (l_linestatus = 'F') AS a1, corr(l_extendedprice, l_quantity) FILTER (l_linestatus = 'O') AS b1,
    corr(l_tax, l_quantity) FILTER (l_linestatus = 'F') AS a2, corr(l_tax, l_quantity) FILTER (l_linestatus = 'O') AS b2,
    corr(l_tax, l_extendedprice) FILTER (l_linestatus = 'F') AS a3, corr(l_tax, l_extendedprice) FILTER (l_linestatus = 'O') AS b3 FROM lineitem)
  SELECT 'l_extendedprice' AS feature_a, 'l_quantity' AS feature_b, round(a1, 6) AS original, round(b1, 6) AS generated, round(abs(a1 - b1), 6) AS gap FROM c
  UNION ALL SELECT 'l_tax', 'l_quantity', round(a2, 6), round(b2, 6), round(abs(a2 - b2), 6) FROM c
  UNION ALL SELECT 'l_tax', 'l_extendedprice', round(a3, 6), round(b3, 6), round(abs(a3 - b3), 6) FROM c""")
def correlation_gap(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    gap = augment.correlation_gap(li.filter("l_linestatus = 'F'"), li.filter("l_linestatus = 'O'"), ["l_quantity", "l_extendedprice", "l_tax"])
    return rounded(gap, 6)
