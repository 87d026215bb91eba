"""Queries of the subpackage by name, with SQL where SQL can say the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from flowspark.llm import align, ann, caps, lines, mixing, pieces, pii, pitman_yor, quality, runs, simhash, toxicity, url_rules
from flowspark.session import settle

Query = Callable[[SparkSession, str], DataFrame]
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of documents, learned from the nine tenths that are not held out."""
    held_out = toxicity.crc_remainder(F.col("doc_id"), pitman_yor.HELD_OUT_PARTS) == 0
    scored = pitman_yor.score_texts(_table(spark, sf_dir, "documents"), held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of documents, learned without the third of the labels that is held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = toxicity.crc_remainder(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op3_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of equal label at cosine 0.98."""
    return caps.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that occur, exactly or nearly, in a document before or above."""
    return lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of documents."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents: counts and digest of the fixed formats, and all spans."""
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["nr"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"),
                        pii.as_text(F.array_sort(F.concat("base", "added"))).alias("spans"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to source weights 3, 1, 2 and so on, half as many words again."""
    documents, _ = mixing.mix(_table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as piece ids with merge-dropout, decoded again for comparison."""
    return pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), check=True).drop("text")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address judged by nested host and path rules."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products found for every twentieth vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers grouped where both end, with corpus-wide counts of linked ids."""
    found = align.align_counted(_table(spark, sf_dir, "documents"), digest=True, keep_links=False)
    return found.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of documents, learned from preference pairs without the third of the labels that is held out."""
    held_out = toxicity.crc_remainder(F.col("doc_id"), 3) == 1
    found = settle(quality.features(_table(spark, sf_dir, "documents")))
    model = quality.fit(found, _table(spark, sf_dir, "labels").where(~held_out))
    return quality.score(found, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def repeated_tail(doc_id: int | None, words: int) -> tuple[int, int] | None:
    """(a, p): for a tenth of the documents, words from a on repeat with period p."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    return g % words, 1 + (words - g % words) // (3 + g % 8)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of documents, a tenth of which get a repeated tail first, and the texts without them."""
    found = runs.periodic_runs(_table(spark, sf_dir, "documents"), tail=repeated_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))).alias("best")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    digest = F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256)
    top = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best, digest.alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.col3")
    return top.select("doc_id", "n_runs", (-F.col("best.col2")).alias("start"), length.alias("length"), period.alias("period"),
                      F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


OP9_SQL = r"""
WITH part AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM part),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, COALESCE(host, '') AS host, COALESCE(path, '') AS path, rule, COALESCE(verdict, 'allow') AS verdict
FROM cut LEFT JOIN fit USING (page_id)"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_pitman_yor, op2_toxicity, op3_caps, op4_lines, op5_simhash, op6_pii, op7_mix, op8_pieces, op9_url_rules, op10_ann,
                                                          op11_align, op12_quality, op13_runs)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {"op9_url_rules": OP9_SQL}
