"""A corpus pipeline of the operators in flowspark.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.llm import lines, mixing, pieces, simhash, toxicity
from flowspark.session import scratch_path


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels of these documents, does not reject.

    Null and empty texts score as texts without a term and stay; repeated rows score alike; without labels all stay.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=True).where(F.col("score") < toxicity.REJECT).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand, exactly or nearly, in an earlier document or above. Documents stay, null texts null."""
    return _recounted(lines.dedup_lines(docs).select(*docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash neighbours the document with the smallest id; of rows equal in id and text one.

    Rows of one id with different texts stay if one of them does; a row without an id belongs to no group and stays.
    An empty table stays empty.
    """
    groups = simhash.near_duplicates(docs)
    kept = groups.where("doc_id = component_id or doc_id is null").select("doc_id").distinct()
    once = docs.withColumn("_text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")
    return once.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that a mix of the sources takes, a row per document and pass. Null and empty texts hold no words and go."""
    return _recounted(mixing.mixed_texts(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of all texts beside the columns of documents; passes over a document are cut apart. A null text has null ids."""
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    return pieces.encode(docs.withColumn("_copy", F.row_number().over(same)), copy="_copy")


STAGES = [("toxicity", toxic_documents), ("lines", repeated_lines), ("simhash", near_copies), ("mixing", mixed_sources), ("pieces", encoded)]
ORACLE_SQL = None  # classifiers, fuzzy matching and keyed draws have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
