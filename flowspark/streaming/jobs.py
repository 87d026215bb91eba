"""Streams: the batch operators kept current while files land in a folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.clean import drop_missing, drop_out_of_range, drop_unusable
from flowspark.operators.profile import approximate_table, merge_states, profile_from_state, profile_state
from flowspark.plans.models import predict


def landing(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; `files` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def progress_of(path: str) -> str:
    """Where a result keeps its stream's progress; readers pass over names with an underscore."""
    return f"{path.rstrip('/')}/_progress"


def run_to_files(stream: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Process what is there, append it to Parquet, and return the result as a table.

    Progress is kept beside the output unless told otherwise: the file sink counts batches by
    the output, so a second call must go on where the first one stopped.
    """
    spark = stream.sparkSession
    (stream.writeStream.format("parquet").outputMode("append").option("path", path)
     .option("checkpointLocation", checkpoint or progress_of(path)).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there, batch by batch; `each` must give the same result when a batch repeats."""
    (stream.writeStream.foreachBatch(each).outputMode(mode)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def current_approximations(spark: SparkSession, state_path: str, schema_of: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct counts and quantiles of everything seen so far, from the sketches of `keep_profile(..., sketches=True)`."""
    return approximate_table(merge_states(spark.read.parquet(state_path).drop("batch"), by), schema_of, by)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that no later batch reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def keep_profile(stream: DataFrame, label: str, state_path: str, by: Sequence[str] = (), checkpoint: str | None = None, sketches: bool = False) -> None:
    """Add each batch's profile state under its batch number; a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        profile_state(batch, label, by, sketches).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    run_batches(stream, each, checkpoint or progress_of(state_path))


def current_profile(spark: SparkSession, state_path: str, schema_of: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """The profile of everything seen so far: small states merged, no row read again."""
    states = merge_states(spark.read.parquet(state_path).drop("batch"), by)
    return profile_from_state(states, schema_of, label, by)


def clean_stream(stream: DataFrame, columns: Sequence[str] | None = None, policy: str = "all", label: str | None = None,
                 in_range: bool = False) -> DataFrame:
    """Row cleaning on a stream. Constant columns are a property of the whole, so the columns are given."""
    d = stream.select(*columns) if columns else stream
    d = drop_unusable(d, policy, label)
    return drop_out_of_range(d) if in_range else d


def present_stream(stream: DataFrame) -> DataFrame:
    """Rows with every value present."""
    return drop_missing(stream)


def class_counts_in_time(stream: DataFrame, time: str, label: str, window: str, slide: str | None = None, late: str = "10 minutes",
                         by: Sequence[str] = ()) -> DataFrame:
    """Rows per class in tumbling (or, with `slide`, sliding) windows; rows later than `late` are dropped."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    d = stream.withWatermark(time, late) if stream.isStreaming else stream
    counts = d.groupBy(span.alias("w"), *by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, label, "n")


def keep_class_counts(stream: DataFrame, path: str, time: str, label: str, window: str, slide: str | None = None, late: str = "10 minutes",
                      by: Sequence[str] = (), checkpoint: str | None = None) -> DataFrame:
    """`class_counts_in_time` of everything seen, open windows included, as a table that each batch brings up to date.

    The state store holds the windows until the watermark passes them. Every batch writes the windows it changed under its own number, so
    a batch that repeats replaces itself, and of each window the newest count holds. Rows of windows that
    the watermark had passed before the last batch are dropped.
    """
    counts = class_counts_in_time(stream, time, label, window, slide, late, by)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_batches(counts, each, checkpoint or progress_of(path), "update")
    kept = stream.sparkSession.read.schema(f"{_ddl(counts)}, batch long").parquet(path)
    return kept.groupBy("start", "end", *by, label).agg(F.max_by("n", "batch").alias("n"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def class_counts_in_sessions(df: DataFrame, time: str, keys: Sequence[str], gap: str) -> DataFrame:
    """Rows per session of a key: a session ends when nothing comes for `gap`.

    Rows of one key in one stretch of time no longer than the gap belong together, so they are counted before the
    shuffle; a key that holds most rows is a row per stretch by the time its sessions are put together.
    """
    return _joined_sessions(_session_parts(df, time, keys, gap), keys)


def _session_parts(df: DataFrame, time: str, keys: Sequence[str], gap: str) -> DataFrame:
    span = F.expr(f"INTERVAL {gap}")
    stretch = F.window(time, gap).alias("w")
    grouped = df.where(F.col(time).isNotNull()).groupBy(*keys, stretch)
    return grouped.agg(F.min(time).alias("start"), (F.max(time) + span).alias("end"), F.count(F.lit(1)).alias("n")).drop("w")


def _joined_sessions(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of sessions whose spans overlap, as one."""
    earlier = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    fresh = parts.withColumn("_fresh", F.coalesce((F.col("start") >= F.max("end").over(earlier)).cast("int"), F.lit(1)))
    numbered = fresh.withColumn("_nr", F.sum("_fresh").over(upto))
    return numbered.groupBy(*keys, "_nr").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).select("start", "end", *keys, "n")


def keep_sessions(stream: DataFrame, path: str, time: str, keys: Sequence[str], gap: str, late: str = "10 minutes", checkpoint: str | None = None) -> DataFrame:
    """`class_counts_in_sessions` of everything seen, open sessions included.

    Open sessions are a table that each batch replaces: those of the batch before and the new parts, joined where
    they overlap. Sessions that end `late` or more before the newest row are closed and move to a table that only grows; a row
    whose own session would have ended by then is dropped. All folders of a batch carry its number and are
    made from those of the number before, so a batch that repeats replaces itself.
    """
    spark = stream.sparkSession
    kinds = dict(stream.dtypes)
    schema = f"start {kinds[time]}, end {kinds[time]}, {''.join(f'`{k}` {kinds[k]}, ' for k in keys)}n long"

    def each(batch: DataFrame, number: int) -> None:
        first = number == 0
        seen = None if first else spark.read.parquet(f"{path}/seen/batch={number - 1}").first()["seen"]
        parts = _session_parts(batch, time, keys, gap)
        if seen is not None:
            parts = parts.where(F.col("end") > F.lit(seen) - F.expr(f"INTERVAL {late}"))
            parts = parts.unionByName(spark.read.schema(schema).parquet(f"{path}/open/batch={number - 1}"))
        newest = batch.agg(F.max(time).alias("seen")).select(F.greatest("seen", F.lit(seen).cast(kinds[time])).alias("seen"))
        newest.write.mode("overwrite").parquet(f"{path}/seen/batch={number}")
        seen = spark.read.parquet(f"{path}/seen/batch={number}").first()["seen"]
        passed = F.lit(seen).cast(kinds[time]) - F.expr(f"INTERVAL {late}")
        joined = _joined_sessions(parts, keys).withColumn("closed", F.coalesce(F.col("end") <= passed, F.lit(False)))
        joined.write.mode("overwrite").parquet(f"{path}/joined/batch={number}")
        joined = spark.read.parquet(f"{path}/joined/batch={number}")
        for name, state in (("open", False), ("closed", True)):
            joined.where(F.col("closed") == state).drop("closed").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        for name in ("open", "seen", "joined"):
            drop_path(spark, f"{path}/{name}/batch={number - 2}")

    run_batches(stream, each, checkpoint or progress_of(path))
    newest = max(r["batch"] for r in spark.read.parquet(f"{path}/seen").select("batch").distinct().collect())
    closed = spark.read.schema(schema).parquet(f"{path}/closed").drop("batch")
    return closed.unionByName(spark.read.schema(schema).parquet(f"{path}/open/batch={newest}"))


def score_stream(stream: DataFrame, model_path: str, keep: Sequence[str]) -> DataFrame:
    """Predictions of a stored pipeline on a stream; null for a row that lacks a feature."""
    return predict(PipelineModel.load(model_path), stream).select(*keep, "prediction")
