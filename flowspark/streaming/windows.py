"""Row windows over a stream, with the unfinished tail of each source as a typed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators.ordering import value_ranked
from flowspark.operators.windows import checked_shape, windows_of_positions
from flowspark.streaming.jobs import drop_path, progress_of, run_batches


def keep_row_windows(stream: DataFrame, path: str, source: str, order: str, ties: Sequence[str], features: Sequence[str], label: str,
                     length: int, stride: int = 1, minimum: int | None = None, mixed: str = "keep", idle: int | None = None,
                     checkpoint: str | None = None) -> DataFrame:
    """Windows of `length` rows every `stride` rows per source, as rows arrive; they are written below `path` and read from there.

    The rows of a source are one sequence: batches come in order, the rows of a batch are put in order by `order` and
    `ties`. Two tables stand between batches: how many rows each source has had, and the rows that a later
    window still needs (fewer than length + stride of a source, or minimum until it has that many). A batch adds its rows behind them and
    is then the batch operator's work: a hot source is cut into ranges and blocks, so no call holds it whole. A source without rows for
    `idle` batches is forgotten; its rows then count from 0 again.

    Every batch writes folders of its own number from those of the number before, so a batch that repeats replaces itself.
    """
    minimum = checked_shape(length, stride, minimum, mixed)
    spark = stream.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    sources = f"`{source}` {kinds[source]}, _n long, _last long"
    tails = f"`{source}` {kinds[source]}, _at long, _row struct<features:array<double>,label:{kinds[label]}>"

    def each(batch: DataFrame, number: int) -> None:
        row = F.struct(F.array(*[F.col(f).cast("double") for f in features]).alias("features"), F.col(label).alias("label")).alias("_row")
        before = _state(spark, path, "sources", number - 1, sources)
        new = value_ranked(batch.where(F.col(source).isNotNull()), [source], order, ties, rank="_rn").select(source, "_rn", row)
        counts = new.groupBy(source).agg(F.count(F.lit(1)).alias("_n")).withColumn("_last", F.lit(number).cast("long"))
        known = before.unionByName(counts).groupBy(source).agg(F.sum("_n").alias("_n"), F.max("_last").alias("_last"))
        if idle is not None:
            known = known.where(F.col("_last") > number - idle)
        known.write.mode("overwrite").parquet(f"{path}/sources/batch={number}")
        known = _state(spark, path, "sources", number, sources)
        placed = new.join(before.select(source, F.col("_n").alias("_had")), source, "left").select(
            source, (F.coalesce("_had", F.lit(0)) + F.col("_rn") - 1).alias("_at"), "_row")
        held = _state(spark, path, "tails", number - 1, tails)
        rows = held.unionByName(placed).join(known.select(source, F.col("_n").alias("_all")), source)
        full = rows.where(F.col("_all") >= minimum)
        windows_of_positions(full, source, length, stride, mixed).write.mode("overwrite").parquet(f"{path}/windows/batch={number}")
        start = F.when(F.col("_all") >= minimum, F.ceil((F.col("_all") - length + 1) / stride) * stride).otherwise(0)
        rows.where(F.col("_at") >= start).select(source, "_at", "_row").write.mode("overwrite").parquet(f"{path}/tails/batch={number}")
        for name in ("sources", "tails"):
            drop_path(spark, f"{path}/{name}/batch={number - 2}")

    run_batches(stream, each, checkpoint or progress_of(path))
    return spark.read.parquet(f"{path}/windows").drop("batch")


def _state(spark: SparkSession, path: str, name: str, number: int, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}/batch={number}") if number >= 0 else spark.createDataFrame([], schema)
