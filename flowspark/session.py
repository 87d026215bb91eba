"""Session set-up and the shared folder that outlives an executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 100_000  # most rows of a side table that every task may hold

CHECKPOINT_SETTING = "spark.checkpoint.dir"

_local_folder: dict[str, str] = {}  # by application: the fallback folder of a local master


def local_session(cpus: int | str = "*", app: str = "flowspark", memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every node can reach, as named by the cluster.

    Only a local master, where every task runs on this machine, may fall back to a
    temporary folder; a cluster without the setting is an error.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by all nodes")
    return _local_folder.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="flowspark-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that a lost executor costs a re-read only."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A side table to join with: broadcast once it is known to be small, as it is otherwise.

    The optimizer cannot foresee the size of an aggregate, so the rows are counted by
    fetching at most one more than allowed. Beyond that the join shuffles.
    """
    head = df.limit(rows + 1).collect()
    if len(head) > rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(head, df.schema))


def parallelism(spark: SparkSession) -> int:
    """Shuffle width the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
