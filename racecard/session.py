"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Largest batch of pages, in bytes, that a Python worker is given at once.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages reach the Python workers in batches bounded by bytes, not only by rows.
    ARROW_BYTES[0]: ARROW_BYTES[1],
    # Streaming state lives in RocksDB so that it is bounded by disk, not by heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "racecard", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, where every executor can reach it.

    It lies below ``spark.checkpoint.dir``; without that setting, below the warehouse,
    which executors share as well. It is deleted when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    context = spark.sparkContext
    folder = f"{base}/racecard/{context.applicationId}"
    if folder not in _prepared:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _prepared.add(folder)
    return folder


_prepared: set[str] = set()


def use_small_batches(spark: SparkSession) -> None:
    """Bound the batches that reach Python workers by bytes, unless the session does already."""
    name, most = ARROW_BYTES
    if name not in spark.conf.getAll:
        spark.conf.set(name, most)


def use_checkpoints(spark: SparkSession) -> None:
    """Let iterative fits checkpoint to the shared folder, unless the session does already."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Lost executors then never recompute it, let alone differently, and whoever reads
    it reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    It deletes them once the driver's JVM has collected the plans that made them, which a driver
    with a large heap does every half hour: until then each step's files add up on the disks.
    """
    spark.sparkContext._jvm.System.gc()


def _write_packed(df: DataFrame) -> str:
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    free_shuffles(df.sparkSession)
    return path


def cut_large(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``, for tables as large as the input: packed tighter, and what they were made from is freed."""
    path = _write_packed(df)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as from ``cut_large`` within the block; its files are deleted at the end."""
    spark, path = df.sparkSession, _write_packed(df)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        free_shuffles(spark)
