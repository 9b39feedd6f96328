"""Session defaults and the shared scratch location."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docquarry.sources.appended import open_store

# Settings that hold for a laptop and a cluster alike.  Partition counts are
# left to AQE: it starts from spark.sql.shuffle.partitions and coalesces, and
# splits skewed partitions of joins and of rebalance hints.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole documents travel through Arrow, so batches are kept short.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(name: str = "docquarry", master: str | None = None, **conf) -> SparkSession:
    """Session with the engine's defaults; keyword settings win."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k: str(v) for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a
    cluster session must name a folder every executor can reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``DataFrame.checkpoint`` at the shared folder if it is unset."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark, "checkpoint"))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for plans that use it more than once."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def exchanges_end(spark: SparkSession) -> Iterator[None]:
    """Writes in this block delete the files of their exchanges when they end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(path: str) -> None:
    """Delete a scratch folder; in stores that pyarrow has no file system for, it stays."""
    try:
        store, root = open_store(path)
        store.delete_dir(root)
    except (pa.ArrowInvalid, FileNotFoundError):
        return


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    Its cleaner deletes them once the driver has collected the jobs' plans as garbage, which
    may be long after a large exchange was written out; nothing that is still used goes.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(scan: DataFrame) -> DataFrame:
    """Share out a file scan that has fewer splits than there are cores.

    For plain scans ahead of heavy per-row work.  A table of many files or row
    groups already has enough splits and is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
