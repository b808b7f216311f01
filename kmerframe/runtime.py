"""Session helpers shared by the whole library."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir.

    A folder of our own is set only where none is named, and only in local mode, where driver and
    executors are one process; a machine-local folder would lose data on a real cluster.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="kmerframe-checkpoint-")
    context.setCheckpointDir(named)


#: Session setting: the shuffle files of a query go as soon as it ends.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that lost executors cost no recomputation.

    release: the files of its shuffles are deleted once it is written, and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not release:
        return df.checkpoint(eager=True)
    before = spark.conf.get(_RELEASE)
    spark.conf.set(_RELEASE, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting is read when a plan is made
    finally:
        spark.conf.set(_RELEASE, before)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scan_tasks(df: DataFrame) -> int:
    """Number of tasks that read a table; for tables as they are read, not for what a shuffle gives."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def fanned(df: DataFrame, source: DataFrame, *columns: str) -> DataFrame:
    """df, shuffled once more by columns to one task per core if its source is read by fewer tasks than there are cores.

    For stages that compute much per byte: adaptive execution merges the tasks of a small shuffle by bytes alone. Where the
    source is large the shuffle that df comes from has enough tasks, and df is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # by a hash of the columns: a shuffle by the columns themselves would be dropped after a group by them
    return df.repartition(cores, F.xxhash64(*columns)) if scan_tasks(source) < cores else df


def spread(df: DataFrame) -> DataFrame:
    """df, repartitioned if its scan gives fewer than half as many tasks as there are cores to run them.

    For stages that compute much per row on a small number of files; a large input is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * scan_tasks(df) < cores else df


def over_all_cores(df: DataFrame, *columns: str) -> DataFrame:
    """df in a fixed number of tasks, at least one per core: for work that is far larger than the bytes by which adaptive execution
    would merge tasks."""
    spark = df.sparkSession
    return df.repartition(max(shuffle_width(spark), spark.sparkContext.defaultParallelism), F.xxhash64(*columns))


def bounded(batches: Iterator[pa.RecordBatch], column: int, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text (one row at least), so that a worker's memory has a bound."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
