"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one it gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sigmatide")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.showConsoleProgress", "false")
        .config(SHARED, tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )


def partitions_of(spark: SparkSession) -> int:
    """The number of shuffle partitions where it is a number, else two for each core."""
    value = spark.conf.get("spark.sql.shuffle.partitions")
    return int(value) if value.isdigit() else 2 * spark.sparkContext.defaultParallelism


@lru_cache(maxsize=None)
def _local_folder(application: str) -> str:
    """One temporary folder for a session on one machine."""
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can reach, under ``spark.checkpoint.dir``.

    Only a session on one machine may lack that setting; it then gets a temporary folder,
    once. Elsewhere executors would each write to a disk of their own.
    """
    base = spark.conf.get(SHARED, None)
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {SHARED} to a folder that all executors share")
        base = _local_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Folders staged so far, by session.
_STAGED: dict[str, list[str]] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For results that several jobs read: they are computed once, and a lost executor costs
    no more than reading the files again. The folder stays until ``clear_staged``.
    """
    folder = shared_folder(df.sparkSession, name)
    _STAGED.setdefault(df.sparkSession.sparkContext.applicationId, []).append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _hadoop_path(spark: SparkSession, folder: str) -> tuple:
    """A path and the file system it lies on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the file system that Spark resolves it to."""
    path, system = _hadoop_path(spark, folder)
    uri = system.makeQualified(path).toString()
    return "file:///" + uri[len("file:"):].lstrip("/") if uri.startswith("file:") else uri


def is_folder(spark: SparkSession, path: str) -> bool:
    place, system = _hadoop_path(spark, path)
    return system.getFileStatus(place).isDirectory()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library wrote, through the file system it lies on."""
    path, system = _hadoop_path(spark, folder)
    system.delete(path, True)


def clear_staged(spark: SparkSession) -> int:
    """Delete all that this session has staged, and tell how many folders that were.

    To be called once the results built on them are written: frames that read a staged table fail afterwards.
    """
    folders = _STAGED.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        remove(spark, folder)
    return len(folders)
