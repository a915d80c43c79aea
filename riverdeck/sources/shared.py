"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Where the session names none, a temporary folder serves a local master (driver and tasks are one process there); on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="riverdeck-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any file system that Spark reads."""
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file."""
    fs, at = _file_system(spark, path)
    return fs.getFileStatus(at).getLen()


def tasks_for(df: DataFrame, each: int = 500_000) -> int:
    """How many tasks ``df`` is dealt to, so that none gets more than about ``each`` rows however large it is; as many as the session's shuffles have at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // each))


def side_by_side(jobs: list[Callable], parallel: int = 3) -> list:
    """What the jobs return, in their order; so many run at once, so that one's tasks fill the cores that another's steps on the driver leave idle."""
    with ThreadPool(max(1, min(parallel, len(jobs)))) as pool:
        return pool.map(lambda job: job(), jobs, chunksize=1)
