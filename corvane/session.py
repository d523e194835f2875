"""Session helpers: table loading, the shared work folder, and written intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, read by Spark alone (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in ``spark.checkpoint.dir``.

    A temporary folder stands in only where the setting is absent and the master is
    local, as in tests; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    if (found := sc.getCheckpointDir()) is not None:
        return found
    if (configured := sc.getConf().get("spark.checkpoint.dir")) is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="corvane-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there.

    The files survive the loss of any executor. They stay until the shared folder is
    cleaned, since a lazy result may still read them.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task, where the number of tasks follows from the rows and not from the session.
ROWS_A_TASK = 1 << 19


def dealt(df: DataFrame, rows: int, *keys: str, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``df`` by ``keys`` in as many tasks as its number of ``rows`` asks for, so that a task's memory doesn't grow with the table."""
    return df.repartition(max(1, -(-rows // rows_a_task)), *keys)


#: Rows of a task of ``spread`` at most on average, and at least where that leaves cores without a task.
MANY_ROWS, FEW_ROWS = 1 << 18, 1 << 14


def spread(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``df`` by ``keys`` as ``dealt`` does, over all cores if there are rows enough; as it is if its number of ``rows`` isn't given."""
    if rows is None:
        return df
    least = min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FEW_ROWS))
    return df.repartition(max(1, least, -(-rows // MANY_ROWS)), *keys)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it, for byte files opened in tasks through pyarrow; Hadoop's ``file:/x`` is taken as ``file:///x``."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return fs.LocalFileSystem(), os.path.abspath(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's own file system layer."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
