"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is named, a local session gets a temporary one
    and a cluster an error: its executors don't share their disks."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="placewise-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read on from there.

    Used where one result feeds several later steps. The files outlive executors, so
    a lost executor re-reads them instead of running the whole chain again.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder. Later steps read only the columns they need, and the
    planner knows its size."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.work_path = path
    return found


def forget(table: DataFrame) -> None:
    """Delete the files of a :func:`stored` table that nothing reads any more."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.work_path)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def collect_garbage(spark: SparkSession) -> None:
    """Models, broadcasts and cached rows of finished steps go when the driver collects its garbage: ask for it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
