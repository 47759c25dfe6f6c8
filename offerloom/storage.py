"""Tables that a job writes for itself, and the package on Python workers."""
from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_shipped: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. A local session
    without that setting (tests) gets a folder of its own; on a cluster there is no fallback."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="offerloom-")
    return _own[app]


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; every call returns another."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: later steps start from the files, also
    after executors are lost."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that have ended. It does so when the driver's garbage
    collector meets them, which on a driver with memory to spare may be long after the disk is full."""
    spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(prefix="offerloom-"), "offerloom")
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", root, "offerloom"))
        _shipped.add(app)
