"""Folders that the driver and all executors see."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder where that is unset and the master is this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="rankweave-")
    return _own[app]


_own: dict[str, str] = {}


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used, removed when the driver ends."""
    path = f"{shared_folder(spark)}/rankweave-{uuid.uuid4().hex}/{name}"
    atexit.register(remove, spark, path.rpartition("/")[0])
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then
        return


def arrow_files(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path that Spark's readers know, and the path within it."""
    scheme, mark, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else path)


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows written to a fresh path as Parquet and read again: later plans know their size and start from them."""
    path = fresh(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
