"""Helpers that the operators share: the shared folder, written tables and word patterns."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir of the session.

    Only where it is unset and the master is this machine, as in tests, a
    temporary folder is made and set as the checkpoint folder; executors
    elsewhere would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="rankweave-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/rankweave-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path).getParent()
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then; the folder is temporary
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df written as Parquet in the shared folder and read again.

    A lost executor costs nothing of it, and no later action computes it anew.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def done_with(*tables: DataFrame) -> None:
    """Removes tables of written() that no later plan reads, and lets Spark drop the shuffle files of jobs that are done."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _remove(df.sparkSession, path)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(rows: DataFrame) -> Column:
    """128 bits of all columns of a row, as text: rows that differ in any column, times by a microsecond, have different keys.

    Columns are hashed where they stand, with which of them are null; nested
    ones, of which a hash would skip the nulls inside, as JSON.
    """
    times = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    columns = [F.col(f"`{f.name}`") for f in rows.schema.fields]
    nested = [isinstance(f.dataType, (ArrayType, MapType, StructType)) for f in rows.schema.fields]
    held = [F.to_json(F.struct(c), times) if deep else c for c, deep in zip(columns, nested)]
    hashes = [F.xxhash64(F.lit(seed), *[c.isNull() for c in columns], *held).cast("string") for seed in (1, 2)]
    return F.concat_ws(":", *hashes)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
