"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which every executor reaches.

    Where it is unset, a session of one machine (master local) gets a temporary folder there, which all its threads reach; on a
    cluster there is no default, for what one machine writes others would miss.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stash(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back: a lost executor costs no recomputation.

    The folder goes when the driver ends, or with `drop` once all that was read from it is written itself.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quantloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def drop(*stashed: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in stashed:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stashed_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
