"""Tables that later steps read again: written once below the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of at most so many rows and bytes, in files and as texts, are broadcast, once they are written; larger ones are shuffled.
SMALL_ROWS = 200_000
SMALL_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the session's checkpoint folder; in local mode without either a temporary one."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    base = context.getConf().get("spark.checkpoint.dir") or (found.get() if found.isDefined() else None)
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='codeprism-')}"
        context.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table: computed once, and read by whatever comes after, lost executors or not."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, name: str = "side") -> DataFrame:
    """df, computed once; to be broadcast if it is small in rows and bytes, else to be merged, since files that compress well hide what a broadcast holds."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    small = size <= SMALL_BYTES and out.count() <= SMALL_ROWS
    if small:
        small = (out.agg(F.sum(F.octet_length(F.to_json(F.struct(*out.columns))))).head()[0] or 0) <= SMALL_BYTES
    return F.broadcast(out) if small else out.hint("merge")
