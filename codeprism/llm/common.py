"""Helpers that the operators share: work folders, bounded broadcasts, checks for equal column names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every contract of these operators counts it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Sides of at most so many rows and bytes of Parquet are broadcast, once they are written; larger ones are shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the session's checkpoint folder; in local mode without either a temporary one."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    base = context.getConf().get("spark.checkpoint.dir") or (found.get() if found.isDefined() else None)
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='codeprism-')}"
    if not found.isDefined():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written below the shared folder and read again, and its path."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: short lineage that outlives executors."""
    return stored(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table below the shared folder that no later plan reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release_memory() -> None:
    """Give what Arrow and the C library keep of freed arrays back to the system: beside Spark's heap the driver has little room."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def bounded(df: DataFrame, name: str = "side", rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, computed once and written to the shared folder; to be broadcast if the files hold at most so many bytes and rows."""
    out, path = stored(df, name)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    length = at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return F.broadcast(out) if length <= size and out.count() <= rows else out


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def utf8(column: str) -> Column:
    """The text's bytes; null counts as empty."""
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")


def key_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("\\N"))


def unit_hash(*parts: Column) -> Column:
    """A uniform number in (0, 1) from 52 bits of MD5: the same in any engine that has MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(*parts)), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))
