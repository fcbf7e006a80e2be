"""Exact deduplication as a streaming query whose keyed state lives on disk and never expires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, bounded, materialise, require, work_dir

#: State on disk. Many small stores must not each reserve megabytes for their logs; checkpoints hold changes, not copies.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _stream(spark: SparkSession, path: str, max_bytes: int | None) -> DataFrame:
    """A file stream over path, a folder of Parquet files or one file."""
    path = path.rstrip("/")
    batch = spark.read.parquet(path)
    name = path.rsplit("/", 1)[-1]
    files = batch.inputFiles()
    reader = spark.readStream.schema(batch.schema)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if len(files) == 1 and files[0].rstrip("/").rsplit("/", 1)[-1] == name:
        return reader.option("pathGlobFilter", name).parquet(path.rsplit("/", 1)[0])
    return reader.parquet(path)


def _located(docs: DataFrame, key: str, text: str) -> DataFrame:
    norm = normalised(F.col(text))
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.select(F.col(key).alias("doc_id"), norm.alias("_text"), at.alias("_at"))


def dedup_state(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", max_bytes: int | None = None) -> DataFrame:
    """Run the stream to its end; return its state: digest, keep_id, locator (file, row) and group_size of each digest.

    The state is keyed by the SHA-256 of the normalised text and has no watermark, so nothing expires; RocksDB keeps it
    on disk, and its snapshots go to the stream's checkpoint. State of a digest is a few dozen bytes whatever its
    group's size: rows of a digest are merged before the shuffle. Each micro-batch (max_bytes of files, all if None)
    writes the digests it changed under its own number, so a batch run again after a failure replaces its own output.
    """
    out = work_dir(spark, "dedup-state")
    rows = _located(_stream(spark, path, max_bytes), key, text)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("_at").alias("at")))
    state = rows.groupBy(F.unhex(F.sha2("_text", 256)).alias("digest")).agg(first.alias("first"), F.count("*").alias("group_size"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state/batch={number}")

    # an empty piece, so that a stream without files has a readable state
    spark.createDataFrame([], state.schema).write.parquet(f"{out}/state/batch=-1")
    had = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    pieces = spark.read.schema(f"{_ddl(state)}, batch int").parquet(f"{out}/state")
    if max_bytes:  # the latest state of a digest is the one that has counted most
        pieces = pieces.groupBy("digest").agg(F.max(F.struct("group_size", "first")).alias("s")).select("digest", "s.first", "s.group_size")
    return pieces.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.at").alias("locator"), "group_size")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def batch_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of files for a micro-batch: a 64th of the table, 128 MB at least, so that state is met again at every size of table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return max(128 << 20, at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() // 64)


def exact_dedup(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", max_bytes: int | None = None) -> DataFrame:
    """One row per document of the Parquet table at path: doc_id, keep_id, group_size, kept, text_sha256.

    Digests that the stream has met more than once are the hits. Each row of a hit is held, with its full text, against
    the row that stays; should texts of one digest differ, they are grouped again by the text itself. Rows without a
    hit are read once more, but not shuffled.
    Null text counts as empty; empty texts are a group like any other. Null doc_ids come after all others. Rows that
    repeat doc_id and text: the first in the order of (file, row) stays. Other columns are not read. An empty table
    gives an empty result.
    """
    state = dedup_state(spark, path, key, text, max_bytes)
    docs = spark.read.parquet(path)
    require(docs, [key, text])
    hits = state.where("group_size > 1")
    rows = _located(docs, key, text).withColumn("digest", F.unhex(F.sha2("_text", 256)))
    rows = rows.join(bounded(hits, "dedup-digests"), "digest", "left").withColumn("_text", F.when(F.col("group_size").isNotNull(), F.col("_text")))
    rows = materialise(rows.withColumn("kept", F.coalesce(F.col("_at") == F.col("locator"), F.col("group_size").isNull())), "dedup-hits")
    stays = rows.where("kept and group_size is not null").select("digest", F.col("_text").alias("_kept_text"))
    others = rows.where("not kept").join(stays, "digest").withColumn("_same", F.col("_text") == F.col("_kept_text"))
    odd = others.where("not _same").select("doc_id", "digest", "_text", "_at")
    known = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")]
    if odd.isEmpty():
        return rows.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long")).select(*known)
    # different texts of one digest: groups of their own, by the text
    regroup = odd.groupBy("digest", "_text").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("_at").alias("at"))).alias("f"), F.count("*").alias("n"))
    apart = odd.join(regroup, ["digest", "_text"]).select("doc_id", F.col("f.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_at") == F.col("f.at")).alias("kept"), "digest")
    fewer = odd.groupBy("digest").agg(F.count("*").alias("_odd"))
    same = rows.join(odd.select("digest", "_at"), ["digest", "_at"], "left_anti").join(fewer, "digest", "left")
    same = same.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    same = same.withColumn("group_size", (F.coalesce("group_size", F.lit(1)) - F.coalesce("_odd", F.lit(0))).cast("long"))
    return same.select(*known).unionByName(apart.select(*known))
