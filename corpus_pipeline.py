"""Training-corpus pipeline over `documents`: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeprism.llm.common import bounded, materialise
from codeprism.llm.decontaminate import decontaminate
from codeprism.llm.hyperminhash import near_duplicates
from codeprism.llm.mix import mix
from codeprism.llm.shard import assign_shards, number_slots
from codeprism.llm.toxicity import THRESHOLD, score, train

#: Word shingles of five and a similarity of 0.8.
NEAR_PERCENT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold. Null and empty texts have the score of no terms, and stay with it; no rows give none."""
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return score(docs, machine, name).where(F.col(name) < THRESHOLD).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies. Repeated rows: one of those with equal doc_id and text."""
    found = near_duplicates(docs, NEAR_PERCENT)
    # names of the caller's columns stay within a struct
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("row"))
    gone = bounded(found.where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "near-gone")
    out = rows.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    many = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("many"))
    many = bounded(many, "near-repeats")
    if many.isEmpty():
        return out.select("row.*")
    same = F.col("doc_id").eqNullSafe(F.col("many"))
    once = out.join(many, same, "left_semi").withColumn("text", F.col("row.text")).dropDuplicates(["doc_id", "text"]).drop("text")
    return out.join(many, same, "left_anti").unionByName(once).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (up to three rows, or none), in the order of training; no rows give none.

    Columns position and pass, if documents have such, are those of the mix.
    """
    return mix(docs).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard, slot within it, and grown_shard (documents' own columns of these names are replaced).

    Repeated rows share a shard and have slots of their own; no rows give none.
    """
    return number_slots(assign_shards(docs), ties=("text",))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL has neither the factorization machine nor verified components; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is a Parquet table, and the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
