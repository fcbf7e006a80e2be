"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, key_text, require, unit_hash


def _score(key: Column, shard: int, weight: float) -> Column:
    return F.log(unit_hash(key, F.lit(f":{shard}"))) / F.lit(float(weight))


def _winner(scores: Sequence[Column]) -> Column:
    """Index of the largest score; the lowest index of equal ones."""
    pairs = [F.struct(s.alias("score"), F.lit(-i).alias("shard")) for i, s in enumerate(scores)]
    return -F.array_max(F.array(*pairs))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, key: str = "doc_id", grown_weight: float | None = 1.0) -> DataFrame:
    """docs with `shard`, and `grown_shard`: where the row goes when one shard of grown_weight is added.

    Shard i scores ln(u_i) / weight_i, u_i uniform from the hash of (key, i); the largest score wins, so a shard gets
    rows in proportion to its weight. Scores of old shards don't depend on a new one: it only takes rows into itself.
    A narrow projection, without shuffle. Null keys share one key; rows of equal keys share a shard; other columns
    pass through (`shard` and `grown_shard` are replaced); an empty table gives an empty one; weights must be positive.
    """
    require(docs, [key])
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    k, n = key_text(key), len(weights)
    scores = [_score(k, i, w) for i, w in enumerate(weights)]
    out = docs.withColumn("shard", _winner(scores).cast("int"))
    if grown_weight is None:
        return out.withColumn("grown_shard", F.lit(None).cast("int"))
    return out.withColumn("grown_shard", _winner([*scores, _score(k, n, grown_weight)]).cast("int"))


def number_slots(rows: DataFrame, key: str = "doc_id", ties: Sequence[str] = (), prefix_hex: int = 3) -> DataFrame:
    """rows (with `shard`) and `slot`: 0, 1, 2, ... within each shard, in the order of the keys' hash, then key and ties.

    Each shard is cut into 16^prefix_hex hash ranges, so that no task sorts a whole shard; the ranges' counts, summed
    up, are where each range begins: a table of at most shards * 16^prefix_hex rows. A column `slot` of rows is replaced;
    all others pass through, whatever their names.
    """
    require(rows, [key, "shard"])
    h = F.md5(key_text(key))
    # the caller's columns stay within a struct, so that no name of theirs meets one of these
    row = F.struct(*[c for c in rows.columns if c != "slot"])
    cut = rows.select(row.alias("row"), F.col("shard").alias("own"), F.col(key).alias("id"), h.alias("hash"), F.substring(h, 1, prefix_hex).alias("range"))
    before = Window.partitionBy("own").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = cut.groupBy("own", "range").agg(F.count("*").alias("n")).select("own", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("own", "range").orderBy("hash", F.col("id").asc_nulls_last(), *[F.col("row")[c] for c in ties])
    numbered = cut.withColumn("at", F.row_number().over(inside)).join(bounded(begins, "shard-begins"), ["own", "range"])
    return numbered.select("row.*", (F.col("begin") + F.col("at") - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard. Null text: size 1, CRC-32 of nothing."""
    require(docs, ["doc_id", "text"])
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = number_slots(assign_shards(rows, (1.0,) * shards), ties=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
