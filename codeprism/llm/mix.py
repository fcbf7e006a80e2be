"""Mixing sources to target weights along a curriculum that changes over training time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, key_text, materialise, require

#: Base weights by the sources' rank, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Piecewise-linear weight over training time, as (time, weight) knots, by the sources' rank, repeating: falling, flat, rising.
SCHEDULES = (((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.6, 1.0), (1.0, 2.0)))
MAX_EPOCHS = 3


def plan_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size): rank, weight and target of each source.

    Targets share the total by weight and stop at max_epochs * source_size; the excess is reshared by weight until none
    is above. That is water-filling: with sources in the order of cap / weight, those up to some place are capped, and
    running sums find it. The windows without partition hold one row per source, not per document.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("rank", F.row_number().over(rank) - 1).withColumn("weight", F.get(listed, F.col("rank") % len(weights)))
    s = s.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before, rest, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    s = s.withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    shared = F.max(F.when(~F.col("capped"), F.struct(-F.col("ratio"), -F.col("rank"), F.col("level").alias("level")))).over(all_)["level"]
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * shared)).select("source", "source_size", "rank", "weight", "target")


def _pieces(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(t0, t1, w0, slope, demand before t0) of each piece; demand runs from 0 to 1."""
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        out.append((t0, t1, w0 / total, (w1 - w0) / (t1 - t0) / total, done))
        done += (t1 - t0) * (w0 + w1) / 2 / total
    return out


def demand_at(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which the cumulative demand of the schedule reaches share (0 to 1): the inverse of its integral.

    Within a piece, demand is done + w0 x + slope x^2 / 2; the root is taken in the form that stays exact for slope 0.
    """
    out = F.lit(None).cast("double")
    for t0, t1, w0, slope, done in reversed(_pieces(schedule)):
        y = F.greatest(share - F.lit(done), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * F.lit(slope) * y, F.lit(0.0)))
        at = F.least(F.lit(t0) + F.when(y > 0, 2 * y / (F.lit(w0) + root)).otherwise(0.0), F.lit(t1))
        out = at if out is None else F.when((share >= F.lit(done)) & out.isNull(), at).otherwise(out)
    return out


def _position(share: Column, rank: Column, schedules: Sequence) -> Column:
    out = None
    for i, s in enumerate(schedules):
        hit = rank % len(schedules) == i
        out = F.when(hit, demand_at(share, s)) if out is None else out.when(hit, demand_at(share, s))
    return out


def _sized(docs: DataFrame, prefix_hex: int) -> DataFrame:
    """docs with size, and what places a document within its source; `text` is read here only."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumns({"size": F.regexp_count(text, F.lit(WORD)).cast("long"), "_hash": F.md5(key_text("doc_id")), "_crc": F.crc32(text)}).drop("text")
    return rows.withColumns({"_range": F.substring("_hash", 1, prefix_hex), "_s": F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))})


def _ranges(sized: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """A row for each hash range of each source: the words before it, and the source's size, target, rank and passes."""
    sums = materialise(sized.groupBy("_s", "_range").agg(F.sum("size").alias("_n"), F.first("source").alias("source")), "mix-ranges")
    targets = plan_targets(sums.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, max_epochs)
    some = F.col("source_size") > 0
    full = F.least(F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0), F.lit(max_epochs)).cast("long")
    targets = targets.withColumn("_full", full).withColumn("_rest", F.when(some, F.col("target") - F.col("_full") * F.col("source_size")).otherwise(F.lit(0.0)))
    before = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("source", "_s", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    t = targets.withColumnRenamed("source", "_ts")
    return begins.join(t, F.col("source").eqNullSafe(F.col("_ts"))).select("_s", "_range", "_before", "source_size", "target", "rank", "_full", "_rest")


def _placed(sized: DataFrame, ranges: DataFrame, max_epochs: int) -> DataFrame:
    """sized with source_size, target, rank, _full (whole passes), _rest (words of the last pass), _begin and _part."""
    inside = Window.partitionBy("_s", "_range").orderBy("_hash", F.col("doc_id").asc_nulls_last(), "_crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, ["_s", "_range"])
    placed = placed.withColumn("_begin", F.col("_in") + F.col("_before"))
    part = (F.col("size") > 0) & (F.col("_full") < max_epochs) & (F.col("_begin") + F.col("size") <= F.col("_rest"))
    return placed.withColumn("_part", part).drop("_hash", "_crc", "_range", "_in", "_before")


def _gaps(placed: DataFrame, max_epochs: int) -> DataFrame:
    """For each source (_s): _got, the words of its last pass, and _fill, the _begin of the document that fills the gap best."""
    got = placed.groupBy("_s").agg(F.max("_rest").alias("_rest"), F.coalesce(F.sum(F.when(F.col("_part"), F.col("size"))), F.lit(0)).alias("_got"))
    gaps = got.withColumn("_gap", F.col("_rest") - F.col("_got"))
    left = placed.where(~F.col("_part") & (F.col("size") > 0) & (F.col("_full") < max_epochs)).select("_s", "_begin", "size")
    off = F.abs(F.col("size") - F.col("_gap"))
    near = left.join(bounded(gaps, "mix-gaps"), "_s").where(off < F.col("_gap"))
    best = near.groupBy("_s").agg(F.min(F.struct(off.alias("off"), F.col("_begin").alias("at")))["at"].alias("_fill"))
    return gaps.join(best, "_s", "left").select("_s", "_got", "_fill")


def _decided(placed: DataFrame, gaps: DataFrame) -> DataFrame:
    """placed with copies, taken and _fills."""
    out = placed.join(gaps, "_s", "left")
    fills = F.coalesce((F.col("_begin") == F.col("_fill")) & (F.col("size") > 0) & ~F.col("_part"), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("_full") + (F.col("_part") | fills).cast("int")).otherwise(F.lit(0)).cast("int")
    return out.withColumn("_fills", fills).withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def _at(epoch: Column, schedules: Sequence) -> Column:
    """Training time of the middle of a document's copy in pass `epoch` of its source."""
    begin = F.when(F.col("_fills") & (epoch == F.col("_full")), F.col("_got")).otherwise(F.col("_begin"))
    share = (epoch * F.col("source_size") + begin + F.col("size") / 2) / F.col("target")
    return _position(F.least(share, F.lit(1.0)), F.col("rank"), schedules)


def _planned(docs: DataFrame, weights: Sequence[float], max_epochs: int, prefix_hex: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The decided rows without texts, the ranges and the gaps; each text is read once."""
    sized = materialise(_sized(docs.select("doc_id", "text", "source"), prefix_hex), "mix-sizes")
    ranges = bounded(_ranges(sized, weights, max_epochs), "mix-begins")
    placed = materialise(_placed(sized, ranges, max_epochs), "mix-plan")
    gaps = bounded(_gaps(placed, max_epochs), "mix-filled")
    return _decided(placed, gaps), ranges, gaps


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence = SCHEDULES, max_epochs: int = MAX_EPOCHS, prefix_hex: int = 3) -> DataFrame:
    """One row per document, range-sorted by its first training position: doc_id, source, size, source_size, target, taken, copies, first_position, last_position.

    Documents of a source stand in the order of the hash of doc_id. Whole passes over a source come first; the last pass
    takes what ends within the target, and one more document, the one whose size is closest to the gap, fills it. So
    copies (0 to max_epochs) are whole documents, and the words taken come as near the target as some document fits.
    Each source's weight over training time is integrated; a copy's place in its source's words, as a share of the
    target, is taken through the inverse of that integral, which is its position (0 to 1). Documents that are not taken
    have none and come last. Running sums go over hash ranges (16^prefix_hex for each source), so that no task sorts a
    whole source.
    Null text: size 0, never taken. A null source is a source of its own, ranked last. Rows of one doc_id stand by their
    text's CRC-32 and size; alike rows are taken as if they had different keys. Other columns are not read. An empty
    table gives an empty one.
    """
    require(docs, ["doc_id", "text", "source"])
    rows, _, _ = _planned(docs, weights, max_epochs, prefix_hex)
    taken = F.col("copies") > 0
    rows = rows.withColumns({"first_position": F.when(taken, _at(F.lit(0), schedules)), "last_position": F.when(taken, _at(F.col("copies").cast("long") - 1, schedules))})
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "first_position", "last_position")
    order = F.coalesce("first_position", F.lit(2.0))
    return rows.repartitionByRange(order, F.col("doc_id")).sortWithinPartitions(order, "doc_id")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence = SCHEDULES, max_epochs: int = MAX_EPOCHS, prefix_hex: int = 3) -> DataFrame:
    """The mix itself: each document as many times as plan_mix has it, with `position` (0 to 1) and `pass`, range-sorted by position.

    Columns of docs pass through, whatever their names; `position` and `pass` of docs are replaced.
    """
    require(docs, ["doc_id", "text", "source"])
    docs = docs.drop("position", "pass")
    _, ranges, gaps = _planned(docs, weights, max_epochs, prefix_hex)
    renamed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source")
    rows = _decided(_placed(_sized(renamed, prefix_hex), ranges, max_epochs), gaps).where("copies > 0")
    # the passes of a document: 0, 1, ... copies - 1; the part pass is pass _full
    rows = rows.withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)))
    rows = rows.select("_row.*", _at(F.col("_pass"), schedules).alias("position"), F.col("_pass").cast("int").alias("pass"))
    return rows.repartitionByRange(rows["position"], rows["doc_id"]).sortWithinPartitions("position", "doc_id", "pass")
