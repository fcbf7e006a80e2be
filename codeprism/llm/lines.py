"""Line deduplication: winnowed line hashes find repeated runs of lines; later ones are deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise, require

#: Runs of so many equal lines or more are found, always: each window of RUN line hashes gives its smallest one.
RUN = 3
#: A line of so many bytes or more is a run by itself.
LONG = 200


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1).alias("lines"))


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, two independent hashes of each line (h, g) and whether it is long."""
    h = F.transform("lines", lambda x: F.xxhash64(x))
    g = F.transform("lines", lambda x: F.xxhash64(F.lit("second"), x))
    return _lines(docs).select("doc_id", h.alias("h"), g.alias("g"), F.transform("lines", lambda x: F.octet_length(x) >= LONG).alias("long"))


def fingerprints(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The winnowed fingerprints of each text: doc_id, at, fp, and the hashes of up to run - 1 lines to both sides (h_j, g_j).

    The smallest hash of each window of `run` lines is a fingerprint, the right-most of equal ones; windows that
    choose the same place give one row.
    """
    rows = _hashed(docs).where(F.size("h") >= run).select("doc_id", "h", "g", F.explode(F.sequence(F.lit(0), F.size("h") - run)).alias("p"))

    def chosen(p: Column) -> Column:
        part = [F.get("h", p + j) for j in range(run)]
        least = F.least(*part) if run > 1 else part[0]
        return F.coalesce(*[F.when(part[j] == least, p + j) for j in reversed(range(run))])

    fresh = (F.col("p") == 0) | (F.col("at") != chosen(F.greatest(F.col("p") - 1, F.lit(0))))
    rows = rows.withColumn("at", chosen(F.col("p"))).where(fresh)
    side = [F.when(F.col("at") + j >= 0, F.get(c, F.greatest(F.col("at") + j, F.lit(0)))).alias(f"{c}_{j + run}") for c in "hg" for j in range(1 - run, run)]
    return rows.select("doc_id", "at", F.get("h", "at").alias("fp"), *side)


def _extended(prints: DataFrame, run: int) -> DataFrame:
    """The windows that chose each fingerprint, from its line to both sides: doc_id, p, n, w1, w2 (two hashes of all lines)."""
    h, g = ({j: F.col(f"{c}_{j + run}") for j in range(1 - run, run)} for c in "hg")
    windows = []
    for left in range(run):
        places = range(-left, run - left)
        whole = [h[j].isNotNull() for j in places]
        # the fingerprint is the right-most least of the window
        best = [h[j] >= F.col("fp") if j < 0 else h[j] > F.col("fp") for j in places if j]
        hold = whole[0]
        for x in whole[1:] + best:
            hold = hold & x
        w = F.struct((F.col("at") - left).alias("p"), F.xxhash64(*[h[j] for j in places]).alias("w1"), F.xxhash64(F.lit("window"), *[g[j] for j in places]).alias("w2"))
        windows.append(F.when(hold, w))
    out = prints.select("doc_id", F.explode(F.array(*windows)).alias("w")).where("w is not null")
    return out.select("doc_id", "w.p", F.lit(run).alias("n"), "w.w1", "w.w2")


def repeated_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Runs of n lines that also stand earlier (smaller doc_id, or before in the same text): doc_id, p, n.

    Winnowing: two equal runs of `run` lines share a fingerprint at the same place, so only fingerprints that stand at
    several places are followed. From each of their places the match is extended line by line to both sides, as the
    windows around it; windows of equal lines (two independent hashes of 64 bits for each line) are one class, whose
    first place stays. Longer runs are what several windows cover. No pairs are made, however often a line repeats.
    Lines of LONG bytes or more are runs of one line.
    """
    prints = materialise(fingerprints(docs, run), "line-prints")
    # first and last place of a fingerprint tell whether there are more
    place = F.struct("doc_id", "at")
    marks = prints.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a != z").select("fp")
    around = _extended(prints.join(bounded(marks, "line-marks"), "fp", "left_semi"), run)
    alone = _hashed(docs).where(F.exists("long", lambda x: x)).select("doc_id", "h", "g", F.posexplode("long").alias("p", "alone")).where("alone")
    runs = materialise(around.unionByName(alone.select("doc_id", "p", F.lit(1).alias("n"), F.get("h", "p").alias("w1"), F.get("g", "p").alias("w2"))), "line-runs")
    first = runs.groupBy("n", "w1", "w2").agg(F.min(F.struct("doc_id", "p")).alias("first"), F.max(F.struct("doc_id", "p")).alias("last")).where("first != last")
    # a table of its own: a class with a large share of the runs is split by adaptive execution
    later = runs.join(bounded(first.select("n", "w1", "w2", "first"), "line-first"), ["n", "w1", "w2"]).where(F.struct("doc_id", "p") > F.col("first"))
    return later.select("doc_id", "p", "n")


def dedup_lines(docs: DataFrame, run: int = RUN) -> DataFrame:
    """docs' doc_id, kept_text, n_lines, n_removed, n_runs: each line within a later repeat of a run is deleted.

    Lines end at \\n; others are part of their line. What repeats is judged on the input, not on what is left. A text of
    fewer lines than `run` loses long lines only. Null text: one empty line, as for an empty one. Rows that share doc_id
    count as one document at equal places: they delete nothing from each other, and the places removed hold for each.
    Null doc_ids come first. Other columns are not read; an empty table gives an empty one.
    """
    require(docs, ["doc_id", "text"])
    gone = repeated_runs(docs, run).select("doc_id", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("n") - 1)).alias("line"))
    gone = gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("gone")).withColumnRenamed("doc_id", "gone_id")
    rows = _lines(docs).join(bounded(gone, "line-gone"), F.col("doc_id").eqNullSafe(F.col("gone_id")), "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    # by places, in time proportional to the lines
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    kept = F.when(F.size("gone") == 0, F.col("lines")).otherwise(left)
    runs = F.size(F.filter("gone", lambda x, i: (i == 0) | (F.get(F.col("gone"), F.greatest(i - 1, F.lit(0))) != x - 1)))
    return rows.select("doc_id", F.array_join(kept, "\n").alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), runs.cast("long").alias("n_runs"))
