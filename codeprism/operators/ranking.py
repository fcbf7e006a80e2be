"""Ranking, curation, roll-ups and before/after verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_robin(rows: DataFrame, project: str, function: str, order: Sequence[Column], per_project: int = 7, most: int = 30) -> DataFrame:
    """Up to `most` rows, the k-th best of every project before any k+1-th, one per function, per_project of a project.

    Ranks are taken before duplicates go, as skipped ones use up no quota. All but the last window are partitioned; the
    last sorts what the caps have left, at most per_project rows of a project.
    """
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(project).orderBy(*order)))
    once = ranked.withColumn("_d", F.row_number().over(Window.partitionBy(function).orderBy("_rn", project))).where("_d = 1")
    capped = once.withColumn("_p", F.row_number().over(Window.partitionBy(project).orderBy("_rn"))).where(F.col("_p") <= per_project)
    # a top-k by design; the limit is taken in each task first
    top = capped.orderBy("_rn", project).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy("_rn", project)).cast("long")).drop("_rn", "_d", "_p")


def dominant(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, the most frequent value (ties: the smallest), its count, the total and their ratio."""
    n = rows.groupBy(by, value).agg(F.count("*").alias("access"))
    best = n.groupBy(by).agg(F.min(F.struct((-F.col("access")).alias("m"), F.col(value).alias("v"))).alias("b"), F.sum("access").alias("total"))
    return best.select(by, F.col("b.v").alias("receiver"), (-F.col("b.m")).alias("access"), "total", (-F.col("b.m") / F.col("total")).alias("ratio"))


def audit_rollup(rows: DataFrame, by: str, captured: Column, seconds: Column) -> DataFrame:
    """Overall (null) and by group: n_rows, captured, rate, total, mean, median and nearest-rank 90th percentile of seconds."""
    base = rows.select(F.col(by).alias("grp"), captured.cast("long").alias("c"), seconds.alias("s"))
    return base.sparkSession.sql(
        """
        SELECT grp, count(*) AS n_rows, sum(c) AS captured, sum(c) / count(*) AS rate, cast(sum(cast(s AS decimal(18,2))) AS double) AS total,
          cast(sum(cast(s AS decimal(18,2))) AS double) / count(*) AS mean, median(s) AS median, percentile_disc(0.9) WITHIN GROUP (ORDER BY s) AS p90
        FROM {rows} GROUP BY GROUPING SETS ((), (grp))""",
        rows=base,
    )


def best_so_far(rows: DataFrame, by: str, order: Sequence[str], rank: str, key: str) -> DataFrame:
    """rows with the key of the best rank up to and with each; of equal ranks the earlier stays."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_n", place).withColumn("best", F.max(F.struct(F.col(rank).alias("r"), (-F.col("_n")).alias("n"), F.col(key).alias("k"))).over(w)["k"]).drop("_n")


def sessions(rows: DataFrame, by: str, at: str, gap: str = "300 seconds") -> DataFrame:
    """Runs of a key's rows with less than gap between them."""
    out = rows.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n_events"), F.min(at).alias("first_ts"), F.max(at).alias("last_ts"))
    return out.select(by, "first_ts", "last_ts", "n_events")



def candidate_order(smell: str) -> list[Column]:
    """How candidates of a smell are ranked: strongest envy first; of names the short ones, `_` last."""
    if smell == "feature_envy":
        return [F.col("metric_value").desc(), F.col("file"), F.col("begin_line")]
    return [F.col("finding_name") == "_", F.col("metric_value"), F.col("file"), F.col("begin_line")]


def _taken(ordered: DataFrame, most: int, per_project: int, free: Column | None = None) -> DataFrame:
    """Of candidates with `turn` (their round-robin place) those that the caps let in: per_project of each, one per function, most in all.

    free: how many a project may still have. The function's first candidate is the one that counts; all windows but the
    last are partitioned, the last sorts what the caps have left.
    """
    first = Window.partitionBy("project", "file", "begin_line").orderBy("turn")
    once = ordered.withColumn("_f", F.row_number().over(first)).where("_f = 1")
    capped = once.withColumn("_p", F.row_number().over(Window.partitionBy("project").orderBy("turn"))).where(F.col("_p") <= (free if free is not None else F.lit(per_project)))
    return capped.orderBy("turn", "project").limit(most).drop("_f", "_p")


def turns(candidates: DataFrame, order: Sequence[Column]) -> DataFrame:
    """candidates with turn: their place within the project."""
    return candidates.withColumn("turn", F.row_number().over(Window.partitionBy("project").orderBy(*order)))


def curate(candidates: DataFrame, order: Sequence[Column], most: int = 30, per_project: int = 7) -> DataFrame:
    """candidates (project, file, begin_line, id, ...) with selected: up to `most` in turns over the projects; the rest are backups."""
    ranked = turns(candidates, order)
    chosen = _taken(ranked, most, per_project).select("id", F.lit(True).alias("_s"))
    return ranked.join(F.broadcast(chosen), "id", "left").withColumn("selected", F.coalesce("_s", F.lit(False))).drop("_s")


def select_valid(curated: DataFrame, valid: Column, most: int = 30, per_project: int = 7) -> DataFrame:
    """The selected that are valid, and for each that is not the next valid backups under the same caps: id, replacement."""
    rows = curated.withColumn("_v", F.coalesce(valid, F.lit(False)))
    kept = rows.where("selected and _v")
    counts = kept.groupBy("project").agg(F.count("*").alias("_c"))
    used = kept.select("project", "file", "begin_line").distinct()
    spare = rows.where("not selected and _v").join(F.broadcast(used), ["project", "file", "begin_line"], "left_anti").join(F.broadcast(counts), "project", "left")
    room = max(0, most - kept.count())  # kept has `most` rows at most
    more = _taken(spare, room, per_project, F.lit(per_project) - F.coalesce("_c", F.lit(0)))
    return kept.select("id", F.lit(False).alias("replacement")).unionByName(more.select("id", F.lit(True).alias("replacement")))


def keep_existing(existing: DataFrame, candidates: DataFrame, order: Sequence[Column], valid: Column, most: int = 30, per_project: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows, drops): existing rows (sample_id, project, file, begin_line) that are still candidates and valid, then new ones up to `most`.

    rows: id, added. drops: sample_id, reason. Existing rows keep their order; the cap of a project counts the valid
    ones before them.
    """
    key = ["project", "file", "begin_line"]
    pool = candidates.withColumn("_v", F.coalesce(valid, F.lit(False)))
    one = pool.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("id")))).where("_n = 1").drop("_n")
    old = existing.join(one.select(*key, "id", "_v"), key, "left")
    before = F.count(F.when(F.col("_v"), 1)).over(Window.partitionBy("project").orderBy("sample_id").rowsBetween(Window.unboundedPreceding, -1))
    old = old.withColumn("reason", F.when(F.col("id").isNull(), "no longer a candidate (filtered)").when(before >= per_project, "per-project cap").when(~F.col("_v"), "detector revalidation failed"))
    kept = old.where("reason is null").orderBy("sample_id").select("id", *key)
    counts = kept.groupBy("project").agg(F.count("*").alias("_c"))
    rest = turns(pool.join(F.broadcast(kept.select(*key).distinct()), key, "left_anti"), order).where("_v").join(F.broadcast(counts), "project", "left")
    added = _taken(rest, max(0, most - kept.count()), per_project, F.lit(per_project) - F.coalesce("_c", F.lit(0)))
    rows = kept.select("id", F.lit(False).alias("added")).unionByName(added.select("id", F.lit(True).alias("added")))
    return rows, old.where("reason is not null").select("sample_id", "reason")


def status_summary(plans: DataFrame, results: DataFrame) -> DataFrame:
    """One row: plan_count, completed, success (every plan passed) and category_counts of results (execution_id, category)."""
    counts = results.groupBy(F.coalesce("category", F.lit("INFRA_FAILED")).alias("category")).agg(F.count("*").alias("n"))
    c = counts.agg(F.sum("n").alias("completed"), F.sum(F.when(F.col("category") == "PASS", F.col("n"))).alias("passed"), F.array_sort(F.collect_list(F.struct("category", "n"))).alias("categories"))
    p = plans.agg(F.count("*").alias("plan_count"))
    out = p.join(F.broadcast(c))  # one row each
    return out.select("plan_count", F.coalesce("completed", F.lit(0)).alias("completed"), ((F.col("completed") == F.col("plan_count")) & (F.col("passed") == F.col("plan_count"))).alias("success"), F.map_from_entries("categories").alias("category_counts"))


def execution_plans(samples: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Samples grouped by what they execute: execution_id (digest of the named inputs), n_samples, first_sample."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(inputs)]))
    return samples.withColumn("execution_id", F.sha2(body, 256)).groupBy("execution_id").agg(F.count("*").alias("n_samples"), F.min("sample_id").alias("first_sample"))


def conflicting(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys whose rows disagree on some value (null is a value): by, n_rows."""
    n = [F.countDistinct(F.coalesce(F.col(v).cast("string"), F.lit("\0"))).alias(f"_{v}") for v in values]
    g = rows.groupBy(*by).agg(F.count("*").alias("n_rows"), *n)
    return g.where(" or ".join(f"`_{v}` > 1" for v in values)).select(*by, "n_rows")


def filter_samples(samples: DataFrame, where: Column, order: Sequence[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Samples that hold, in a stable order, without the first `offset`, at most `limit`: a user's choice of a run."""
    out = samples.where(where).orderBy(*order).offset(offset)
    return out.limit(limit) if limit is not None else out


def nearest_rank(rows: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """Nearest-rank percentiles of each key, exact: value counts merge first, then a running count over distinct values finds the rank."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(value)
    running = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    picks = [F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("total") * f), F.lit(1)), F.col(value))).alias(f"p{round(f * 100)}") for f in fractions]
    return running.groupBy(*by).agg(*picks)
