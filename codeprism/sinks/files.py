"""Sinks: curated samples, appended results, JSON artifacts under size limits, write-once baselines, Markdown summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Size limits in bytes.
DECISION_BYTES = 64 << 10
EVIDENCE_BYTES = 2 << 20


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with its keys in order, without spaces; null values are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def sample_rows(rows: DataFrame, order: list[str], context: dict[str, Column]) -> DataFrame:
    """rows renumbered from 1 by `order`, with target_context_json; a curated sample, bounded by its caps."""
    w = Window.orderBy(*order)
    return rows.withColumns({"sample_id": F.row_number().over(w).cast("long"), "target_context_json": canonical_json(context)})


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header, quotes doubled, as sample tables are read; for bounded tables."""
    rows.coalesce(1).write.mode("overwrite").options(header=True, quote='"', escape='"', lineSep="\n").csv(path)


def append_results(rows: DataFrame, path: str) -> None:
    """Add rows to a result table; each part has the header, so readers see it once."""
    rows.write.mode("append").options(header=True, quote='"', escape='"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", emptyValue="", nullValue="\u0000").csv(path)


def within(json: Column, limit: int) -> Column:
    """The JSON text; an error if it has more bytes than the limit."""
    size = F.octet_length(json)
    return F.when(size > limit, F.raise_error(F.concat(F.lit("artifact of "), size.cast("string"), F.lit(f" bytes exceeds {limit}")))).otherwise(json)


def write_json(rows: DataFrame, path: str, limit: int | None = None) -> None:
    """A JSON object a line, keys in order; beyond the limit of bytes the write fails."""
    text = canonical_json({c: F.col(c) for c in rows.columns})
    rows.select((within(text, limit) if limit else text).alias("value")).write.mode("overwrite").text(path)


def write_artifacts(rows: DataFrame, path: str) -> None:
    """decision (64 KiB a row), evidence (2 MiB a row) and log of each sample, in folders of their own; rows: sample_id, decision, evidence, log."""
    for name, limit in (("decision", DECISION_BYTES), ("evidence", EVIDENCE_BYTES), ("log", None)):
        rows.select("sample_id", (within(F.col(name), limit) if limit else F.col(name)).alias(name)).write.mode("overwrite").json(f"{path}/{name}")


def capture_baseline(rows: DataFrame, path: str) -> None:
    """Write a baseline that nothing replaces: an existing one is an error. Each row is sealed by its digest."""
    body = canonical_json({c: F.col(c) for c in rows.columns})
    rows.withColumn("seal", F.sha2(body, 256)).write.mode("errorifexists").parquet(path)


def broken_seals(baseline: DataFrame) -> DataFrame:
    """Rows of a baseline whose digest no longer is their seal."""
    body = canonical_json({c: F.col(c) for c in baseline.columns if c != "seal"})
    return baseline.where(~F.col("seal").eqNullSafe(F.sha2(body, 256)))


def tree_digest(files: DataFrame, by: list[str]) -> DataFrame:
    """by and the SHA-256 of the key-sorted JSON object of path -> sha256 of each group (a project's manifest: bounded)."""
    pairs = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(quoted(p["path"]), F.lit(":"), quoted(p["sha256"]))), ","), F.lit("}"))
    return files.groupBy(*by).agg(F.sha2(text, 256).alias("tree_sha256"))


def best_checkpoints(checkpoints: DataFrame, by: list[str], rank: str, order: str) -> DataFrame:
    """The checkpoint of the largest rank of each key; of equal ranks the first stays. Ranks are comparable structs; null ones don't count."""
    some = checkpoints.where(F.col(rank).isNotNull())
    best = some.groupBy(*by).agg(F.max(F.struct(F.col(rank).alias("r"), (-F.col(order)).alias("o"))).alias("m"))
    return best.select(*by, (-F.col("m.o")).alias(order), F.col("m.r").alias(rank))


def markdown(rows: DataFrame, title: str) -> str:
    """A summary table (bounded, as roll-ups are) as Markdown."""
    cell = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(x) for x in r) + " |" for r in rows.orderBy(*rows.columns).collect())]) + "\n"
