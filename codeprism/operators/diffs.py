"""Diff algebra over lines of hunks: changed ranges, blocks, line maps, replacements, removed declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logs import strip


def _placed(lines: DataFrame) -> DataFrame:
    """lines with `block`, the number of context lines before each within its hunk: a replacement block has one number.

    Within a block removed lines come before added ones, as patches write them. Context lines are counted along the old and
    along the new lines of a hunk, so a hunk of any length takes one sort.
    """
    old = lines.where("kind <> '+'").withColumns({"_side": F.lit(0), "_at": F.col("old_line")})
    new = lines.where("kind <> '-'").withColumns({"_side": F.lit(1), "_at": F.col("new_line")})
    w = Window.partitionBy("file", "hunk", "_side").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counted = old.unionByName(new).withColumn("block", F.coalesce(F.sum((F.col("kind") == " ").cast("int")).over(w), F.lit(0)).cast("int"))
    return counted.where("_side = 0 or kind = '+'").drop("_side", "_at")


def changed_ranges(lines: DataFrame) -> DataFrame:
    """file, hunk, begin and end (new lines) of each run of added lines; a block that only deletes anchors the line before it."""
    placed = _placed(lines)
    added = blocks(lines, "+").select("file", "hunk", "begin", "end")
    block = placed.where("kind <> ' '").groupBy("file", "hunk", "block").agg(F.count_if(F.col("kind") == "+").alias("n"))
    # the new line of the context before a block; the hunk's first line less one without any
    context = placed.where("kind = ' '").select("file", "hunk", (F.col("block") + 1).alias("block"), F.col("new_line").alias("at"))
    first = lines.groupBy("file", "hunk").agg(F.min(F.coalesce("new_line", "old_line")).alias("first"))
    only = block.where("n = 0").join(context, ["file", "hunk", "block"], "left").join(first, ["file", "hunk"])
    anchor = F.greatest(F.coalesce("at", F.col("first") - 1), F.lit(1))
    return added.unionByName(only.select("file", "hunk", anchor.alias("begin"), anchor.alias("end")))


def blocks(lines: DataFrame, kind: str = "+") -> DataFrame:
    """Contiguous runs of added (or removed) lines: file, hunk, begin, end, content."""
    at = "new_line" if kind == "+" else "old_line"
    w = Window.partitionBy("file", "hunk").orderBy(at)
    run = lines.where(F.col("kind") == kind).withColumn("_g", F.col(at) - F.row_number().over(w))
    ordered = F.array_sort(F.collect_list(F.struct(at, "content")))
    return run.groupBy("file", "hunk", "_g").agg(F.min(at).alias("begin"), F.max(at).alias("end"), F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("content")).drop("_g")


def map_lines(targets: DataFrame, lines: DataFrame) -> DataFrame:
    """targets (file, old_line) with new_line: context by its place, the n-th removed line of a block to its n-th added one.

    Lines outside of hunks move by what the last hunk before them has moved; a removed line without a counterpart has none.
    """
    placed = _placed(lines)
    place = lambda c: F.row_number().over(Window.partitionBy("file", "hunk", "block").orderBy(c))
    removed = placed.where("kind = '-'").withColumn("n", place("old_line")).select("file", "hunk", "block", "n", "old_line")
    added = placed.where("kind = '+'").withColumn("n", place("new_line")).select("file", "hunk", "block", "n", "new_line")
    inside = placed.where("kind = ' '").select("file", "old_line", F.col("new_line").alias("_in"))
    inside = inside.unionByName(removed.join(added, ["file", "hunk", "block", "n"], "left").select("file", "old_line", F.col("new_line").alias("_in"))).withColumn("_hit", F.lit(True))
    # by how much lines behind each hunk have moved
    hunk = lines.groupBy("file", "hunk").agg(F.max("old_line").alias("_last"), F.sum(F.when(F.col("kind") == "+", 1).when(F.col("kind") == "-", -1).otherwise(0)).alias("_delta"), F.min("new_line").alias("_first"))
    hunk = hunk.withColumn("_last", F.coalesce("_last", F.col("_first") - 1))
    before = targets.select("file", "old_line").distinct().join(hunk, "file").where("_last < old_line").groupBy("file", "old_line").agg(F.sum("_delta").alias("_moved"))
    out = targets.join(inside, ["file", "old_line"], "left").join(before, ["file", "old_line"], "left")
    return out.withColumn("new_line", F.when(F.col("_hit"), F.col("_in")).otherwise(F.col("old_line") + F.coalesce("_moved", F.lit(0)))).drop("_in", "_hit", "_moved")


def identity_verdicts(baseline: DataFrame, current: DataFrame, lines: DataFrame) -> DataFrame:
    """For each frozen target (target, file, old_line, name, owner): what became of it: kept, moved, renamed, missing or ambiguous.

    current: file, line, name, owner of declarations. Only the declaration on the mapped line counts, so one of the same
    name elsewhere can't stand in for a removed one.
    """
    at = map_lines(baseline, lines)
    now = current.select("file", F.col("line").alias("new_line"), F.col("name").alias("_name"), F.col("owner").alias("_owner"))
    both = at.join(now, ["file", "new_line"], "left").groupBy("target", "file", "old_line", "name", "owner", "new_line")
    got = both.agg(F.count("_name").alias("n"), F.min("_name").alias("_name"), F.min("_owner").alias("_owner"))
    same = (F.col("name") == F.col("_name")) & F.col("owner").eqNullSafe(F.col("_owner"))
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").when(~same, "renamed").when(F.col("old_line") == F.col("new_line"), "kept").otherwise("moved")
    return got.select("target", "file", "old_line", "new_line", status.alias("status"))


def replaced_identifiers(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """pairs (old_line, current_line, old_name, new_name) with ok: both names stand, as whole words, on removed and added lines of exactly one common hunk."""
    whole = lambda text, name: text.rlike(F.concat(F.lit(r"(?<![A-Za-z0-9_$])\Q"), name, F.lit(r"\E(?![A-Za-z0-9_$])")))
    key = ["old_line", "current_line", "old_name", "new_name"]
    old = pairs.join(lines.where("kind = '-'").select("file", "hunk", "old_line", "content"), "old_line").where(whole(F.col("content"), F.col("old_name")))
    new = pairs.join(lines.where("kind = '+'").select("file", "hunk", F.col("new_line").alias("current_line"), "content"), "current_line").where(whole(F.col("content"), F.col("new_name")))
    side = lambda d, n: d.groupBy(*key).agg(F.count("*").alias(f"n_{n}"), F.min(F.struct("file", "hunk")).alias(n))
    ok = F.coalesce((F.col("n_a") == 1) & (F.col("n_b") == 1) & (F.col("a") == F.col("b")), F.lit(False))
    return pairs.join(side(old, "a"), key, "left").join(side(new, "b"), key, "left").select(*key, ok.alias("ok"))


def deletion_witness(content: Column, begin: Column, end: Column) -> Column:
    """SHA-256 of each line of a declaration, and of all of them together; null if the span leaves the text."""
    lines = F.split(F.regexp_replace(content, r"\r?\n\z", ""), r"\r?\n", -1)
    hashes = F.transform(F.slice(lines, begin, end - begin + 1), lambda x: F.sha2(x, 256))
    return F.when((begin >= 1) & (end >= begin) & (end <= F.size(lines)), F.struct(hashes.alias("line_hashes"), F.sha2(F.array_join(hashes, "\n"), 256).alias("declaration_sha256")))


def anchor_deletions(witness: DataFrame, lines: DataFrame) -> DataFrame:
    """target and deleted of frozen declarations (target, file, begin, line_hashes): every line is removed, byte for byte, at its place."""
    each = witness.select("target", "file", F.size("line_hashes").alias("n"), F.posexplode("line_hashes").alias("i", "hash"), "begin").withColumn("old_line", F.col("begin") + F.col("i"))
    gone = lines.where("kind = '-'").select("file", "old_line", F.sha2("content", 256).alias("hash"))
    return each.join(gone.withColumn("gone", F.lit(1)), ["file", "old_line", "hash"], "left").groupBy("target").agg((F.count("gone") == F.max("n")).alias("deleted"))


def removed_pure_virtuals(lines: DataFrame, headers: tuple[str, ...] = (".h", ".hh", ".hpp", ".hxx")) -> DataFrame:
    """file and declaration of pure virtual functions that a patch removes from a header and does not add to it again."""
    flat = strip(F.regexp_replace(F.regexp_replace("content", r"//.*$", ""), r"\s+", " "))
    pure = lines.where(F.col("kind").isin("-", "+")).select("kind", "file", flat.alias("declaration")).where(F.col("declaration").rlike(r"\bvirtual\b.*\)\s*.*=\s*0\s*;"))
    header = F.lower("file").rlike("(?:" + "|".join(h.replace(".", r"\.") for h in headers) + r")$")
    removed = pure.where("kind = '-'").where(header).select("file", "declaration").distinct()
    return removed.join(pure.where("kind = '+'").select("file", "declaration"), ["file", "declaration"], "left_anti")


def changed_signatures(before: DataFrame, after: DataFrame) -> DataFrame:
    """target and code of public Python functions whose parameters changed or can't be told; before, after: target, name, params, resolved."""
    a = after.where("resolved").select("target", F.col("params").alias("_now"))
    both = before.where(~F.col("name").startswith("_") | F.col("name").rlike("^__.*__$")).join(a, "target")
    code = F.when(F.col("params").isNull() | F.col("_now").isNull(), "PUBLIC_PYTHON_SIGNATURE_UNAVAILABLE").when(F.col("params") != F.col("_now"), "PUBLIC_PYTHON_SIGNATURE_CHANGED")
    return both.select("target", code.alias("code")).where("code is not null")


def production_source(path: Column, language: Column) -> Column:
    """Whether a path is a production source of its language: by extension, outside of test and build folders."""
    # fixed values: folders and extensions
    full = F.concat(F.lit("/"), F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", ""))
    kinds = {"java": r"\.java$", "python": r"\.py$", "c": r"\.[ch]$", "cpp": r"\.(?:cpp|cc|cxx|hpp|hh|hxx|h)$"}
    known = F.lit(False)
    for name, pattern in kinds.items():
        known = F.when(language == name, full.rlike(pattern)).otherwise(known)
    marks = ("/src/test/", "/src/it/", "/tests/", "/test/", "/build/", "/build-refactoragent/", "/cmake-build-", "/.venv/", "/dist/")
    return known & ~F.lower(full).rlike("|".join(m.replace(".", r"\.") for m in marks))
