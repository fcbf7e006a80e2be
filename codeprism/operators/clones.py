"""Exact and near clones: groups, pairs, containment, shared windows and their maximal extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clone_tokens, fingerprint, lexical_tokens, sketch
from ..storage import small_side


def fingerprints(rows: DataFrame, key: str, text: str, language: Column | None = None) -> DataFrame:
    """key, n_tokens and fingerprint of each text; with a language, comments are stripped first."""
    t = rows.select(key, clone_tokens(F.col(text), language).alias("t"))
    return t.select(key, F.size("t").cast("long").alias("n_tokens"), fingerprint(F.col("t")).alias("fingerprint"))


def clone_score(first: Column, second: Column, language: Column) -> Column:
    """Tokens of two bodies that are the same sequence; else 0."""
    a, b = clone_tokens(first, language), clone_tokens(second, language)
    return F.when((F.size(a) > 0) & (a == b), F.size(a)).otherwise(0).cast("long")


def clone_groups(prints: DataFrame, key: str) -> DataFrame:
    """Fingerprints with two members or more; members merge before the shuffle."""
    some = prints.where(F.col("fingerprint") != "")
    return some.groupBy("fingerprint").agg(F.count("*").alias("n_members"), F.min(key).alias("first_member"), F.max(key).alias("last_member"), F.max("n_tokens").alias("n_tokens")).where("n_members > 1")


def clone_pairs(prints: DataFrame, key: str) -> DataFrame:
    """Each further member with its group's first: as many rows as members, not as pairs."""
    groups = clone_groups(prints, key).select("fingerprint", F.col("first_member").alias("a"))
    return prints.join(groups, "fingerprint").where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"), F.col("n_tokens").alias("score"))


def _windows(rows: DataFrame, key: str, text: str, n: int, at: str) -> DataFrame:
    """A row for each window of n tokens: key, at, w (64 bits of it) and the text's tokens.

    A token is hashed once, a window from its tokens' hashes; both stay within the scan's stage.
    """
    t = rows.select(key, lexical_tokens(F.col(text)).alias("tokens"))
    t = t.select(key, "tokens", F.transform("tokens", lambda x: F.xxhash64(x)).alias("h"))
    t = t.select(key, "tokens", "h", F.explode(F.sequence(F.lit(0), F.greatest(F.size("h") - n, F.lit(0)))).alias(at))
    t = t.select(key, "tokens", at, *[F.get("h", F.col(at) + j).alias(f"_{j}") for j in range(n)]).where(f"_{n - 1} is not null")
    return t.select(key, "tokens", at, F.xxhash64(*[f"_{j}" for j in range(n)]).alias("w"))


def containment(left: DataFrame, left_key: str, right: DataFrame, right_key: str, text: str = "text", least: float = 0.8) -> DataFrame:
    """Part of right's sketch that is among left's shingles, where it is `least` or more.

    Left's windows meet the sketch's shingles by 64 bits, in the scan's stage if right is small, and hits are compared
    token by token; only hits are shuffled.
    """
    right = right.select(right_key, text)
    marks = _windows(right, right_key, text, 5, "at").withColumn("shingle", F.slice("tokens", F.col("at") + 1, F.lit(5)))
    marks = marks.select(right_key, "w", "shingle", F.substring(F.sha2(F.concat_ws("\x1f", "shingle"), 256), 1, 16).alias("h")).dropDuplicates([right_key, "h"])
    kept = right.select(right_key, F.explode(sketch(lexical_tokens(F.col(text)))).alias("h"))
    marks = marks.join(kept, [right_key, "h"], "left_semi")
    n = marks.groupBy(right_key).agg(F.count("*").alias("n_sketch"))
    hits = _windows(left, left_key, text, 5, "p").join(small_side(marks, "marks"), "w").where(F.slice("tokens", F.col("p") + 1, F.lit(5)) == F.col("shingle"))
    both = hits.select(left_key, right_key, "h").distinct().groupBy(left_key, right_key).agg(F.count("*").alias("n_shared")).join(small_side(n, "sizes"), right_key)
    return both.withColumn("coverage", F.col("n_shared") / F.col("n_sketch")).where(F.col("coverage") >= least).select(left_key, right_key, "n_shared", "n_sketch", "coverage")


def _shared(left: DataFrame, left_key: str, right: DataFrame, right_key: str, text: str, n: int) -> DataFrame:
    """Places of equal windows: left_key, right_key, left_at, right_at, same (the first place on the right of equal content)."""
    marks = _windows(right, right_key, text, n, "right_at").withColumn("window", F.slice("tokens", F.col("right_at") + 1, F.lit(n)))
    first = F.min("right_at").over(Window.partitionBy(right_key, "window"))
    marks = marks.select(right_key, "right_at", "w", "window", first.alias("same"))
    hits = _windows(left, left_key, text, n, "left_at").join(small_side(marks, "marks"), "w").where(F.slice("tokens", F.col("left_at") + 1, F.lit(n)) == F.col("window"))
    return hits.select(left_key, right_key, F.col("left_at").cast("long").alias("left_at"), F.col("right_at").cast("long").alias("right_at"), F.col("same").cast("long").alias("same"))


def first_shared_window(left: DataFrame, left_key: str, right: DataFrame, right_key: str, text: str = "text", n: int = 12) -> DataFrame:
    """The earliest window of n tokens that both have (by its place on the left, then on the right), and how many different ones."""
    each = _shared(left, left_key, right, right_key, text, n).groupBy(left_key, right_key, "same").agg(F.min("left_at").alias("left_at"))
    best = each.groupBy(left_key, right_key).agg(F.min(F.struct("left_at", "same")).alias("m"), F.count("*").alias("n_windows"))
    return best.select(left_key, right_key, F.col("m.left_at").alias("left_at"), F.col("m.same").alias("right_at"), "n_windows")


def maximal_matches(left: DataFrame, left_key: str, right: DataFrame, right_key: str, text: str = "text", n: int = 30) -> DataFrame:
    """Shared runs of n tokens or more that can't be extended: left_key, right_key, left_at, right_at, n_tokens.

    Equal windows on one diagonal that follow each other are one run; a window function over the hits of a pair and
    diagonal finds where runs begin.
    """
    hits = _shared(left, left_key, right, right_key, text, n).withColumn("diagonal", F.col("left_at") - F.col("right_at"))
    w = Window.partitionBy(left_key, right_key, "diagonal").orderBy("left_at")
    run = hits.withColumn("run", F.col("left_at") - F.row_number().over(w)).groupBy(left_key, right_key, "diagonal", "run")
    return run.agg(F.min("left_at").alias("left_at"), F.min("right_at").alias("right_at"), (F.count("*") + n - 1).alias("n_tokens")).drop("diagonal", "run")


def longest_match(left: DataFrame, left_key: str, right: DataFrame, right_key: str, text: str = "text", n: int = 12) -> DataFrame:
    """The length of the longest run of tokens that a pair shares, if it is n at least: left_key, right_key, n_tokens."""
    return maximal_matches(left, left_key, right, right_key, text, n).groupBy(left_key, right_key).agg(F.max("n_tokens").alias("n_tokens"))


def first_maximal_window(left: DataFrame, left_key: str, right: DataFrame, right_key: str, text: str = "text", n: int = 30) -> DataFrame:
    """The match that begins earliest (on the left, then on the right), extended to its end."""
    runs = maximal_matches(left, left_key, right, right_key, text, n)
    best = runs.groupBy(left_key, right_key).agg(F.min(F.struct("left_at", "right_at", "n_tokens")).alias("m"))
    return best.select(left_key, right_key, "m.left_at", "m.right_at", "m.n_tokens")


def contains_window(tokens: Column, needle: Column) -> Column:
    """Whether needle's tokens stand in a row in tokens."""
    n = F.size(needle)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.slice(tokens, i, n) == needle)
    return (n > 0) & (F.size(tokens) >= n) & (F.size(at) > 0)


def contains_fingerprint(tokens: Column, n: Column, print_: Column, anchor: Column) -> Column:
    """Whether some window of n tokens has the fingerprint; its first five tokens' hash is looked at first."""
    first = lambda i: F.substring(F.sha2(F.concat_ws("\x1f", F.slice(tokens, i, F.least(n, F.lit(5)))), 256), 1, 16)
    hit = lambda i: (first(i) == anchor) & (F.sha2(F.concat_ws("\x1f", F.slice(tokens, i, n)), 256) == print_)
    usable = (n > 0) & (F.size(tokens) >= n) & (F.length(print_) == 64) & (anchor != "")
    return usable & F.exists(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), hit)


def sketch_coverage(tokens_sketch: Column, baseline: Column) -> Column:
    """Part of a baseline sketch that is among a text's shingles; 0 of an empty one."""
    return F.when(F.size(baseline) > 0, F.size(F.array_intersect(tokens_sketch, baseline)) / F.size(baseline)).otherwise(0.0)
