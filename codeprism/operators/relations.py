"""Joins, set differences, closures, intervals and islands."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.batches import spread
from ..storage import settled, small_side


def manifest_delta(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key and status: added, changed, deleted or equal."""
    b, a = before.select(key, F.col(digest).alias("_b")), after.select(key, F.col(digest).alias("_a"))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted").when(F.col("_a") == F.col("_b"), "equal").otherwise("changed")
    return b.join(a, key, "full_outer").select(key, status.alias("status"))


def unreferenced(entities: DataFrame, key: str, references: DataFrame, by: str) -> DataFrame:
    return entities.join(references.select(F.col(by).alias("_r")), F.col(key) == F.col("_r"), "left_anti")


def additions(before: DataFrame, after: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows whose fields are present after only; rows with all fields blank don't count."""
    some = F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in fields]).isNotNull()
    return after.where(some).join(before.select(*fields).distinct(), list(fields), "left_anti")


def multiset_additions(before: DataFrame, after: DataFrame, fields: Sequence[str]) -> DataFrame:
    """fields and how many more rows of them there are after than before; counted, not listed row by row."""
    b = before.groupBy(*fields).agg(F.count("*").alias("_b"))
    a = after.groupBy(*fields).agg(F.count("*").alias("_a"))
    more = F.col("_a") - F.coalesce("_b", F.lit(0))
    return a.join(b, list(fields), "left").where(more > 0).select(*fields, more.alias("n_added"))


def ancestor_closure(edges: DataFrame, hops: int = 8, strict: bool = True) -> DataFrame:
    """child, ancestor and the least number of hops; each hop is an equi-join on the parent.

    With `strict`, chains of more than `hops` hops are an error, not cut off; a cycle ends where it closes. The reach
    doubles in each round (paths of up to 2, 4, 8 ... hops), and each round is a table, so no round computes earlier ones.
    """
    reach = settled(edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth")).where("child is not null and ancestor is not null").distinct(), "reach")
    span, longest = 1, 1
    while longest == span and span <= hops:
        upper = reach.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_top"), F.col("depth").alias("_more"))
        further = reach.join(upper, "ancestor").where("child <> _top").select("child", F.col("_top").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth"))
        reach = settled(reach.unionByName(further).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")), "reach")
        span *= 2
        longest = reach.agg(F.max("depth")).head()[0] or 0
    if strict and longest > hops:
        raise ValueError(f"a chain has more than {hops} hops")
    return reach.where(F.col("depth") <= hops)


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether closed intervals meet."""
    return (a0 <= b1) & (b0 <= a1)


def smallest_containing(points: DataFrame, spans: DataFrame, on: str, at: str, begin: str, end: str, point_key: Sequence[str], span_key: str) -> DataFrame:
    """For each point the shortest span of its key that contains it; ties: the earlier begin, then the smaller key."""
    length = F.col(end) - F.col(begin)
    both = points.join(spans, on).where(F.col(at).between(F.col(begin), F.col(end)))
    return both.groupBy(*point_key).agg(F.min(F.struct(length.alias("length"), F.col(begin).alias("b"), F.col(span_key).alias("k")))["k"].alias(span_key))


def as_of(rows: DataFrame, by: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """rows with the last earlier non-null value in their key's order: an as-of join with itself in one sort."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def islands(rows: DataFrame, by: str, order: Sequence[str], value: str) -> DataFrame:
    """Maximal runs of equal values in each key's order: by, run number, value, n_rows."""
    w = Window.partitionBy(by).orderBy(*order)
    fresh = F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True)).cast("int")
    return rows.withColumn("_f", fresh).withColumn("run", F.sum("_f").over(w)).groupBy(by, "run", value).agg(F.count("*").alias("n_rows"))


def frequent_groups(items: DataFrame, transaction: str, item: str, owner: str, k: int, support: int, owners: int, name: str | None = None, names: int = 1) -> DataFrame:
    """Item sets of 2 to k items: k, members, n_transactions, n_owners, with at least so many of each (and of different names).

    Level by level: a set is formed only of a frequent set and a further frequent item whose pair with the set's last
    item is frequent too, so a transaction of many rare items makes no sets of them.
    """
    keep = [transaction, owner, *([name] if name else [])]
    base = items.select(*keep, item).distinct()
    often = base.groupBy(item).agg(F.countDistinct(transaction).alias("_n")).where(F.col("_n") >= support).select(item)
    base = base.join(often, item, "left_semi")
    one = base.select(F.col(transaction).alias("_t"), F.col(item).alias("_i"))
    sets = base.select(*keep, F.array(item).alias("members"), F.col(item).alias("_last"))
    out = pairs = None
    for level in range(2, k + 1):
        grown = sets.join(one, (F.col(transaction) == F.col("_t")) & (F.col("_i") > F.col("_last")))
        if pairs is not None:
            grown = grown.join(pairs, (F.col("_last") == F.col("_a")) & (F.col("_i") == F.col("_b")), "left_semi")
        sets = grown.select(*keep, F.concat("members", F.array("_i")).alias("members"), F.col("_i").alias("_last"))
        n = [F.countDistinct(transaction).alias("n_transactions"), F.countDistinct(owner).alias("n_owners"), *([F.countDistinct(name).alias("n_names")] if name else [])]
        counted = sets.groupBy("members").agg(*n)
        frequent = counted.where(F.col("n_transactions") >= support)
        if level == 2:
            pairs = frequent.select(F.get("members", 0).alias("_a"), F.get("members", 1).alias("_b"))
        if level < k:
            sets = sets.join(frequent.select("members"), "members", "left_semi")
        found = frequent.where(F.col("n_owners") >= owners)
        if name:
            found = found.where(F.col("n_names") >= names)
        found = found.select(F.lit(level).cast("long").alias("k"), F.array_join("members", "|").alias("members"), *[c for c in counted.columns if c != "members"])
        out = found if out is None else out.unionByName(found)
    return out


def by_value(rows: DataFrame, keys: dict[str, Column], columns: Callable[[], dict[str, Column]]) -> DataFrame:
    """rows with their keys, and with columns that the keys alone tell: dear ones are made once for each distinct value, over many tasks, and joined.

    columns: made over the names of the keys. Null keys are values too.
    """
    rows = rows.withColumns(keys)
    known = spread(rows.select(*keys).distinct()).select(*[F.col(k).alias(f"_{k}") for k in keys], *[c.alias(n) for n, c in columns().items()])
    known = small_side(known, "values")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(known, reduce(and_, same)).drop(*[f"_{k}" for k in keys])
