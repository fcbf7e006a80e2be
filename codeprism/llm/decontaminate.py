"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise, require

#: A seed looks at the tokens under 1 and ignores those under 0.
MASKS = ("1111", "10111")
#: What items of so many tokens need besides, so that every admissible match meets a seed; laid on documents only if there are such items.
SHORT_MASKS = {1: ("1",), 2: ("11",), 3: ("111",), 5: ("11011", "11101"), 6: ("11101",)}
#: A window of so many tokens (the whole item, if shorter) is compared; this part of it must be equal.
WINDOW = 20
SIMILARITY = 0.8


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; junk and punctuation around words don't count. Null: none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def _seeded(df: DataFrame, h: str, at: str, keep: Sequence[str], masks: Sequence[str]) -> DataFrame:
    """A row for each position of h and each mask laid on the tokens from there: keep, h, at, seed.

    Position 0 of an empty text has no seed; a filter on h would hash each text twice.
    """
    rows = df.select(*keep, h, F.explode(F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)))).alias(at))
    # columns first: small methods, that the JVM compiles
    rows = rows.select(*keep, h, at, *[F.get(h, F.col(at) + j).alias(f"_{j}") for j in range(max(map(len, masks)))])
    # a seed is told apart by its mask's form
    seeds = [F.when(F.col(f"_{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(m), *[F.col(f"_{j}") for j, c in enumerate(m) if c == "1"])) for m in masks]
    return rows.select(*keep, h, at, F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _item_seeds(items: DataFrame, masks: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Seeds of the items (item_id, b, q, seed) and the masks that documents need for them."""
    sizes = {r["n"] for r in items.select(F.size("b").alias("n")).where(F.col("n").isin(*SHORT_MASKS)).distinct().collect()}  # six at most
    out = _seeded(items, "b", "q", ["item_id"], masks)
    for n in sorted(sizes):
        more = [m for m in SHORT_MASKS[n] if m not in masks]
        if more:
            out = out.union(_seeded(items.where(F.size("b") == n), "b", "q", ["item_id"], more))
    return out, list(dict.fromkeys([*masks, *(m for n in sorted(sizes) for m in SHORT_MASKS[n])]))


def find_overlaps(docs: DataFrame, bench: DataFrame, masks: Sequence[str] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY, shuffled: bool = False) -> DataFrame:
    """Pairs of document and item that overlap: doc_id, item_id, n_item, window, matched, similarity.

    Seeds of each document position meet the items' seeds; a hit fixes how item and text lie to each other. There the
    tokens are compared one by one: the pair counts if, in some window of min(window, n_item) item tokens, at least
    `similarity` of them are equal; substitutions fail only themselves. `matched` is the best window's count.
    With the default window and similarity no admissible match is missed: masks MASKS meet every window of 4 tokens or
    of 7 and more, SHORT_MASKS the other sizes (tests/llm tries all ways to substitute).
    Items whose seeds are small (in rows and bytes) are broadcast, and the text is hashed and probed within one stage.
    Else, or with `shuffled`, seeds of both sides are shuffled, without texts, and the tokens of hits are fetched by key
    afterwards. Null or empty texts overlap with nothing; rows that share doc_id count as one document, items that share
    item_id as one item with the best of their texts; other columns are not read; an empty table gives an empty one.
    """
    require(docs, ["doc_id", "text"])
    require(bench, ["item_id", "text"])
    items = materialise(bench.select("item_id", _hashes(F.col("text")).alias("b")), "overlap-items")
    seeds, laid = _item_seeds(items, masks)
    texts = docs.select("doc_id", _hashes(F.col("text")).alias("h"))
    d = F.col("p") - F.col("q")
    # of the text only what lies beside the item goes on: a row of the join must not carry a whole text
    part = F.slice("h", F.greatest(d, F.lit(0)) + 1, F.size("b") - F.greatest(-d, F.lit(0)))
    side = bounded(seeds, "overlap-seeds", rows=0 if shuffled else 200_000)
    if shuffled or not _is_broadcast(side):
        texts = texts.withColumn("v", F.xxhash64("h"))
        narrow = _seeded(texts, "h", "p", ["doc_id", "v"], laid).select("doc_id", "v", "p", "seed")
        light = side.withColumn("w", F.xxhash64("b")).select("item_id", "w", "q", "seed")
        places = narrow.join(light, "seed").select("doc_id", "v", "item_id", "w", d.alias("d")).distinct()
        places = places.join(items.withColumn("w", F.xxhash64("b")).distinct(), ["item_id", "w"])
        hits = places.join(texts.distinct(), places["doc_id"].eqNullSafe(texts["doc_id"]) & (places["v"] == texts["v"])).drop(texts["doc_id"]).drop(texts["v"])
        part = F.slice("h", F.greatest(F.col("d"), F.lit(0)) + 1, F.size("b") - F.greatest(-F.col("d"), F.lit(0)))
        places = hits.select("doc_id", "item_id", "b", "d", part.alias("part"))
    else:
        at = _seeded(texts, "h", "p", ["doc_id"], laid)
        hits = at.join(side, "seed").select("doc_id", "item_id", "b", d.alias("d"), part.alias("part"))
        # many hits, one place; merged in the task that made them. Texts that share an id stay apart
        places = hits.groupBy("doc_id", "item_id", "d", F.xxhash64("part", "b").alias("_v")).agg(F.first("part").alias("part"), F.first("b").alias("b"))
    skip = F.greatest(-F.col("d"), F.lit(0))
    equal = F.filter(F.sequence(skip, skip + F.size("part") - 1), lambda i: F.get(F.col("part"), i - skip) == F.get(F.col("b"), i))
    w = F.least(F.col("n_item"), F.lit(window))
    need = F.ceil(w * F.lit(similarity))
    pairs = places.select("doc_id", "item_id", F.size("b").alias("n_item"), equal.alias("eq")).where(F.size("eq") >= need)
    # of the equal places in order, a window's are among the next `window` ones
    best = F.array_max(F.transform("eq", lambda s, i: F.size(F.filter(F.slice(F.col("eq"), i + 1, F.lit(window)), lambda x: x < s + w))))
    pairs = pairs.select("doc_id", "item_id", "n_item", w.alias("window"), best.alias("matched")).where(F.col("matched") >= need)
    out = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("matched") / F.col("window")).alias("similarity"), "matched", "window", "n_item")).alias("m"))
    return out.select("doc_id", "item_id", F.col("m.n_item").cast("long").alias("n_item"), F.col("m.window").cast("long").alias("window"), F.col("m.matched").cast("long").alias("matched"), F.col("m.similarity").alias("similarity"))


def _is_broadcast(df: DataFrame) -> bool:
    return "hint" in df._jdf.queryExecution().logical().toString().lower()


def decontaminate(docs: DataFrame, bench: DataFrame, masks: Sequence[str] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the documents that overlap with an item, its columns as they are, whatever their names.

    Rows of null doc_id stay if the rows of null doc_id overlap with nothing.
    """
    found = find_overlaps(docs, bench, masks, window, similarity).select(F.col("doc_id").alias("hit")).distinct()
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("row"))
    return rows.join(bounded(found, "overlap-hits"), F.col("doc_id").eqNullSafe(F.col("hit")), "left_anti").select("row.*")
