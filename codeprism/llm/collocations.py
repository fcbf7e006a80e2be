"""Phrases that stand together more often than apart: n-gram counts from word suffix arrays of shards, merged by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes_np import U, distinct_slices, gather, mix, string_bytes, words
from .common import materialise, require

#: Text of a shard, whose words get one suffix array (at least one batch of rows).
SHARD_BYTES = 4 << 20
MOST_WORDS = 3
LEAST = 10
#: A phrase goes if a longer one around it has at least so many of a hundred of its occurrences.
COVERED_PERCENT = 50
TOP = 2000
#: Rankings of parts of a language before the ranking of the whole.
RANK_PARTS = 64
#: The filter of frequent phrases has sixteen bits for each, but no more than 2^28 (32 MB).
FILTER_BITS = (16, 28)

# Bytes that end a piece, and those that part its words.
ENDS = b".,;:!?\n\x0b\x0c\r"
GAPS = b" \t"

_breaks = np.zeros(256, bool)
_breaks[list(ENDS)] = True
_inside = ~_breaks
_inside[list(GAPS)] = False
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32


class Shard:
    """The words of some texts in order: a number for each (language, word), the piece of each, and 64 bits that any shard has alike."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        data, at = string_bytes(text)
        self.data = _fold[data]
        self.begin, self.end, self.text = words(self.data, at, _inside)
        tongue = lang.dictionary_encode()
        self.langs = tongue.dictionary.to_pylist()
        self.lang = tongue.indices.to_numpy()[self.text].astype(np.int64)
        broken = np.searchsorted(np.flatnonzero(_breaks[self.data]), self.begin)
        self.same = np.zeros(len(self.begin) + 1, bool)  # as the piece of the word before
        self.same[1:-1] = (broken[1:] == broken[:-1]) & (self.text[1:] == self.text[:-1])
        _, word, h = distinct_slices(self.data, self.begin, self.end)
        self.word = self.lang * len(h) + word
        if len(self.langs) * len(h) >= 1 << 31:  # two numbers must fit 63 bits
            _, self.word = np.unique(self.word, return_inverse=True)
        spoken = pa.array(self.langs, pa.string())
        raw, cut = string_bytes(spoken)
        _, value, seeds = distinct_slices(raw, cut[:-1], cut[1:])
        self.hash = mix(h[word] + seeds[value][self.lang] * U(3)) if len(word) else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.begin)

    def lengths(self, most: int) -> np.ndarray:
        """How many words, `most` at most, stand from each word to its piece's end."""
        out = np.ones(len(self), np.int64)
        for _ in range(most - 1):
            out[:-1] = np.where(self.same[1:-1], np.minimum(out[1:] + 1, most), 1)
        return out

    def gram_hashes(self, k: int) -> np.ndarray:
        """64 bits of the k words from each word on (of no use where the piece ends before)."""
        out = self.hash.copy()
        for j in range(1, k):
            out[: len(out) - j] = mix(out[: len(out) - j] * U(0x9E3779B97F4A7C15) + self.hash[j:])
        return out

    def phrases(self, first: np.ndarray, k: int) -> pa.Array:
        """The k words from each of `first` on, joined by a space."""
        at = (first[:, None] + np.arange(k)).ravel()
        size = self.end[at] - self.begin[at] + 1  # with the byte behind the word, to become a space
        padded = np.append(self.data, np.uint8(32))
        out = gather(padded, self.begin[at], size)
        ends = np.cumsum(size)
        out[ends - 1] = 32
        out = np.delete(out, ends[k - 1 :: k] - 1)
        cut = np.concatenate(([0], ends[k - 1 :: k] - np.arange(1, len(first) + 1)))
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))])


def suffix_order(word: np.ndarray, length: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the places of the words by what follows them in their piece, and how many words each shares with the place before it in that order.

    Prefix doubling: ranks by one word, then by twice as many as before until `most`; behind a piece's end stands rank 0.
    common is `most` at most.
    """
    n = len(word)
    rank = word + 1
    order = np.argsort(rank) if most == 1 else None
    span = 1
    while span < most:
        behind = np.zeros(n, np.int64)
        there = np.flatnonzero(length[: max(n - span, 0)] > span)
        behind[there] = rank[there + span]
        key = rank * (int(rank.max(initial=0)) + 1) + behind
        order = np.argsort(key)
        if span * 2 < most:
            sorted_ = key[order]
            rank[order] = np.cumsum(np.concatenate(([1], sorted_[1:] != sorted_[:-1])))[:n]
        span *= 2
    common = np.zeros(n, np.int64)
    x, y = order[:-1], order[1:]
    alike = np.ones(max(n - 1, 0), bool)
    for j in range(most):
        alike = alike & (length[x] > j) & (length[y] > j)
        at = np.flatnonzero(alike)
        alike[at] = word[x[at] + j] == word[y[at] + j]
        common[1:] += alike
    return order, common


def gram_counts(shard: Shard, least: int, most: int, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, a place of each, its count) of the phrases of `least` to `most` words: the LCP intervals of the suffix array; wanted: only phrases that begin there."""
    length = shard.lengths(most)
    order, common = suffix_order(shard.word, length, most)
    for k in range(least, most + 1):
        # an interval of the order whose suffixes share k words is one phrase
        fresh = common < k
        has = length[order] >= k
        if wanted is not None:
            has &= wanted[order]
        interval = np.cumsum(fresh)
        at = np.flatnonzero(has)
        if len(at):
            head = np.flatnonzero(np.concatenate(([True], interval[at][1:] != interval[at][:-1])))
            yield k, order[at[head]], np.diff(np.append(head, len(at)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows of about SHARD_BYTES of text. A shard is made by who takes them, and gone before the next ones come."""
    kept, size = [], 0
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            kept.append(part)
            size += part.column("text").nbytes
            if size >= SHARD_BYTES:
                yield kept
                kept, size = [], 0
                pa.default_memory_pool().release_unused()
    if kept:
        yield kept


def _shard(kept: list[pa.RecordBatch]) -> Shard:
    t = pa.Table.from_batches(kept)
    return Shard(pa.concat_arrays([x.cast(pa.large_string()) for x in t["text"].chunks]), pa.concat_arrays([x.cast(pa.large_string()) for x in t["lang"].chunks]))


_COUNTS = "lang string, k int, phrase string, n bigint"


def _rows(shard: Shard, k: int, first: np.ndarray, count: np.ndarray, step: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    langs = np.array(shard.langs, object)
    for lo in range(0, len(first), step):
        at = first[lo : lo + step]
        yield pa.RecordBatch.from_arrays([pa.array(langs[shard.lang[at]], pa.string()), pa.array(np.full(len(at), k, np.int32)), shard.phrases(at, k).cast(pa.string()), pa.array(count[lo : lo + step].astype(np.int64))], names=["lang", "k", "phrase", "n"])


def _short_counts(shard: Shard, most: int) -> Iterator[pa.RecordBatch]:
    """All words of each language (k = 0), and the words and pairs."""
    n = len(shard.langs)
    total = np.bincount(shard.lang, minlength=n).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(shard.langs, pa.string()), pa.array(np.zeros(n, np.int32)), pa.array([""] * n, pa.string()), pa.array(total)], names=["lang", "k", "phrase", "n"])
    for k, first, count in gram_counts(shard, 1, min(2, most)):
        yield from _rows(shard, k, first, count)


def _long_counts(shard: Shard, k: int, flags: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """The phrases of k words whose two phrases of one word less the filter knows."""
    if len(shard) == 0:
        return
    h = (shard.gram_hashes(k - 1) >> U(64 - bits)).astype(np.int64)
    known = (flags[h >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1 == 1
    wanted = known.copy()
    wanted[:-1] &= known[1:]
    for _, first, count in gram_counts(shard, k, k, wanted):
        yield from _rows(shard, k, first, count)


def _merged(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def phrase_filter(frequent: DataFrame, k: int, bits: int) -> np.ndarray:
    """Packed bits, set where a frequent phrase of k words has its hash; 64 parts each own one stretch of them."""
    parts = 6

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            shard = Shard(b.column("phrase"), b.column("lang"))
            h = np.unique(shard.gram_hashes(k)[np.flatnonzero(~shard.same[:-1])] >> U(64 - bits))
            cut = np.searchsorted(h, np.arange((1 << parts) + 1, dtype=np.uint64) << U(bits - parts))
            full = np.flatnonzero(cut[1:] > cut[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([h[cut[i] : cut[i + 1]].astype(np.uint32).tobytes() for i in full], pa.binary())], names=["part", "places"])

    def own(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        flags = np.zeros(1 << (bits - parts), bool)
        for x in table["places"].to_pylist():
            flags[np.frombuffer(x, np.uint32).astype(np.int64) - (part << (bits - parts))] = True
        return pa.table({"part": pa.array([part], pa.int32()), "bits": pa.array([zstandard.compress(np.packbits(flags).tobytes(), 1)], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    size = len(out) >> parts
    for r in frequent.mapInArrow(emit, "part int, places binary").groupBy("part").applyInArrow(own, "part int, bits binary").collect():  # 2^bits bits in all
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zstandard.decompress(r["bits"]), np.uint8)
    return out


def frequent_phrases(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, n) of all phrases of 1 to `most` words that stand `least` times or more, (lang, n): all words of each language).

    docs: lang, text, neither null. Words and pairs are counted first. A longer phrase can be frequent only if both
    phrases of one word less in it are: a filter of their hashes goes to the shards, which then count what passes it. The
    filter has no false negatives, and counts are exact, so nothing is lost.
    """
    spark = docs.sparkSession

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept in _runs(batches):
            yield from _short_counts(_shard(kept), most)

    counted = materialise(_merged(docs.select("lang", "text").mapInArrow(short, _COUNTS)).where((F.col("k") == 0) | (F.col("n") >= least)), "phrases-short")
    frequent = counted.where("k > 0")
    low, high = FILTER_BITS
    for k in range(3, most + 1):
        shorter = frequent.where(F.col("k") == k - 1).select("lang", "phrase")
        bits = min(max((shorter.count() * low).bit_length(), 16), high)
        sent = spark.sparkContext.broadcast((phrase_filter(shorter, k - 1, bits), bits))  # 2^28 bits at most, whatever the corpus

        def longer(batches: Iterator[pa.RecordBatch], k: int = k, sent=sent) -> Iterator[pa.RecordBatch]:
            flags, bits = sent.value
            for kept in _runs(batches):
                yield from _long_counts(_shard(kept), k, flags, bits)

        found = _merged(docs.select("lang", "text").mapInArrow(longer, _COUNTS)).where(F.col("n") >= least)
        frequent = frequent.unionByName(materialise(found, f"phrases-{k}"))
    return frequent, counted.where("k = 0").select("lang", "n")


def _span(first: Column, size: Column) -> Column:
    return F.array_join(F.slice("w", first, size), " ")


def mine_phrases(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST, covered: int = COVERED_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `most` words.

    Texts are cut at ENDS into pieces and at GAPS into words, A-Z in lower case. A phrase that stands a times, cut into two
    parts that stand l and r times, scores 10^6 a a / (l r), rounded down, at its lowest-scoring cut (of equal ones, the
    first). A phrase goes if a frequent longer one around it has `covered` percent of its occurrences or more. Ties rank by
    a, then by the phrase's bytes. A null lang is `und`, a null text empty; repeated rows count each; a language without
    frequent phrases, or no rows, gives none. Other columns, whatever their names, are left out. Numbers are exact below
    10^15 occurrences.
    """
    require(docs, ["lang", "text"])
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    frequent, totals = frequent_phrases(texts, most, least)
    parts = frequent.select("lang", "phrase", "n")
    phrases = frequent.where("k > 1").withColumn("w", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _span(F.lit(1), F.col("cut")).alias("left"), _span(F.col("cut") + 1, F.size("w")).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    exact = lambda x: f"CAST({x} AS DECIMAL(15, 0))"
    cuts = cuts.withColumn("score", F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})"))
    best = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "cut")).alias("b")).select("lang", "phrase", "b.*")
    if most > 2:
        inner = phrases.where("k > 2").select("lang", F.col("n").alias("outer"), "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
        inner = inner.select("lang", "outer", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("first"))
        inner = inner.groupBy("lang", _span(F.col("first"), F.col("size")).alias("phrase")).agg(F.max("outer").alias("outer"))
        best = best.join(inner, ["lang", "phrase"], "left").where((F.col("outer").isNull()) | (F.lit(100) * F.col("outer") < F.lit(covered) * F.col("a"))).drop("outer")
    by = "score DESC, a DESC, phrase"
    # a language may hold most phrases: the first of each of its parts, then the first of all
    best = best.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, pmod(xxhash64(phrase), {RANK_PARTS}) ORDER BY {by})")).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY lang ORDER BY {by}) AS BIGINT)")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
