"""Repeated passages: suffix order by the difference-cover algorithm, in content-routed parts of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes_np import BYTE, U, mix, pieces, string_bytes
from .common import BROADCAST_ROWS, materialise, require, utf8

LENGTH = 50
#: Bytes of the grams that route windows; of a window's grams, the one with the smallest hash is its route.
GRAM = 30
#: Size of the filter of routes that several texts have: 2^28 bits are 32 MB, whatever the corpus.
FILTER_BITS = 28
#: Text whose routes make a part: a part's contexts are a fraction of it.
PART_BYTES = 4 << 20
#: Text hashed at a time, so that the arrays stay in a core's cache.
PIECE = 1 << 16
#: Bytes of contexts whose suffixes are put in order together.
BLOCK = 1 << 18
NULL_ID = 2**63 - 1


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """The order of all suffixes of s by their first 3^(depth + 1) symbols; further symbols may stay undecided.

    Difference cover modulo 3: suffixes at places 1 and 2 (mod 3) are named by their triples' ranks; names that repeat
    are resolved by the same algorithm on the string of names; the suffixes at places 0 (mod 3) are sorted by their
    first symbol and the rank behind it, and both are merged, by two symbols at most and the rank behind them.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    x = np.concatenate((s.astype(np.int64), np.zeros(3, np.int64)))
    top = int(x.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    order, names = _rank(x[sample], x[sample + 1], x[sample + 2], top)
    if depth > 0 and names.max() + 1 < len(names):
        order = suffix_order(names + 1, depth - 1)
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(len(sample))
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names + 1
    zero = np.arange(0, n, 3)
    wide = len(sample) + 2
    # places 0 among themselves and against places 1: one symbol, then the rank behind
    key = lambda i: x[i] * wide + rank[i + 1]
    k0 = key(zero)
    zero = zero[np.argsort(k0)]
    k0 = key(zero)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    s1, s2 = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    k1 = key(s1)
    # against places 2: two symbols, then the rank behind; equal parts are named first, so that the keys fit 64 bits
    z_pair, s_pair = x[zero] * top + x[zero + 1], x[s2] * top + x[s2 + 1]
    _, named = np.unique(np.concatenate((z_pair, s_pair)), return_inverse=True)
    z2, k2 = named[: len(zero)] * wide + rank[zero + 2], named[len(zero) :] * wide + rank[s2 + 2]
    place = np.empty(n, np.int64)
    place[zero] = np.arange(len(zero)) + np.searchsorted(k1, k0, "left") + np.searchsorted(k2, z2, "left")
    at = np.arange(len(sorted_sample))
    below = np.empty(len(sorted_sample), np.int64)
    first = sorted_sample % 3 == 1
    below[first] = np.searchsorted(k0, k1, "right")
    below[~first] = np.searchsorted(z2, k2, "right")
    place[sorted_sample] = at + below
    return np.argsort(place, kind="stable")


def _rank(a: np.ndarray, b: np.ndarray, c: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and dense ranks of triples."""
    if top < 1 << 21:
        key = (a << 42) | (b << 21) | c
        order = np.argsort(key)
        k = key[order]
        fresh = k[1:] != k[:-1]
    else:
        order = np.lexsort((c, b, a))
        fresh = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (c[order][1:] != c[order][:-1])
    names = np.empty(len(order), np.int64)
    names[order] = np.concatenate(([0], np.cumsum(fresh)))
    return order, names


_BASE = U(0x9E3779B97F4A7C15)
_BACK = U(pow(int(_BASE), -1, 1 << 64))
_cache: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """Powers 0 to n of an odd number modulo 2^64, or of its inverse."""
    had = _cache.get(int(base))
    if had is None or len(had) <= n:
        had = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64))))
        _cache[int(base)] = had
    return had[: n + 1]


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of the k bytes from each place on, by doubling; mixed at the end."""
    if len(b) < k:
        return np.zeros(0, np.uint64)
    out, size, have, width = None, 0, BYTE[b], 1
    while True:
        if k & width:
            if out is None:
                out, size = have, width
            else:
                m = len(b) - size - width + 1
                out = out[:m] * U(pow(int(_BASE), width, 1 << 64)) + have[size : size + m]
                size += width
        if width * 2 > k:
            return mix(out)
        m = len(b) - 2 * width + 1
        have = have[:m] * U(pow(int(_BASE), width, 1 << 64)) + have[width : width + m]
        width *= 2


def _smallest(h: np.ndarray, w: int) -> np.ndarray:
    width = 1
    out = h
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = w - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def route_runs(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows of `length` bytes that have one route, within each text: text, start, windows, route.

    A window's route is the smallest hash of its grams, so equal windows have equal routes. It is mixed once more: minima
    crowd at the low end, and parts and filter go by the top bits.
    """
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    m = _smallest(gram_hashes(data, gram), length - gram + 1)
    fresh = np.concatenate(([True], m[1:] != m[:-1]))
    edge = np.concatenate((at[:-1], at[1:] - length + 1))
    fresh[edge[(edge >= 0) & (edge < len(m))]] = True
    start = np.flatnonzero(fresh)
    count = np.diff(np.concatenate((start, [len(m)])))
    text = np.searchsorted(at, start, side="right") - 1
    whole = start + length <= at[text + 1]
    return text[whole], start[whole], count[whole], mix(m[start[whole]] ^ U(0x6A09E667F3BCC909))


def _prefix(data: np.ndarray) -> np.ndarray:
    """Running sums from which _content reads the hash of any stretch."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[data] * _powers(len(data), _BASE)[:-1], dtype=np.uint64)))


def _content(sums: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix((sums[begin + size] - sums[begin]) * _powers(len(sums), _BACK)[begin] + size.astype(np.uint64))


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of data, one after the other."""
    first = np.cumsum(size) - size
    return data[np.arange(int(size.sum())) + np.repeat(begin - first, size)]


def _distinct(data: np.ndarray, route: np.ndarray, h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of contexts by route and content, and whether each is the first of its kind; equal ones agree byte by byte."""
    order = np.lexsort((h, route))
    r, y = route[order], h[order]
    first = np.concatenate((np.ones(min(len(r), 1), bool), (r[1:] != r[:-1]) | (y[1:] != y[:-1])))
    late = np.flatnonzero(~first)
    for lo in range(0, len(late), 1 << 14):
        x, w = order[late[lo : lo + (1 << 14)] - 1], order[late[lo : lo + (1 << 14)]]
        if (size[x] != size[w]).any() or (_gather(data, begin[x], size[x]) != _gather(data, begin[w], size[w])).any():
            raise RuntimeError("two different contexts have one route and one hash of 64 bits")
    return order, first


def _parts(texts: int) -> int:
    """Bits of the number of parts: each gets the routes of about PART_BYTES of text."""
    return min(max((texts // PART_BYTES).bit_length(), 6), 16)


def _route_filter(texts: DataFrame, length: int, bits: int) -> np.ndarray:
    """Packed bits of the routes that at least two texts have, by their hash's top FILTER_BITS bits.

    Each batch's distinct routes (twice those that several of its texts have) go to 2^bits parts by their top bits; a
    part finds those that come twice and owns one stretch of the bits. Wrong hits of the filter only add work; it has
    none of the other kind.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, texts_of = [], []
            for lo, hi, d, a in pieces(*string_bytes(b.column("text")), PIECE):
                text, _, _, m = route_runs(d, a, length)
                got.append(m)
                texts_of.append(text + lo)
            m, text = np.concatenate(got), np.concatenate(texts_of).astype(np.int32)
            if len(m) == 0:
                continue
            order = np.argsort(m)
            m, text = m[order], text[order]
            first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
            several = np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first)
            m = np.repeat(m[first], 1 + several)
            cut = np.searchsorted(m >> U(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
            full = np.flatnonzero(cut[1:] > cut[:-1])
            # the part is the top bits; 32 more are enough for a filter
            short = (m >> U(32 - bits)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([short[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary())], names=["part", "routes"])

    def find(table: pa.Table) -> pa.Table:
        m = np.sort(np.frombuffer(b"".join(table["routes"].to_pylist()), np.uint32))
        twice = m[1:][m[1:] == m[:-1]]
        own = np.zeros(1 << (FILTER_BITS - bits), bool)
        own[(twice >> np.uint32(32 + bits - FILTER_BITS)).astype(np.int64)] = True
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "bits": pa.array([zstandard.compress(np.packbits(own).tobytes(), 1)], pa.binary())})

    parts = texts.mapInArrow(emit, "part int, routes binary").groupBy("part").applyInArrow(find, "part int, bits binary")
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = len(out) >> bits
    for r in parts.collect():  # 2^FILTER_BITS bits in all, whatever the corpus
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zstandard.decompress(r["bits"]), np.uint8)
    return out


def _contexts(d: np.ndarray, a: np.ndarray, bits: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one route that the filter knows: text, start, windows, the route's top 32 bits, hash of the bytes."""
    text, start, count, m = route_runs(d, a, length)
    k = (m >> U(64 - FILTER_BITS)).astype(np.int64)
    hit = (bits[k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1 == 1
    text, start, count, m = text[hit], start[hit], count[hit], m[hit]
    h = _content(_prefix(d), start, count + length - 1) if len(start) else np.zeros(0, np.uint64)
    return text, start, count, (m >> U(32)).astype(np.uint32), h


def covered_windows(data: np.ndarray, size: np.ndarray, owners: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Strings, one after the other in data: (string, place) of their windows that some string of a smaller owner has too, in order."""
    # byte values from 1; 0 parts the strings
    begin = np.cumsum(size + 1) - size - 1
    of = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(len(of)) - begin[of]
    s = np.zeros(len(of), np.int64)
    s[place < size[of]] = data.astype(np.int64) + 1
    depth = 0
    while 3 ** (depth + 1) < length + 2:
        depth += 1
    order = suffix_order(s, depth)
    order = order[(place + length <= size[of])[order]]
    if len(order) == 0:
        return order, order
    # neighbours with equal first `length` bytes
    raw = np.concatenate(((s - 1).clip(0).astype(np.uint8), np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)
    same = np.ones(len(order) - 1, bool)
    for lo in [*range(0, length - 8, 8), max(length - 8, 0)]:
        left = np.flatnonzero(same)
        x, y = words[order[left] + lo], words[order[left + 1] + lo]
        w = min(8, length)
        same[left] = (x[:, :w] == y[:, :w]).all(1) if w < 8 else x.view(np.uint64).ravel() == y.view(np.uint64).ravel()
    group = np.concatenate(([0], np.cumsum(~same)))
    own = owners[of[order]]
    least = np.minimum.reduceat(own, np.flatnonzero(np.concatenate(([True], ~same))))
    late = np.sort(order[own > least[group]])
    return of[late], place[late]


def repeated_passages(texts: DataFrame, n_bytes: int, length: int = LENGTH) -> DataFrame:
    """(id, version, start, windows): runs of windows of `length` bytes that also stand in a text of a smaller id.

    texts: id, version (tells texts of one id apart), text, of n_bytes in all; equal texts of larger ids left out before.
    Windows whose route no other text has are unique, and dropped. The others are cut into contexts, runs of one route.
    Distinct contexts of each batch go to the part of their route: equal windows meet there, a passage of any number of
    texts comes once from each batch. The part puts all suffixes of its distinct contexts in order (suffix_order) and
    compares neighbours. A context's smallest owner learns which of its windows smaller ids have; all others lose all.
    """
    parts = _parts(n_bytes)
    bits = texts.sparkSession.sparkContext.broadcast(_route_filter(texts, length, parts))  # of fixed size

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = string_bytes(b.column("text"))
            ids = b.column("id").to_numpy()
            found = []
            for lo, hi, d, a in pieces(data, at, PIECE):
                text, start, count, m, h = _contexts(d, a, bits.value, length)
                found.append((ids[lo + text], start + at[lo], (count + length - 1).astype(np.int32), m, h))
            own, start, size, m, h = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
            if len(m) == 0:
                continue
            order, first = _distinct(data, m, h, start, size)
            group = np.flatnonzero(first)
            low, high = np.minimum.reduceat(own[order], group), np.maximum.reduceat(own[order], group)
            keep = order[group]
            m, start, size = m[keep], start[keep], size[keep]
            cut = np.searchsorted(m >> np.uint32(32 - parts), np.arange((1 << parts) + 1))
            full = np.flatnonzero(cut[1:] > cut[:-1])
            rows = []
            for i in full:
                part = slice(cut[i], cut[i + 1])
                # columns one after the other, those that change little as differences
                head = (np.diff(m[part], prepend=np.uint32(0)), size[part], (low[part] != high[part]), low[part])
                rows.append(zstandard.compress(b"".join(x.tobytes() for x in head) + _gather(data, start[part], size[part]).tobytes(), 3))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(cut[full + 1] - cut[full], pa.int32()), pa.array(rows, pa.binary())], names=["part", "n", "contexts"])

    def order(table: pa.Table) -> pa.Table:
        got = []
        for n, raw in zip(table["n"].to_pylist(), table["contexts"].to_pylist()):
            raw = zstandard.decompress(raw)
            got.append((np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.uint32), np.frombuffer(raw, np.int32, n, 4 * n), np.frombuffer(raw, bool, n, 8 * n), np.frombuffer(raw, np.int64, n, 9 * n), np.frombuffer(raw, np.uint8, -1, 17 * n)))
        m, size, several, own, data = (np.concatenate(x) for x in zip(*got))
        size = size.astype(np.int64)
        start = np.cumsum(size) - size
        h = np.zeros(len(m), np.uint64)
        for lo, hi, d, a in pieces(data, np.concatenate((start, [len(data)])), PIECE):
            h[lo:hi] = _content(_prefix(d), a[:-1], np.diff(a))
        by, first = _distinct(data, m, h, start, size)
        group = np.flatnonzero(first)
        low, high = np.minimum.reduceat(own[by], group), np.maximum.reduceat(own[by], group)
        several = np.logical_or.reduceat(several[by], group) | (low != high)
        keep = by[group]
        m, h, start, size = m[keep], h[keep], start[keep], size[keep]
        # routes of several contexts, whole ones, about BLOCK bytes at a time
        fresh = np.concatenate(([True], m[1:] != m[:-1]))
        number = np.cumsum(fresh) - 1
        some = np.flatnonzero(np.bincount(number)[number] > 1)
        runs_of, runs_at, runs_n = [], [], []
        ends = np.cumsum(size[some])
        lo = 0
        while lo < len(some):
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK)) + 1
            hi = int(np.searchsorted(number[some], number[some[min(hi, len(some)) - 1]], side="right"))
            part = some[lo:hi]
            string, place = covered_windows(_gather(data, start[part], size[part]), size[part], low[part], length)
            if len(string):
                begins = np.flatnonzero(np.concatenate(([True], (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1))))
                runs_of.append(part[string[begins]])
                runs_at.append(place[begins])
                runs_n.append(np.diff(np.concatenate((begins, [len(string)]))))
            lo = hi
        of, off, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (runs_of, runs_at, runs_n))
        many = np.bincount(of, minlength=len(m))
        # contexts that nobody loses anything of are not told
        told = several | (many > 0)
        struct = pa.StructArray.from_arrays([pa.array(off.astype(np.int32)), pa.array(n.astype(np.int32))], names=["off", "n"])
        again = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many[told]))).astype(np.int32)), struct)
        return pa.table({"route": pa.array(m[told].view(np.int32)), "h": pa.array(h[told].view(np.int64)), "owner": pa.array(low[told]), "again": again})

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, version = b.column("id").to_numpy(), b.column("version").to_numpy()
            found = []
            for lo, hi, d, a in pieces(*string_bytes(b.column("text")), PIECE):
                text, start, count, m, h = _contexts(d, a, bits.value, length)
                found.append((ids[lo + text], version[lo + text], ((start - a[text]) << 32) | count, m.view(np.int32), h.view(np.int64)))
            if sum(len(x[0]) for x in found):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["id", "version", "place", "route", "h"])

    known = texts.select("id", "text").mapInArrow(unique, "part int, n int, contexts binary").groupBy("part").applyInArrow(order, "route int, h long, owner long, again array<struct<off:int,n:int>>")
    at = texts.mapInArrow(places, "id long, version long, place long, route int, h long")
    both = at.join(known, ["route", "h"]).withColumns({"start": F.shiftright("place", 32).cast("int"), "windows": F.col("place").bitwiseAND(0xFFFFFFFF).cast("int")})
    lost = F.when(F.col("id") > F.col("owner"), F.array(F.struct(F.lit(0).alias("off"), F.col("windows").alias("n")))).otherwise(F.col("again"))
    return both.where(F.size(lost) > 0).select("id", "version", "start", F.explode(lost).alias("r")).select("id", "version", (F.col("start") + F.col("r.off")).alias("start"), F.col("r.n").alias("windows"))


def remove_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    Each byte within a string of `length` bytes that also starts in a document of a smaller doc_id is removed, as judged
    on the input. Equal texts first: all but those of the smallest doc_id lose everything (if they have `length` bytes),
    and take no further part. Matches never cross documents.
    Null texts are empty and keep nothing. Texts shorter than `length` stay. Null doc_ids come after all others; rows
    of one doc_id take nothing from each other. Other columns are not read. An empty table gives an empty result.
    """
    require(docs, ["doc_id", "text"])
    texts = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), utf8("text").alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    narrow = materialise(texts.select("id", "digest", F.length("text").cast("long").alias("n")), "suffix-digests")
    total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    copies = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("digest", "first")
    copies = materialise(copies, "suffix-copies")
    small = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # versions tell texts of one id apart; where no id repeats, a constant does
    repeats = not narrow.groupBy("id").count().where("count > 1").isEmpty()
    marked = texts.join(F.broadcast(copies) if small else copies, "digest", "left").withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    marked = marked.select("doc_id", "id", (F.xxhash64("text") if repeats else F.lit(0).cast("long")).alias("version"), "text", "copy")
    if not small:
        marked = materialise(marked, "suffix-texts")
    lost = repeated_passages(marked.where("not copy").select("id", "version", "text"), total, length)
    # runs of windows to spans of bytes, in one fold over each text's sorted runs
    runs = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("windows") + length - 1).alias("end"))))
    lost = lost.groupBy("id", "version").agg(runs.alias("runs"))
    nothing = F.array().cast("array<struct<start:int,end:int>>")

    def fold(acc: Column, r: Column) -> Column:
        meets = r["start"] <= acc["last"]["end"]
        return F.struct(F.when(meets, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))).alias("done"), F.when(meets, F.struct(acc["last"]["start"].alias("start"), F.greatest(acc["last"]["end"], r["end"]).alias("end"))).otherwise(r).alias("last"))

    first = F.struct(nothing.alias("done"), F.element_at("runs", 1).alias("last"))
    spans = F.aggregate("runs", first, fold, lambda acc: F.concat(acc["done"], F.array(acc["last"])))
    lost = materialise(lost.select("id", "version", spans.alias("spans")), "suffix-lost")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for text, copy, found in zip(b.column("text").to_pylist(), b.column("copy").to_pylist(), b.column("spans").to_pylist()):
                n = len(text)
                spans = [(0, n)] if copy and n >= length else [(r["start"], r["end"]) for r in found or []]
                left, at = [], 0
                for a, z in spans:
                    left.append(text[at:a])
                    at = z
                left.append(text[at:])
                out["n_bytes"].append(n)
                out["n_removed"].append(sum(z - a for a, z in spans))
                out["n_spans"].append(len(spans))
                out["kept"].append(b"".join(left))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = marked.join(lost, ["id", "version"], "left").select("doc_id", "text", "copy", "spans")
    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
