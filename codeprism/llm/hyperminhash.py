"""Near-duplicates: HyperMinHash registers, banded; collision-corrected estimates; exact verification; components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import NOT_SPACE, U, mix, pieces, shingles, string_bytes, word_hashes, words
from .common import bounded, discard, materialise, require, stored
from .graph import components

BUCKETS = 256
MANTISSA = 10
#: Rows per band are the most with which a pair of long sets at the threshold misses all bands with at most so much.
MISS = 1e-8
#: Sets of up to so many shingles have too few full buckets for bands: they meet by prefixes, which miss no pair.
SHORT = 256
#: Shingles of so many documents in a sample of about SAMPLE documents come last in prefixes, so that few sets meet there.
COMMON = 20
SAMPLE = 20_000
EMPTY = np.uint16(0xFFFF)
PERCENT = 85
#: Documents, or pairs of sketches, that a Python worker has arrays of at a time.
ROWS = 1024
#: Members of a bucket, and shingles of theirs, in a block; two blocks are compared in one task.
BLOCK = 2000
BLOCK_SHINGLES = 4 << 20
_ORDER = np.random.Generator(np.random.PCG64(11)).permutation(BUCKETS)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The sketch of each set of sorted 64-bit hashes: for each of 256 buckets, its smallest value's leading zeros and mantissa.

    The top 8 bits choose the bucket; of the smallest remainder a register keeps the number of leading zeros (6 bits)
    and the 10 bits after the first one.
    """
    out = np.full((len(sets), BUCKETS), EMPTY, np.uint16)
    shift = U(56)
    for i, s in enumerate(sets):
        if len(s) == 0:
            continue
        bucket = (s >> shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rest = (s[first] & U((1 << 56) - 1)).astype(np.float64)
        part, size = np.frexp(rest)
        mantissa = np.where(rest > 0, (part - 0.5) * 2 * (1 << MANTISSA), 0).astype(np.uint16)
        out[i, bucket[first]] = ((56 - size).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa
    return out


def band_rows(percent: int) -> int:
    """Registers per band: 6 at 85 percent (42 bands, a miss of 2e-9), 5 at 80 (51 bands, 2e-9)."""
    return max([r for r in range(1, BUCKETS) if (1 - (percent / 100) ** r) ** (BUCKETS // r) <= MISS], default=1)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of the bands of each sketch: registers in a fixed random order, empty ones filled from the next full one."""
    n = len(sketch)
    filled = np.empty((n, BUCKETS), np.uint64)
    places = np.arange(BUCKETS)
    for i in range(n):
        full = np.flatnonzero(sketch[i] != EMPTY)
        if len(full) == 0:
            filled[i] = 0
            continue
        at = np.searchsorted(full, places)
        at[at == len(full)] = 0
        from_ = full[at]
        # how far the value came from is part of it, so that only equal gaps match
        filled[i] = sketch[i, from_].astype(np.uint64) | (((from_ - places) % BUCKETS).astype(np.uint64) << U(16))
    many = BUCKETS // rows
    filled = filled[:, _ORDER[: many * rows]].reshape(n, many, rows)
    key = np.zeros((n, many), np.uint64) + np.arange(many, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + filled[:, :, j])
    return key


def meeting_keys(sets: list[np.ndarray], sketch: np.ndarray, percent: int, common: np.ndarray) -> list[np.ndarray]:
    """The keys by which each set meets others: bands above SHORT shingles; prefixes up to the size that a short set can link with.

    In one order of all shingles (those in `common`, sorted, last; else by hash), the first that two sets share stands
    at least ceil(n * percent / 100) places before the end of each, if they are similar enough: the prefix holds it.
    """
    of_band = bands(sketch, band_rows(percent))
    out = []
    for s, b in zip(sets, of_band):
        n = len(s)
        own = [b] if n > SHORT else []
        if 0 < n <= SHORT * 100 // percent:
            last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(n, bool)
            own.append(mix(np.concatenate((s[~last], s[last]))[: n - -(-n * percent // 100) + 1] ^ U(0x5C5C5C5C)))
        out.append(np.concatenate(own) if own else np.zeros(0, np.uint64))
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of one sketch to each of others, corrected for registers equal by chance, and the buckets it rests on.

    Two different minima have equal leading zeros in about a third of cases and then equal mantissas in 2^-10.
    """
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(1), 1)
    same = ((a == b) & used).sum(1)
    chance = 2.0**-MANTISSA / 3
    return np.clip((same / n - chance) / (1 - chance), 0, 1), n


def text_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The set of each text: sorted distinct hashes of its k-word shingles."""
    data, at = string_bytes(column)
    for lo, hi, d, a in pieces(data, at):
        begin, end, text = words(d, a, NOT_SPACE)
        h, of = shingles(word_hashes(d, begin, end), text, hi - lo, k)
        cut = np.searchsorted(of, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield np.unique(h[cut[i] : cut[i + 1]])


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ROWS at a time, so that what is made of them stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def _common(docs: DataFrame, percent: int, k: int) -> np.ndarray:
    """Sorted hashes of shingles in COMMON or more documents of a sample: at most SAMPLE / COMMON times a prefixed set's size."""
    step = max(1, docs.count() // SAMPLE)
    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0) if step > 1 else docs
    sets = _sets(few, k).where(F.size("set") <= SHORT * 100 // percent)
    found = sets.select(F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).select("s")
    return np.sort(found.toArrow().column("s").to_numpy().view(np.uint64))


def _sketches(docs: DataFrame, percent: int, k: int) -> DataFrame:
    common = _common(docs, percent, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            sets = list(text_sets(b.column("text"), k))
            sk = registers(sets)
            own = meeting_keys(sets, sk, percent, common)
            s1 = np.array([np.bitwise_xor.reduce(mix(s ^ U(0xA5A5A5A5))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            s2 = np.array([np.add.reduce(mix(s + U(77))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1), pa.array(s2), pa.array([r.tobytes() for r in sk], pa.binary()), keys], names=["doc_id", "n", "s1", "s2", "sketch", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sketch binary, keys array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            sets = list(text_sets(b.column("text"), k))
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set array<long>")


def _likely(a: np.ndarray, b: np.ndarray, na: int, nb: np.ndarray, share: float) -> np.ndarray:
    """Whether sketches allow the similarity: five standard errors below it still count; sizes must allow it at all."""
    got, n = estimate(a, b)
    margin = 5 * np.sqrt(share * (1 - share) / n)
    return (got >= share - margin) & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * round(share * 100))


def _within_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the members of a bucket, in pairs of blocks (key, i, j): doc_id, n, label, block, sketch, set.

    A pair is looked at in the bucket of the first band that it shares, and in those of shared prefixes, if its labels
    differ and its sketches are likely; its full sets decide. Of the links of a task those are returned that join what it has not joined yet.
    """

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, n, lab, blk = (table[c].to_numpy() for c in ("doc_id", "n", "label", "block"))
        lab = lab.copy()
        sk = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(-1, BUCKETS)
        of_band = bands(sk, band_rows(percent))
        band = np.flatnonzero((of_band == np.int64(keys[0].as_py()).view(np.uint64)).any(0))  # none for a prefix
        column = pa.concat_arrays(table["set"].chunks)
        values, code = np.unique(column.flatten().to_numpy(), return_inverse=True)
        size = column.value_lengths().to_numpy().astype(np.int64)
        at = np.concatenate(([0], np.cumsum(size)))
        mine = np.zeros(len(values), bool)
        i_block, j_block = keys[1].as_py(), keys[2].as_py()
        left = np.flatnonzero(blk == i_block)
        right = np.flatnonzero(blk == j_block)
        out = []
        for i in left:
            r = right[(lab[right] != lab[i]) & ((ids[right] > ids[i]) if i_block == j_block else True)]
            if len(r) and len(band):
                r = r[(of_band[r] == of_band[i]).argmax(1) == band[0]]
            if len(r):
                r = r[_likely(sk[i], sk[r], n[i], n[r], percent / 100)]
            own = code[at[i] : at[i + 1]]
            mine[own] = True
            for j in r:
                if lab[i] == lab[j]:
                    continue
                common = int(np.count_nonzero(mine[code[at[j] : at[j + 1]]]))
                if common * 100 >= (size[i] + size[j] - common) * percent:
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    lab[lab == lab[j]] = lab[i]
            mine[own] = False
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return members.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(b, "b").join(a, "a").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(F.col("common") * 100 >= (F.size("set_a") + F.size("set_b") - F.col("common")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents with equal sets are one class; its smallest doc_id goes on. Sketches of long sets are cut into bands,
    and short sets have prefixes; documents that share a band's key or a shingle of their prefixes are a bucket. Each bucket's smallest document is compared with all others; whoever is linked is
    in one component. What a bucket then still holds of different components is compared in full, in blocks of BLOCK
    members, so no link is lost to the size of a bucket and no task holds one whole; the sets come along, so only links
    leave the task. Pairs whose sketches make the similarity likely are verified on the full sets.
    A null or empty text, or one of white space only, has an empty set and is linked with nothing. Rows that repeat
    doc_id are one document if their texts agree; else each text counts for it. Null doc_ids are left out of links:
    each is a component of its own (null). Other columns are not read. An empty table gives an empty result.
    """
    require(docs, ["doc_id", "text"])
    share = percent / 100
    wide, path = stored(_sketches(docs, percent, k), "near-sketches")
    # copies merge before the shuffle, sketch and all; then a class is one row, and copies join it by three numbers
    least = F.min(F.struct("doc_id", "sketch", "keys"))
    classes, classes_path = stored(wide.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(least.alias("m"), F.count("*").alias("members")), "near-classes")
    # from here on only the classes' sketches are read, and of each document four numbers
    sk = materialise(wide.select("doc_id", "n", "s1", "s2"), "near-sizes")
    discard(docs.sparkSession, path)
    some = sk.where("n > 0 and doc_id is not null")
    several = classes.where("members > 1").select("s1", "s2", "n", F.col("m.doc_id").alias("a"))
    linked = materialise(some.select("s1", "s2", "n", F.col("doc_id").alias("b")).join(several, ["s1", "s2", "n"]).where("a <> b").select("a", "b"), "near-copies")
    # a doc_id of several texts has a row for each
    reps = classes.select(F.col("m.doc_id").alias("doc_id"), "n", F.col("m.sketch").alias("sketch"), F.col("m.keys").alias("keys"))
    rows = reps.select("doc_id", "n", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("f"), F.max("doc_id").alias("last")).select("key", F.col("f.doc_id").alias("first"), F.col("f.n").alias("first_n"), "last").where("first <> last").drop("last")
    members = materialise(rows.join(buckets, "key"), "near-buckets")
    # the buckets hold what the keys told: only the sketches go on, and the table with both is deleted
    light = materialise(reps.select("doc_id", "n", "sketch"), "near-light")
    discard(docs.sparkSession, classes_path)
    # sketches to both ends of each star's edges
    stars = members.where("doc_id <> first").where(F.least("n", "first_n") * 100 >= F.greatest("n", "first_n") * percent).select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    ends = stars.join(light.toDF("b", "nb", "sb"), "b").join(light.toDF("a", "na", "sa"), "a")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _few(batches):
            a, b = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("sa", "sb"))
            good = _likely(a, b, t.column("na").to_numpy(), t.column("nb").to_numpy(), share)
            yield t.select(["a", "b"]).filter(pa.array(good))

    likely = materialise(ends.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(pick, "a long, b long"), "near-stars")
    within = members.select(F.col("doc_id").alias("member")).distinct()
    texts = docs.select("doc_id", "text").join(bounded(within, "near-members"), F.col("doc_id") == F.col("member"), "left_semi")
    sets = materialise(_sets(texts, k).distinct(), "near-sets")
    # without a distinct, which would keep adaptive execution from splitting the join of a large star with its centre
    links = materialise(_verified(likely, sets, percent), "near-links")
    found = components(links, "near-components")
    # what is left of each bucket: members of more than one component
    lab = members.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("label"))
    mixed = lab.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size"), F.sum("n").alias("shingles")).where("x <> y")
    mixed = mixed.select("key", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    left = lab.join(mixed, "key").withColumn("block", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).cast("int"))
    left = left.select("key", "doc_id", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    left = left.select("key", "doc_id", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    left = left.join(light, "doc_id").join(sets, "doc_id")
    more = materialise(_within_blocks(left, percent).union(links).distinct(), "near-all")
    every = components(more.union(linked), "near-final").withColumnRenamed("id", "doc_id")
    out = sk.select("doc_id", F.col("n").alias("n_shingles")).join(every, "doc_id", "left")
    comp = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
