"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytes_np import BYTE_FOLDED, LETTERS, U, mix, pieces, powers, string_bytes, word_hashes, words
from .common import materialise, release_memory, require

BITS = 20
#: At most so many labelled rows fit the model: those whose hash of doc_id is smallest.
TRAIN_ROWS = 20_000
#: Hashed terms that fewer rows of the sample have get no weight; all others do, whatever the labels say of them alone.
LEAST_ROWS = 3
RANK = 8
EPOCHS = 5
BATCH = 256
RATE = 0.1
#: Soft threshold of linear weights; factors have none, so that pairs of terms without weight can still be learned.
SPARSE = 7e-4
#: Batches that a fit takes at least; smaller samples go through more epochs than EPOCHS.
STEPS = 130
#: Terms learn at scales up to 1 that rise with how many standard errors (from 2 to 4) the label's share among their rows is off.
#: A weight's scale is FLOOR at least. That of factors is PAIRS for terms that a fifth of the rows have, less for rarer ones, PAIRS_LEAST at least.
FLOOR = 0.1
PAIRS = 0.35
PAIRS_LEAST = 0.05
THRESHOLD = 0.3
#: Lengths in bytes of the word beginnings that are terms besides the words.
PREFIXES = (3, 4, 5)


def hashed_terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of each text as numbers under 2^BITS, with the text of each: whole words and word beginnings, case folded."""
    begin, end, text = words(data, at, LETTERS)
    keep = end - begin >= 2
    begin, end, text = begin[keep], end[keep], text[keep]
    out, of = [word_hashes(data, begin, end)], [text]
    for n in PREFIXES:
        long = end - begin > n
        b = begin[long]
        s = np.zeros(len(b), np.uint64)
        for j in range(n):
            s += BYTE_FOLDED[data[b + j]] * powers(n + 1)[j]
        out.append(mix(s + U(0x51ED270B + n)))
        of.append(text[long])
    return (np.concatenate(out) >> U(64 - BITS)).astype(np.int64), np.concatenate(of)


@dataclass
class Machine:
    """score = 1 / (1 + exp(-(bias + sum w + 1/2 sum_k((sum v_k)^2 - sum v_k^2)))) over the terms that a text has."""

    slot: np.ndarray  # term -> its place, or -1
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        z = np.full(n, self.bias)
        for lo, hi, d, a in pieces(data, at):
            term, of = hashed_terms(d, a)
            place = self.slot[term]
            known = place >= 0
            pair = np.unique(of[known] * len(self.w) + place[known])
            z[lo:hi] += self.add(pair // len(self.w), pair % len(self.w), hi - lo)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    def add(self, of: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        out = np.bincount(of, self.w[place], n).astype(float)  # without terms, bincount gives whole numbers
        for k in range(self.v.shape[1]):
            x = self.v[place, k]
            out += (np.bincount(of, x, n) ** 2 - np.bincount(of, x * x, n)) / 2
        return out


def scales(places: list[np.ndarray], labels: np.ndarray, m: int, rank: int) -> np.ndarray:
    """The scales of the weight and the factors of each of m terms: places[i] are the terms of row i, labels[i] its label."""
    rows, total, hit = len(labels), np.zeros(m), np.zeros(m)
    for lo in range(0, rows, BATCH):  # a batch at a time: wide copies of all terms would hold many times the sample
        part = places[lo : lo + BATCH]
        place = np.concatenate(part)
        total += np.bincount(place, minlength=m)
        hit += np.bincount(place, np.repeat(labels[lo : lo + BATCH], [len(t) for t in part]), m)
    p = labels.sum() / rows
    spread = np.sqrt(np.maximum(total * p * (1 - p) * np.maximum(1 - total / rows, 1e-3), 0.25))
    strong = np.clip(np.abs(hit - total * p) / spread / 2 - 1, 0, 1)
    pairs = np.maximum(PAIRS_LEAST, PAIRS * np.minimum(1, 5 * total / rows))
    out = np.repeat((pairs + (1 - pairs) * strong)[:, None], rank + 1, axis=1)
    out[:, 0] = FLOOR + (1 - FLOOR) * strong
    return out.astype(np.float32)


def fit(places: list[np.ndarray], labels: np.ndarray, known: np.ndarray | None = None, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Fit the machine: places[i] are the places in `known`, the terms that have weights, of text i's terms.

    AdaGrad on the log loss over batches, with a soft threshold on linear weights. Every term has a weight and factors; a
    term whose rows are labelled like any others, and a rare one, learns more slowly (see FLOOR), which keeps noise small
    and is no selection: two such terms whose pair tells the label are found by their factors.
    One class only, or none: the smoothed share of label 1 is everyone's score.
    """
    n, pos = len(labels), int(labels.sum())
    slot = np.full(1 << BITS, -1, np.int32)
    if n == 0 or pos == 0 or pos == n:
        share = (pos + 1) / (n + 2)
        return Machine(slot, float(np.log(share / (1 - share))), np.zeros(1), np.zeros((1, rank)))
    known = np.zeros(0, np.int64) if known is None else known
    slot[known] = np.arange(len(known))
    m = max(len(known), 1)
    count = np.array([len(t) for t in places])
    scale = scales(places, labels, m, rank)
    rng = np.random.Generator(np.random.PCG64(seed))
    # a term's weight and factors side by side; column 0 is the weight
    table = np.concatenate((np.zeros((m, 1)), rng.normal(0, 0.01, (m, rank))), axis=1).astype(np.float32)
    squares, bias, bias_squares = np.full_like(table, 1e-8), np.log(pos / (n - pos)), 1e-8
    batches = max(1, n // BATCH)
    for _ in range(max(epochs, -(-STEPS // batches))):
        for rows in np.array_split(rng.permutation(n), batches):
            size = count[rows]
            local = np.repeat(np.arange(len(rows)), size)
            term, of = np.unique(np.concatenate([places[i] for i in rows]), return_inverse=True)
            own = scale[term]
            x = table[term] * own
            gathered = x[of]
            sums = np.stack([np.bincount(local, gathered[:, k], len(rows)) for k in range(rank + 1)], axis=1)
            z = bias + sums[:, 0] + ((sums[:, 1:] ** 2).sum(1) - np.bincount(local, (gathered[:, 1:] ** 2).sum(1), len(rows))) / 2
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
            grad = np.empty_like(x)
            grad[:, 0] = per_term = np.bincount(of, g[local], len(term))
            for k in range(1, rank + 1):
                grad[:, k] = np.bincount(of, (g * sums[:, k])[local], len(term)) - x[:, k] * per_term
            grad *= own
            squares[term] += grad * grad
            step = RATE / np.sqrt(squares[term])
            new = table[term] - step * grad
            new[:, 0] = np.sign(new[:, 0]) * np.maximum(np.abs(new[:, 0]) - step[:, 0] * SPARSE, 0)
            table[term] = new
            bias_squares += g.sum() ** 2
            bias -= RATE * g.sum() / np.sqrt(bias_squares)
    table *= scale
    return Machine(slot, float(bias), table[:, 0].copy(), table[:, 1:].copy())


def _frequent(rows: DataFrame, least: int) -> np.ndarray:
    """The terms that at least so many rows have, in order: at most 2^BITS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.frombuffer(t, np.uint32) for t in b.column("terms").to_pylist()]
            term, n = np.unique(np.concatenate([*lists, np.zeros(0, np.uint32)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(n)], names=["term", "n"])

    counts = rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return np.sort(counts.where(F.col("n") >= least).select("term").toArrow()["term"].to_numpy())


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, least: int = LEAST_ROWS) -> Machine:
    """Fit a machine on labelled documents whose crc32(doc_id) mod 4 is not 2.

    labels: doc_id, toxic (0 or 1; others and nulls are left out; several of one doc_id: the largest). The sample is the
    `rows` labelled doc_ids of smallest hash, and of rows that share a doc_id the text of smallest CRC-32. Executors hash
    and count its terms; the driver gets the numbers of terms that have weights (2^BITS at most), and which of these
    each text of the sample has.
    """
    require(docs, ["doc_id", "text"])
    require(labels, ["doc_id", "toxic"])
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = string_bytes(b.column("text"))
            out = []
            for lo, hi, d, a in pieces(data, at):
                term, of = hashed_terms(d, a)
                pair = np.unique((of << BITS) | term)
                cut = np.searchsorted(pair >> BITS, np.arange(hi - lo + 1))
                t = (pair & ((1 << BITS) - 1)).astype(np.uint32)
                out += [t[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)]
            crc = pa.array([zlib.crc32(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), crc, pa.array(out, pa.binary())], names=["doc_id", "toxic", "crc", "terms"])

    found = found.mapInArrow(hashed, "doc_id long, toxic int, crc long, terms binary")
    one = found.groupBy("doc_id").agg(F.min(F.struct("crc", "toxic", "terms")).alias("m")).select("doc_id", "m.toxic", "m.terms")
    found = materialise(one, "toxicity-terms")
    n, pos = found.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    some = _frequent(found, least) if 0 < pos < n else np.zeros(0, np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("terms").to_pylist():
                t = np.frombuffer(t, np.uint32)
                at = np.minimum(np.searchsorted(some, t), max(len(some) - 1, 0)).astype(np.int32)
                out.append(at[some[at] == t].tobytes() if len(some) else b"")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(out, pa.binary())], names=["doc_id", "toxic", "places"])

    got = found.mapInArrow(placed, "doc_id long, toxic int, places binary").toArrow()
    order = np.argsort(got["doc_id"].to_numpy())
    toxic = got["toxic"].to_numpy().astype(float)[order]
    lists = [np.frombuffer(t.as_buffer(), np.int32) for t in got["places"]]  # views: what was collected is held once
    machine = fit([lists[i] for i in order], toxic, some)
    del got, lists
    release_memory()
    return machine


def score(docs: DataFrame, machine: Machine, column: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns in keep; all if None) with a column of scores, 0 to 1: one pass over the text, without shuffle.

    Null and empty texts get the score of a text without terms. Rows are scored one by one, so ties and repeated rows
    get equal scores; other columns pass through (one named like the new column is replaced).
    """
    require(docs, ["text"])
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of bounded size: 2^BITS places and weights at most
    kept = docs.columns if keep is None else keep
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            z = m.scores(*string_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(z, pa.float64())], names=[*kept, column])

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Labels only fit the model."""
    machine = train(docs, labels, rows)
    out = score(docs.select("doc_id", "text"), machine, "score", ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
