"""NumPy over the bytes of Arrow string columns: words, word hashes, shingles, n-gram hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20260101))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
#: The same for A-Z and a-z.
BYTE_FOLDED = BYTE.copy()
BYTE_FOLDED[65:91] = BYTE[97:123]
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~SPACES
#: ASCII letters and all bytes of other scripts.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Powers of an odd number, for places within a word; grown when a longer word comes.
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate(([U(1)], np.full(max(n, 4096), _BASE, np.uint64))))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, one after the other, and where each value begins (n + 1 offsets); null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, at: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes, so that arrays derived from them stay small: (first, last + 1, data, offsets)."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes of a kind within each text: begin, end and text number of each."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = kind[data]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    fresh[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    begin, end = np.flatnonzero(fresh), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(at, begin, side="right") - 1


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray = BYTE_FOLDED) -> np.ndarray:
    """64 bits of each word: a sum over its bytes, by value and place, mixed."""
    if len(begin) == 0:
        return np.zeros(0, np.uint64)
    size = end - begin
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    value = table[data[place + np.repeat(begin, size)]] * powers(int(size.max()))[place]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64))


def shingles(h: np.ndarray, text: np.ndarray, n_texts: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row within each text, and the text of each; fewer words in all: one hash of them all."""
    if len(h) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p = powers(k + 1)
    m = len(h) - k + 1
    out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if m > 0:
        s = np.zeros(m, np.uint64)
        for j in range(k):
            s += h[j : j + m] * p[j + 1]
        whole = text[:m] == text[k - 1 :]
        out, of = s[whole], text[:m][whole]
    count = np.bincount(text, minlength=n_texts)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.searchsorted(text, few)
        s = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            there = count[few] > j
            s[there] += h[first[there] + j] * p[j + 1]
        s += (count[few].astype(np.uint64)) * U(0xD6E8FEB86659FD93)
        out, of = np.concatenate((out, s)), np.concatenate((of, few))
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return mix(out), of


def gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all slices, one after the other."""
    if len(begin) == 0:
        return data[:0]
    first = np.cumsum(size) - size
    return data[np.arange(int(size.sum())) + np.repeat(begin - first, size)]


def distinct_slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray, run: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of a slice of each value, each slice's value, 64 bits of each value); values with equal hashes are told apart by their bytes.

    Slices are hashed and compared `run` at a time, so that the arrays over their bytes stay small.
    """
    n, size = len(begin), end - begin
    runs = [slice(lo, lo + run) for lo in range(0, n, run)]
    h = np.concatenate([word_hashes(data, begin[r], end[r], BYTE) for r in runs] or [np.zeros(0, np.uint64)])
    order = np.argsort(h)
    fresh = np.concatenate((np.ones(min(n, 1), bool), h[order[1:]] != h[order[:-1]]))
    first = order[fresh]
    value = np.empty(n, np.int64)
    value[order] = np.cumsum(fresh) - 1
    like = first[value]
    if (size == size[like]).all() and all((gather(data, begin[r], size[r]) == gather(data, begin[like[r]], size[r])).all() for r in runs):
        return first, value, h[first]
    # two values have one hash: by the bytes
    known: dict[bytes, int] = {}
    raw = data.tobytes()
    value = np.array([known.setdefault(raw[b:e], len(known)) for b, e in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)
    _, first = np.unique(value, return_index=True)
    return first, value, word_hashes(data, begin[first], end[first], BYTE)
