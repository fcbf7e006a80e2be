"""Byte-level BPE: vectorised pre-tokenisation by an associative scan, pair merging of each distinct piece once, decoding by offsets."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes_np import distinct_slices, gather, pieces, string_bytes
from .common import require

#: Text cut at a time; arrays of a run are a few dozen times as large.
RUN_BYTES = 1 << 18
#: Distinct pieces whose tokens a Python worker remembers, twice: when so many are new, those met before them are forgotten.
CACHED = 1 << 18
#: Longer pieces are merged by themselves, and not remembered.
SHORT = 64
NO_RANK = 2**31 - 1
#: A vocabulary goes to the executors whole; larger files are refused.
MOST_VOCABULARY = 64 << 20

# What a code point is to the pattern: its class, and for white space and apostrophes also what comes behind it.
LETTER, NUMBER, OTHER, SHORT_ENDING, LONG_ENDING, WHITE, LAST_SPACE, LAST_WHITE = range(8)
# What the piece so far is: nothing yet, a run of one class, a space that leads a run, or an ending with one or two letters to come.
FRESH, LETTERS, NUMBERS, OTHERS, LED, BLANK, ONE_MORE, TWO_MORE = range(8)

# The endings that the public pattern cuts off.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")


def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(product of functions, their values by state, function of each symbol, that of a symbol that opens a text, where pieces begin).

    Each symbol is a function from state to state. All compositions of these functions are few, so each has a number and
    composing is a look-up: an associative scan gives the state behind every code point.
    """
    step = np.tile(np.array([LETTERS, NUMBERS, OTHERS, ONE_MORE, TWO_MORE, BLANK, LED, FRESH]), (8, 1))
    begins = np.ones((8, 8), bool)
    goes_on = [(LETTERS, LETTER, LETTERS), (NUMBERS, NUMBER, NUMBERS), (LED, LETTER, LETTERS), (LED, NUMBER, NUMBERS), (BLANK, WHITE, BLANK)]
    goes_on += [(s, x, OTHERS) for s in (OTHERS, LED) for x in (OTHER, SHORT_ENDING, LONG_ENDING)]
    goes_on += [(s, x, t) for s, t in ((ONE_MORE, FRESH), (TWO_MORE, ONE_MORE)) for x in range(8)]
    for state, symbol, then in goes_on:
        step[state, symbol], begins[state, symbol] = then, False
    plain = [tuple(step[:, x].tolist()) for x in range(8)]
    opening = [(int(step[FRESH, x]),) * 8 for x in range(8)]
    known = {tuple(range(8)): 0}  # the identity first
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in plain + opening:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    functions = sorted(known, key=known.get)
    product = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.int32)
    return product, np.array(functions, np.int8), np.array([known[f] for f in plain], np.int32), np.array([known[f] for f in opening], np.int32), begins


PRODUCT, VALUES, OF_SYMBOL, OF_OPENING, BEGINS = _machine()


def states(functions: np.ndarray, width: int = 256) -> np.ndarray:
    """The state behind each of a row of functions, from FRESH: products within blocks side by side, then over the blocks, then both."""
    n, k = len(functions), len(PRODUCT)
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.int32)  # number 0 is the identity
    padded[:n] = functions
    grid = np.ascontiguousarray(padded.reshape(rows, width).T)  # a column is a block
    flat = PRODUCT.ravel()
    for i in range(1, width):
        grid[i] = flat[grid[i - 1] * k + grid[i]]
    if rows == 1:
        carried = np.zeros(1, np.int64)
    else:
        totals = states(grid[-1], width) if rows > width else _in_order(grid[-1])
        carried = np.concatenate(([FRESH], totals[:-1])).astype(np.int64)
    return VALUES.ravel()[grid.astype(np.int64) * 8 + carried].T.reshape(-1)[:n]


def _in_order(functions: np.ndarray) -> np.ndarray:
    out, state = np.empty(len(functions), np.int8), FRESH
    for i, f in enumerate(functions.tolist()):
        state = VALUES[f, state]
        out[i] = state
    return out


def code_point_classes() -> np.ndarray:
    """The class of each code point, as the public library's own Unicode tables have it (letters, numbers and white space; others are OTHER)."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    singles = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        library = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=singles, special_tokens={})
        out[[ord(c) for c in bytes(library.encode_ordinary(every)).decode()]] = kind
    return out


def symbols(code: np.ndarray, last: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """What each code point is to the machine; last: the text ends behind it."""
    out = classes[code]
    white = np.flatnonzero((out[:-1] == WHITE) & (out[1:] != WHITE) & ~last[:-1])
    quotes = np.flatnonzero((code[:-1] == ord("'")) & ~last[:-1])
    out[white] = np.where(code[white] == 32, LAST_SPACE, LAST_WHITE)
    out[quotes[np.isin(code[quotes + 1], [ord(c) for c in SHORT_ENDINGS])]] = SHORT_ENDING
    quotes = quotes[quotes + 2 < len(code)]
    quotes = quotes[~last[quotes + 1]]
    for a, b in LONG_ENDINGS:
        out[quotes[(code[quotes + 1] == ord(a)) & (code[quotes + 2] == ord(b))]] = LONG_ENDING
    return out


def slices(data: np.ndarray, at: np.ndarray, classes: np.ndarray, run: int = RUN_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pieces of all texts in order, as (begins, ends) in bytes, a run of bytes at a time.

    A piece's place depends on what follows its begin alone, so a run starts where the last whole piece of the run before
    ended; a piece is whole if three code points stand behind it in the run, or the data ends.
    """
    lo, size = 0, run
    while lo < len(data):
        hi = min(lo + size, len(data))
        while hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        part = data[lo:hi]
        code = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero(part & 0xC0 != 0x80)
        heads = np.unique(at[np.searchsorted(at, lo) : np.searchsorted(at, hi)]) - lo
        first = np.zeros(len(code) + 1, bool)
        first[np.searchsorted(place, heads)] = True
        last = first[1:].copy()
        last[-1] = True
        first = first[:-1]
        x = symbols(code, last, classes)
        state = states(np.where(first, OF_OPENING[x], OF_SYMBOL[x]))
        starts = np.flatnonzero(BEGINS[np.concatenate(([FRESH], state[:-1])), x] | first)
        ends = np.append(starts[1:], len(code))
        if hi < len(data):
            whole = int(np.searchsorted(ends, len(code) - 3, "right"))
            if whole == 0:  # a piece longer than the run
                size *= 2
                continue
            starts, ends = starts[:whole], ends[:whole]
        place = np.append(place, len(part))
        yield place[starts] + lo, place[ends] + lo
        lo, size = lo + int(place[ends[-1]]), run


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the pair of neighbours of smallest rank becomes one part, the leftmost first, while any pair has a rank.

    By a heap of pairs and a linked list of parts, in n log n.
    """
    n = len(piece)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_at: list[int | None] = [ranks.get(piece[i : i + 2]) for i in range(n - 1)] + [None]
    heap = [(r, i) for i, r in enumerate(rank_at) if r is not None]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        if rank_at[i] != rank:
            continue
        j = ends[i]
        ends[i] = k = ends[j]
        rank_at[j] = None
        if k < n:
            before[k] = i
        for x in (i, before[i]):
            if x >= 0:
                y = ends[x]
                rank_at[x] = r = ranks.get(piece[x : ends[y]]) if y < n else None
                if r is not None:
                    heappush(heap, (r, x))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Vocabulary:
    """Ranks of byte strings, the strings by id, and the tokens of pieces met before."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        if missing := 256 - sum(len(k) == 1 for k in self.ranks):
            raise ValueError(f"the vocabulary lacks {missing} of the 256 bytes")
        size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        by_id = sorted((i, k) for k, i in self.ranks.items())
        size[[i for i, _ in by_id]] = [len(k) for _, k in by_id]
        self.size, self.begin = size, np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(k for _, k in by_id), np.uint8)
        # every way to cut a token into two: (left, right) as one number, in order, and the token
        pair, token = array("q", [1 << 62]), array("i", [NO_RANK])
        for i, k in by_id:
            for j in range(1, len(k)):
                left, right = self.ranks.get(k[:j]), self.ranks.get(k[j:])
                if left is not None and right is not None:
                    pair.append(left * len(size) + right)
                    token.append(i)
        order = np.argsort(np.array(pair))
        self.pair, self.token = np.array(pair)[order], np.array(token)[order]
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token of each two neighbours; NO_RANK where there is none."""
        key = left.astype(np.int64) * len(self.size) + right
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.token[at], NO_RANK).astype(np.int32)

    def merge_rows(self, found: list[bytes]) -> list[bytes]:
        """What `merged` gives, for many short pieces side by side: a row each; in each round every row merges its best pair."""
        size = np.fromiter(map(len, found), np.int64, len(found))
        n, width = len(found), int(size.max())
        column = np.arange(width)
        ids = np.zeros((n, width), np.int32)
        ids[column < size[:, None]] = self.byte[np.frombuffer(b"".join(found), np.uint8)]
        best = np.full((n, width), NO_RANK, np.int32)
        row, at = np.nonzero(column[:-1] < size[:, None] - 1)
        best[row, at] = self.rank(ids[row, at], ids[row, at + 1])
        done, row = ids.copy(), np.arange(n)
        while len(row):
            i = best.argmin(1)
            own = np.arange(len(row))
            token = best[own, i]
            left = token < NO_RANK
            if not left.all():  # rows without a pair are ready
                done[row[~left]] = ids[~left]
                ids, best, row, i, token, own = ids[left], best[left], row[left], i[left], token[left], own[: int(left.sum())]
            shift = np.minimum(column + (column > i[:, None]), width - 1)
            ids, best = np.take_along_axis(ids, shift, 1), np.take_along_axis(best, shift, 1)
            ids[own, i] = token
            size[row] -= 1
            best[own, size[row] - 1] = NO_RANK
            more = np.flatnonzero(i < size[row] - 1)
            best[more, i[more]] = self.rank(ids[more, i[more]], ids[more, i[more] + 1])
            more = np.flatnonzero(i > 0)
            best[more, i[more] - 1] = self.rank(ids[more, i[more] - 1], ids[more, i[more]])
        flat = done[column < size[:, None]].tobytes()
        ends = (np.cumsum(size) * 4).tolist()
        return [flat[b:e] for b, e in zip([0, *ends[:-1]], ends, strict=True)]

    def ids_of(self, found: list[bytes]) -> list[bytes]:
        """The tokens of each piece, as four bytes each."""
        if len(self.cache) > CACHED:
            self.cache, self.older = {}, self.cache
        out = list(map(self.cache.get, found))
        fresh, new = [i for i, x in enumerate(out) if x is None], {}
        for i in fresh:
            piece = found[i]
            if (ids := self.older.get(piece)) is not None:
                out[i] = ids
            elif piece in self.ranks:
                out[i] = array("i", [self.ranks[piece]]).tobytes()
            elif len(piece) > SHORT:
                out[i] = array("i", merged(piece, self.ranks)).tobytes()
            else:
                new.setdefault((len(piece) + 3) // 4, []).append(i)
        for rows in new.values():
            for i, ids in zip(rows, self.merge_rows([found[i] for i in rows]), strict=True):
                out[i] = ids
        self.cache.update({found[i]: out[i] for i in fresh if len(found[i]) <= SHORT})
        return out

    def encode(self, data: np.ndarray, at: np.ndarray, classes: np.ndarray, run: int = RUN_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each token's bytes begin in data."""
        ids, starts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for begin, end in slices(data, at, classes, run):
            first, value, _ = distinct_slices(data, begin, end)
            raw, lo = data[begin[0] : end[-1]].tobytes(), int(begin[0])
            found = self.ids_of([raw[b - lo : e - lo] for b, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
            count = np.fromiter(map(len, found), np.int64, len(found)) // 4
            flat = np.frombuffer(b"".join(found), np.int32)
            got = gather(flat, (np.cumsum(count) - count)[value], count[value])
            size = self.size[got]
            ids.append(got)
            starts.append(np.cumsum(size) - size + lo)  # pieces stand side by side
        return np.concatenate(ids), np.concatenate(starts)


_kept: dict[str, Vocabulary] = {}


def vocabulary(lines: bytes) -> Vocabulary:
    """One for each Python worker and rank file, whichever tasks it serves."""
    key = hashlib.sha256(lines).hexdigest()
    if key not in _kept:
        _kept.clear()
        _kept[key] = Vocabulary(lines)
    return _kept[key]


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """The bytes of a rank file: a local file of the driver, or, with a scheme, one that Spark reads; of MOST_VOCABULARY bytes at most."""
    if "://" in path:
        row = spark.read.format("binaryFile").load(path).where(F.col("length") <= MOST_VOCABULARY).select("content").head()
        lines = b"" if row is None else bytes(row.content)
    else:
        with open(path, "rb") as f:
            lines = f.read(MOST_VOCABULARY + 1)
    if not 0 < len(lines) <= MOST_VOCABULARY:
        raise ValueError(f"no rank file of 1 to {MOST_VOCABULARY} bytes: {path}")
    return lines


def _encoded(batches: Iterator[pa.RecordBatch], lines: bytes, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    words = vocabulary(lines)
    for b in batches:
        for lo, hi, data, at in pieces(*string_bytes(b.column("text")), 1 << 20):
            ids, starts = words.encode(data, at, classes)
            cut = np.searchsorted(starts, at).astype(np.int32)
            starts -= np.repeat(at[:-1], np.diff(cut))
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (ids, starts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *lists], names=["doc_id", "ids", "starts"])


def _decoded(batches: Iterator[pa.RecordBatch], lines: bytes) -> Iterator[pa.RecordBatch]:
    words = vocabulary(lines)
    for b in batches:
        lists, starts = b.column("ids"), b.column("starts")
        cut = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
        ids, place = lists.flatten().to_numpy(), starts.flatten().to_numpy()
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(words.size) or not words.size[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        size = words.size[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        at = total[cut]  # where each document's bytes begin
        out = np.empty(int(total[-1]), np.uint8)
        begin = place + np.repeat(at[:-1], np.diff(cut))
        out[np.repeat(begin - total[:-1], size) + np.arange(len(out))] = gather(words.data, words.begin[ids], size)
        decoded = pa.Array.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, decoded.cast(pa.binary())], names=["doc_id", "ids", "decoded"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_tokens and digests of the ids (decimal, joined by commas) and of the decoded bytes."""
    for b in batches:
        ids = [x.as_py() or [] for x in b.column("ids")]
        of_ids = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
        of_bytes = [hashlib.sha256(x.as_buffer()).hexdigest() for x in b.column("decoded")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, starts): the tokens of each whole text by the rank file at path, and the byte at which each begins.

    Null and empty texts have no tokens. Repeated rows, and a doc_id that is null or has several texts, are encoded row by
    row; no rows give none. Other columns are left out, whatever their names. Memory follows the longest text.
    """
    require(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((read_vocabulary(spark, path), code_point_classes()))  # about 2 MB, whatever the corpus
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _encoded(batches, *sent.value), f"doc_id {kind}, ids array<int>, starts array<bigint>")


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of each token put at its start. Null ids count as none; an id without bytes is an error."""
    require(tokens, ["doc_id", "ids", "starts"])
    spark = tokens.sparkSession
    sent = spark.sparkContext.broadcast(read_vocabulary(spark, path))
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids", "starts").mapInArrow(lambda batches: _decoded(batches, sent.value), f"doc_id {kind}, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encode_documents and decode_documents give, digested where it arises: one Python worker does all, and tokens never leave it."""
    require(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((read_vocabulary(spark, path), code_point_classes()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    steps = lambda batches: _digests(_decoded(_encoded(batches, *sent.value), sent.value[0]))
    return docs.select("doc_id", "text").mapInArrow(steps, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
