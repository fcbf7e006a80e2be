"""Fill-in-the-middle, phrases and byte-level BPE: brute force, round trips, the public library, edge cases."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from codeprism.llm import bpe
from codeprism.llm.bpe import decode_documents, encode_documents
from codeprism.llm.bytes_np import string_bytes
from codeprism.llm.collocations import Shard, gram_counts, mine_phrases
from codeprism.llm.fim import fill_in_middle
from codeprism.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: n, h, ids and others clash with names that the operators use.
SCHEMA = "doc_id long, text string, lang string, n string, ids string, form string, score string, batch string"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LINES = "".join(f"line {i} of a long text, it's {i * i}.\n" for i in range(30_000))
ROWS = [
    (1, "one\ntwo\n\nthree"), (2, "no line end"), (3, "\n"), (4, None), (5, ""), (6, "a<S>b\nc\n"), (7, "twice\nthe same\n"), (7, "twice\nthe same\n"), (7, "the id\nwith another text"),
    (8, LINES), (9, "é\n漢字\n🤦🏼‍♂️ x\n"), (None, "no id\nat all"), (10, "a\r\nb\rc\x0bd\x00e\n"), (11, "<\n<S\n>P>\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 2 else "en", *"xxxxx") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def cut_by_hand(i, text, transformed=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"7:{'' if i is None else i}")
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    x, y = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or re.search("<[PSM]>", text) or c % 100 >= transformed:
        return (i, len(units), "plain", None, None, text, sha(text), sha(text))
    form = "spm" if d % 100 < spm else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (i, len(units), form, len(p), len(m), out, sha(out), sha(text))


def test_fill_in_middle(odd, empty):
    key = repr
    assert sorted(map(tuple, fill_in_middle(odd).collect()), key=key) == sorted((cut_by_hand(*r) for r in ROWS), key=key)
    some = fill_in_middle(odd, transformed=40, suffix_first=90, texts=False)
    assert "output" not in some.columns
    want = [cut_by_hand(*r, 40, 90) for r in ROWS]
    assert sorted(map(tuple, some.collect()), key=key) == sorted((r[:5] + r[6:] for r in want), key=key)
    assert {"plain", "spm"} <= {r[2] for r in want}
    assert fill_in_middle(empty).collect() == []


def phrases_by_hand(rows, least, covered, top, most=3):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x) > 2 and a >= least}
    out = {}
    for x, a in found.items():
        lang, w = x[0], x[1:]
        if any(100 * b >= covered * a for y, b in found.items() if y[0] == lang and len(y) > len(x) and any(y[1 + i : 1 + i + len(w)] == w for i in range(len(y) - len(w)))):
            continue
        cuts = [(10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top], 1))


def test_phrases(spark, empty):
    rng = random.Random(5)
    names = ["The", "the", "cat", "sat", "é", "漢", "a.b", "x", "on\t the", "mat,", "Wow! ", "\x1c", "it's", "no\nline", "z" * 400]
    rows = [(rng.choice(["en", "en", "en", "de", None, "é"]), " ".join(rng.choice(names) for _ in range(rng.randrange(0, 60)))) for _ in range(120)]
    rows += [("en", None), (None, ""), ("en", " \t\n"), ("few", "once upon"), ("en", "same words again and again " * 3)] + [("en", "same words again")] * 12 + [("long", "ab cd ef, " * 20_000)]
    df = spark.createDataFrame([(1, t, x, *"xxxxx") for x, t in rows], SCHEMA).repartition(3)
    for args in ((10, 50, 2000), (3, 80, 7), (2, 101, 2000)):
        assert sorted(map(tuple, mine_phrases(df, 3, *args).collect())) == phrases_by_hand(rows, *args)
    assert sorted(map(tuple, mine_phrases(df, 2, 3, 50, 20).collect())) == phrases_by_hand(rows, 3, 50, 20, 2)
    assert sorted(map(tuple, mine_phrases(df, 5, 2, 50, 2000).collect())) == phrases_by_hand(rows, 2, 50, 2000, 5)
    assert mine_phrases(empty).collect() == []


def test_intervals_of_the_suffix_array():
    texts = ["a b a b a b", "b a. b a b", "", None, "c"]
    shard = Shard(pa.array(texts), pa.array(["x", "y", "x", "x", "y"]))
    got = {(shard.langs[shard.lang[i]], p): c for k, first, count in gram_counts(shard, 1, 4) for i, p, c in zip(first, shard.phrases(first, k).to_pylist(), count.tolist(), strict=True)}
    want = Counter()
    for lang, text in zip("xyxxy", texts, strict=True):
        for piece in (text or "").split("."):
            w = piece.split()
            want.update((lang, " ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert got == want


@pytest.fixture(scope="module")
def library():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tables():
    with open(VOCABULARY, "rb") as f:
        return bpe.vocabulary(f.read()), bpe.code_point_classes()


def pieces_by_library(text):
    """The public pattern's pieces: every byte a token, so that no pair is merged; the pieces are found by matching each alone."""
    import regex

    return regex.findall(public_tokenizers.PATTERN, text)


@pytest.mark.parametrize("run", [1 << 20, 50, 5])
def test_pieces_and_tokens_equal_the_library(library, tables, run):
    words, classes = tables
    rng = random.Random(run)
    parts = ["a", "s", "t", "re", "ve", "ll", "'", "'s", "'re", "'l", " ", "  ", "\n", "\t", "\xa0", "1", "٣", "é", "ß", "漢", "!", "🤦🏼‍♂️", "\x1c", "\r\n", "d", "m", "-", "S", "\0", " ", "Ⅷ", "\U0001e4d0", "nationally"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(1500)] + ["", "a" * 3000, " " * 3000, "'" * 700, "x" * 300 + " ", " 's", "'", "'r", "'l"]
    data, at = string_bytes(pa.array(texts))
    raw = data.tobytes()
    found = [raw[b:e].decode() for begin, end in bpe.slices(data, at, classes, run) for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
    assert found == [p for t in texts for p in pieces_by_library(t)]
    ids, starts = words.encode(data, at, classes, run)
    cut = np.searchsorted(starts, at)
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]


def test_products_of_functions_are_associative():
    n = len(bpe.PRODUCT)
    rng = np.random.default_rng(3)
    f, g, h = rng.integers(0, n, (3, 5000))
    assert (bpe.PRODUCT[bpe.PRODUCT[f, g], h] == bpe.PRODUCT[f, bpe.PRODUCT[g, h]]).all()
    row = rng.integers(0, n, 70_000)
    assert (bpe.states(row) == bpe._in_order(row)).all()


def test_merging_one_by_one_and_side_by_side(tables):
    words, _ = tables
    rng = random.Random(9)
    found = [bytes(rng.choice(b"abenrst\xc3\xa9 ") for _ in range(rng.randrange(1, 65))) for _ in range(3000)]
    found = [x for x in found if x not in words.ranks]
    rows = words.merge_rows(found)
    assert [np.frombuffer(x, np.int32).tolist() for x in rows] == [bpe.merged(x, words.ranks) for x in found]


def test_documents_round_trip(odd, empty, library):
    tokens = encode_documents(odd, VOCABULARY)
    rows = [tuple(r) for r in decode_documents(tokens, VOCABULARY).collect()]
    want = [(i, library.encode_ordinary(t or ""), bytearray((t or "").encode())) for i, t in ROWS]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    for r in tokens.collect():
        size = [len(library.decode_single_token_bytes(i)) for i in r.ids]
        assert r.starts == np.cumsum([0, *size])[:-1].tolist()
    assert decode_documents(encode_documents(empty, VOCABULARY), VOCABULARY).collect() == []
    assert encode_documents(empty, VOCABULARY).collect() == []


def test_vocabulary_by_a_path_of_spark_and_missing_bytes(spark, odd, tmp_path):
    want = sorted(map(repr, encode_documents(odd, VOCABULARY).collect()))
    assert sorted(map(repr, encode_documents(odd, f"file://{VOCABULARY}").collect())) == want
    (tmp_path / "few").write_text("YQ== 0\nYg== 1\n")
    with pytest.raises(Exception, match="lacks 254"):
        encode_documents(odd, str(tmp_path / "few")).collect()


def test_query_of_tokens(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    want = {}
    for i, t in docs.items():
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(t))
    assert got == want
