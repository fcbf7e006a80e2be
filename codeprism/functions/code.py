"""Scalar functions over source text that need a lexer's state: Arrow-batched, one call for a batch of rows."""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..sources import brace
from .text import TOKEN


@pandas_udf(T.StringType())
def masked(text: pd.Series) -> pd.Series:
    """Source text with comments, strings, characters and text blocks as blanks; length and line breaks stay."""
    return text.map(lambda t: None if t is None else brace.mask(t))


@pandas_udf(T.StringType())
def first_branch(text: pd.Series) -> pd.Series:
    """C text with only the first branch of each #if; offsets stay."""
    return text.map(lambda t: None if t is None else brace.first_branch(t))


@pandas_udf(T.LongType())
def non_comment_loc(text: pd.Series) -> pd.Series:
    """Lines with anything but comments; block comments go on over lines."""
    return text.map(lambda t: 0 if t is None else brace.non_comment_loc(t))


@pandas_udf(T.BooleanType())
def thin_forwarder(body: pd.Series) -> pd.Series:
    """Whether a body is one call that only hands on."""
    return body.map(lambda t: False if t is None else brace.thin_forwarder(t))


@pandas_udf(T.StructType([T.StructField("switches", T.IntegerType()), T.StructField("cases", T.IntegerType()), T.StructField("density", T.DoubleType())]))
def switch_metrics(text: pd.Series) -> pd.DataFrame:
    """Switches, cases and cases per switch."""
    return pd.DataFrame([brace.switch_metrics(t or "") for t in text], columns=["switches", "cases", "density"])


@pandas_udf(T.StructType([T.StructField("nesting", T.IntegerType()), T.StructField("complexity", T.IntegerType()), T.StructField("cognitive", T.IntegerType()), T.StructField("ncss", T.IntegerType()), T.StructField("controls", T.IntegerType())]))
def body_metrics(body: pd.Series, language: pd.Series, name: pd.Series) -> pd.DataFrame:
    """Of a body of C, C++ or Java: deepest control statement, sum of 1 + depth, cognitive complexity, statements, control statements."""
    rows = []
    for b, lang, n in zip(body, language, name):
        nodes = brace.parse_body(b or "")
        rows.append((brace.nesting(nodes, lang or ""), brace.complexity(nodes, lang or ""), brace.cognitive(nodes, n or ""), brace.ncss(nodes), brace.control_nodes(nodes)))
    return pd.DataFrame(rows, columns=["nesting", "complexity", "cognitive", "ncss", "controls"])


@pandas_udf(T.StructType([T.StructField("methods", T.IntegerType()), T.StructField("assertions", T.IntegerType()), T.StructField("disabled", T.IntegerType()), T.StructField("skips", T.IntegerType())]))
def test_strength(source: pd.Series) -> pd.DataFrame:
    """Test methods, assertions, disabling marks and skips of a test source, comments and literals apart."""
    return pd.DataFrame([brace.test_strength(t or "") for t in source], columns=["methods", "assertions", "disabled", "skips"])


@pandas_udf(T.StringType())
def rejection_kind(body: pd.Series) -> pd.Series:
    """How a Java body refuses what it inherits (empty_override, unsupported_operation, empty_return, null_stub, constant_stub, logging_stub); null if it does not."""
    from ..sources.java_model import rejection

    return body.map(lambda t: rejection(t) or None)


@pandas_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))
def clone_tokens_with_lines(text: pd.Series, language: pd.Series) -> pd.Series:
    """Tokens of the text without comments and white space, each with the first and last line that it touches; a token may go on over line ends."""

    def located(t: str | None, kind: str | None) -> list[dict]:
        bare = re.sub(r"#[^\n]*", "", t or "") if kind == "python" else re.sub(r"//[^\n]*", "", re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), t or "", flags=re.S))
        packed, lines = [], []
        for k, line in enumerate(bare.split("\n"), 1):
            word = re.sub(r"[\x20\x09-\x0d]+", "", line)
            packed.append(word)
            lines += [k] * len(word)
        return [{"token": m[0], "first": lines[m.start()], "last": lines[m.end() - 1]} for m in regex.finditer(TOKEN, "".join(packed))]

    return pd.Series([located(t, k) for t, k in zip(text, language, strict=True)])
