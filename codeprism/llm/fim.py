"""Fill-in-the-middle: whole texts cut at line ends into prefix, middle and suffix, by DuckDB over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytes_np import pieces, string_bytes
from .common import require

#: Text that DuckDB gets at a time (at least one whole text).
RUN_BYTES = 4 << 20
SEED = 7
#: Of 100 texts, how many are transformed, and how many of these have the suffix first.
TRANSFORMED = 100
SUFFIX_FIRST = 50
#: Marks of prefix, suffix and middle; a text that holds one of them stays plain.
MARKS = ("<P>", "<S>", "<M>")


def batch_sql(seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> str:
    """DuckDB SQL over a relation `batch` (i, doc_id, text)."""
    p, s, m = MARKS
    draw = lambda k: f"('0x' || substr(h, {8 * k - 7}, 8))::BIGINT"
    return rf"""
WITH d AS (SELECT i, doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM batch),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units FROM d),
c AS (SELECT *, len(units)::BIGINT AS n, {draw(1)} % (len(units) + 1) AS x, {draw(2)} % (len(units) + 1) AS y,
  CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR {draw(3)} % 100 >= {transformed} THEN 'plain' WHEN {draw(4)} % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM u),
k AS (SELECT *, array_to_string(list_slice(units, 1, least(x, y)), '') AS prefix, array_to_string(list_slice(units, least(x, y) + 1, greatest(x, y)), '') AS middle, array_to_string(list_slice(units, greatest(x, y) + 1, n), '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'psm' THEN concat('{p}', prefix, '{s}', suffix, '{m}', middle) WHEN 'spm' THEN concat('{s}', suffix, '{p}', prefix, '{m}', middle) ELSE text END AS output FROM k),
b AS (SELECT *, CASE WHEN form <> 'plain' THEN string_split_regex(output, '{p}|{s}|{m}') END AS parts FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars, output,
  CASE form WHEN 'psm' THEN concat(parts[2], parts[4], parts[3]) WHEN 'spm' THEN concat(parts[3], parts[4], parts[2]) ELSE output END AS restored FROM b
"""


def fill_in_middle(docs: DataFrame, seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, texts: bool = True) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256) of each row; without texts, no output.

    A text is cut into n lines (each with its line end); hashes of seed and doc_id choose two places between them, and the
    form: prefix, suffix, middle (psm), or suffix, prefix, middle (spm). Empty and null texts and those that hold a mark
    stay plain. restored_sha256 is of the text rebuilt from output and form. A null doc_id counts as an empty string.
    Repeated rows are transformed alike, row by row; no rows give none. Other columns are left out, whatever their names.
    Memory follows RUN_BYTES and the longest text.
    """
    require(docs, ["doc_id", "text"])
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", *["output"] * texts, "output_sha256", "restored_sha256"]
    sql = f"SELECT {', '.join(names[: 5 + texts])}, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM ({batch_sql(seed, transformed, suffix_first)})"

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": False, "autoload_known_extensions": False})
        for b in batches:
            for lo, hi, _, _ in pieces(*string_bytes(b.column("text")), RUN_BYTES):
                part = b.slice(lo, hi - lo)
                rows = pa.Table.from_arrays([pa.array(np.arange(hi - lo)), part.column("doc_id"), part.column("text")], names=["i", "doc_id", "text"])
                db.register("batch", rows)
                yield from db.sql(sql).to_arrow_table().cast(target).to_batches()
                db.unregister("batch")
        db.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    types = {"doc_id": kind, "n": "bigint", "prefix_chars": "bigint", "middle_chars": "bigint"}
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    target = pa.schema([(x, arrow[types.get(x, "string")]) for x in names])
    return docs.select("doc_id", "text").mapInArrow(transform, ", ".join(f"{x} {types.get(x, 'string')}" for x in names))
