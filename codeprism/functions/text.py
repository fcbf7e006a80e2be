"""Text, token and hash columns. All are built-in expressions: they run in the JVM, next to the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token grammar, extensions, sizes of sketches, separators.
SPACE = r"[\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]"
LANGUAGES = {".py": "python", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".java": "java"}
SKETCH = 64
SHINGLE = 5


def language_of(path: Column) -> Column:
    """Language by file extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def strip_brace_comments(text: Column) -> Column:
    """Without /* */ and // comments; strings are not looked at."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


def strip_hash_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"#[^\n]*", "")


def strip_comments(text: Column, language: Column) -> Column:
    return F.when(language == "python", strip_hash_comments(text)).otherwise(strip_brace_comments(text))


def count_meaningful_lines(stripped: Column) -> Column:
    """Lines with anything but white space."""
    return F.size(F.filter(F.split(stripped, r"\r\n|[\n\r\x0B\x0C]"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")


def normalize_for_clone(text: Column, language: Column | None = None) -> Column:
    """The text without comments (of its language, if one is given) and without any white space."""
    plain = F.coalesce(text, F.lit(""))
    return F.regexp_replace(plain if language is None else strip_comments(plain, language), SPACE, "")


def clone_tokens(text: Column, language: Column | None = None) -> Column:
    """Tokens of the normalised text."""
    return F.regexp_extract_all(normalize_for_clone(text, language), F.lit(TOKEN), F.lit(0))


def lexical_tokens(text: Column) -> Column:
    """Tokens of the text as it stands."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def fingerprint(tokens: Column) -> Column:
    """SHA-256 of the tokens, parted by U+001F; of none: the empty string."""
    return F.when(F.size(tokens) > 0, F.sha2(F.concat_ws("\x1f", tokens), 256)).otherwise("")


def shingle_hashes(tokens: Column, k: int = SHINGLE) -> Column:
    """Distinct 16-digit hashes of k tokens in a row."""
    some = F.transform(F.sequence(F.lit(1), F.size(tokens) - (k - 1)), lambda i: F.substring(F.sha2(F.concat_ws("\x1f", F.slice(tokens, i, F.lit(k))), 256), 1, 16))
    return F.array_distinct(F.when(F.size(tokens) >= k, some).otherwise(F.array().cast("array<string>")))


def sketch(tokens: Column) -> Column:
    """The 64 smallest shingle hashes."""
    return F.slice(F.array_sort(shingle_hashes(tokens)), 1, SKETCH)


def normalize_path(path: Column) -> Column:
    """Forward slashes, no leading dots and slashes, lower case."""
    return F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", ""))


def normalize_method(method: Column) -> Column:
    """The name before the parameter list, without its qualification, in lower case."""
    return F.lower(F.element_at(F.split(F.trim(F.substring_index(method, "(", 1)), r"[.#\s]+"), -1))


def evidence_value(evidence: Column, key: str) -> Column:
    """The value of key in `k=v; k=v` text; null if absent or empty."""
    return F.nullif(F.trim(F.regexp_extract(evidence, rf"(?i)(?:^|;\s*){key}=([^;]+)", 1)), F.lit(""))


def split_group(group: Column) -> Column:
    return F.split(group, r"(?<!\s)\|(?!\s)")
