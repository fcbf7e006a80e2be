"""Queries of the operators that are DataFrame functions throughout, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_overlaps
from .exact import batch_bytes, exact_dedup
from .licenses import COSINE_SQUARED, TEMPLATES, scan_lines, scan_licenses
from .lines import LONG, RUN, dedup_lines
from .mix import MAX_EPOCHS, SCHEDULES, WEIGHTS, plan_mix
from .shard import shard_documents


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM documents),
b AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM benchmark),
dt AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS p FROM d),
bt AS (SELECT item_id, len(t) AS n, unnest(t) AS tok, generate_subscripts(t, 1) AS q FROM b),
eq AS (SELECT doc_id, item_id, n, p - q AS d, q FROM dt JOIN bt USING (tok)),
few AS (SELECT *, least(n, 20) AS w FROM eq QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, d) >= ceil(least(n, 20) * 0.8::DOUBLE)),
m AS (SELECT doc_id, item_id, n, w, count(*) OVER (PARTITION BY doc_id, item_id, d ORDER BY q RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS c FROM few)
SELECT doc_id, item_id, max(n)::BIGINT AS n_item, max(w)::BIGINT AS "window", max(c)::BIGINT AS matched, max(c)::DOUBLE / max(w)::DOUBLE AS similarity
FROM m GROUP BY doc_id, item_id HAVING max(c) >= ceil(max(w) * 0.8::DOUBLE)
"""


def document_path() -> F.Column:
    """documents as a tree of files: source/lang/ and a directory for each digit of doc_id but the last, which is the name."""
    digits = F.regexp_replace(F.col("doc_id").cast("string"), r"(\d)(?=\d)", "$1/")
    return F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), digits)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By single lines, as its SQL fixes it; op3_license_texts runs the whole method."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", document_path().alias("path"), "text")
    return scan_licenses(docs, TEMPLATES, scan_lines).select("doc_id", "path", "license", "how", "cosine", "from_dir")


def op3_license_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files, headers, paragraphs, sentences and lines against sentences, notices and texts of licenses."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", document_path().alias("path"), "text")
    return scan_licenses(docs).select("doc_id", "path", "license", "how", "unit", "cosine", "from_dir")


def _op3_sql() -> str:
    rows = ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in sorted(TEMPLATES.items()))
    terms = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: x <> ''))"
    num, den = COSINE_SQUARED
    return f"""
WITH t AS (SELECT license, unnest({terms.format("template")}) AS term FROM (VALUES {rows}) v(license, template)),
f AS (SELECT doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || regexp_replace(array_to_string(string_split(doc_id::VARCHAR, ''), '/'), '^/|/$', '', 'g') AS path, text FROM documents),
n AS (SELECT count(*)::DOUBLE AS n FROM f),
vocab AS (SELECT DISTINCT term FROM t),
seen AS (SELECT term, count(*) AS df FROM (SELECT unnest({terms.format("text")}) AS term FROM f) JOIN vocab USING (term) GROUP BY term),
w AS (SELECT term, round(1000.0::DOUBLE * (1.0::DOUBLE + ln((1.0 + n) / (1.0 + coalesce(df, 0)::DOUBLE))))::BIGINT AS w FROM vocab LEFT JOIN seen USING (term), n),
u AS (SELECT round(1000.0::DOUBLE * (1.0::DOUBLE + ln((1.0 + n) / (1.0 + 0::DOUBLE))))::BIGINT AS w FROM n),
tw AS (SELECT license, term, w FROM t JOIN w USING (term)),
tn AS (SELECT license, sum(w * w)::BIGINT AS t_norm FROM tw GROUP BY license),
l AS (SELECT path, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM f),
lt AS (SELECT path, line, unnest({terms.format("content")}) AS term FROM l),
ln_ AS (SELECT path, line, sum(coalesce(w.w * w.w, u.w * u.w))::BIGINT AS norm FROM lt LEFT JOIN w USING (term), u GROUP BY ALL),
dot AS (SELECT path, line, license, sum(w * w)::BIGINT AS dot FROM lt JOIN tw USING (term) GROUP BY ALL),
sq AS (SELECT path, line, license, dot::DOUBLE * dot::DOUBLE / (norm::DOUBLE * t_norm::DOUBLE) AS square FROM dot JOIN ln_ USING (path, line) JOIN tn USING (license)),
own AS (SELECT path, license, sqrt(square) AS cosine FROM sq WHERE square * {den} >= {num} QUALIFY row_number() OVER (PARTITION BY path ORDER BY square DESC, line, license) = 1),
holds AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, arg_min(license, path) AS dir_license FROM own GROUP BY 1),
dirs AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS own_dir FROM f),
near AS (SELECT own_dir, arg_max(dir, length(dir)) AS dir, arg_max(dir_license, length(dir)) AS lic FROM dirs JOIN holds ON own_dir = dir OR starts_with(own_dir, dir || '/') GROUP BY own_dir)
SELECT doc_id, path, coalesce(own.license, lic) AS license, CASE WHEN own.license IS NOT NULL THEN 'header' WHEN lic IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, cosine, CASE WHEN own.license IS NULL THEN dir END AS from_dir
FROM f LEFT JOIN own USING (path) LEFT JOIN near ON regexp_replace(path, '/[^/]*$', '') = own_dir
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    return exact_dedup(spark, path, max_bytes=batch_bytes(spark, path))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256 FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
w AS (SELECT doc_id, p, line, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING) AS win, count(*) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING) AS n FROM l),
r AS (SELECT *, n = {RUN} AND row_number() OVER (PARTITION BY win, n ORDER BY doc_id, p) > 1 AS again, strlen(line) >= {LONG} AND row_number() OVER (PARTITION BY line ORDER BY doc_id, p) > 1 AS alone FROM w),
g AS (SELECT doc_id, p, line, alone OR bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {RUN - 1} PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM g)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_removed, count_if(starts)::BIGINT AS n_runs, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM s GROUP BY doc_id
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _crc(byte: int) -> int:
    for _ in range(8):
        byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def _op9_sql() -> str:
    """CRC-32 by its table, byte for byte; the largest of ln(u) for each shard; slots by the whole order."""
    table = ", ".join(f"{_crc(i)}::BIGINT" for i in range(256))
    score = "list_transform(range({0}), lambda i: ln((('0x' || substr(md5(doc_id::VARCHAR || ':' || i), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE))"
    return f"""
WITH b AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, [{table}][(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32, {score.format(8)} AS s, {score.format(9)} AS t FROM b),
h AS (SELECT *, (list_position(s, list_max(s)) - 1)::INT AS shard, (list_position(t, list_max(t)) - 1)::INT AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id::VARCHAR), doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM h
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


def _positions_sql() -> str:
    """pos: z with the position of its share, by inverting the integral of the knots."""
    knots = ", ".join(f"({law}, {i}, {t}::DOUBLE, {w}::DOUBLE)" for law, s in enumerate(SCHEDULES) for i, (t, w) in enumerate(s))
    return f"""kn AS (SELECT *, lead(t) OVER law AS t1, lead(w) OVER law AS w1 FROM (VALUES {knots}) v(law, i, t, w) WINDOW law AS (PARTITION BY law ORDER BY i)),
ar AS (SELECT *, (t1 - t) * (w + w1) / 2 AS area FROM kn WHERE t1 IS NOT NULL),
tt AS (SELECT *, sum(area) OVER (PARTITION BY law) AS total FROM ar),
pc AS (SELECT law, i, t AS t0, t1, w / total AS w0, (w1 - w) / (t1 - t) / total AS slope, coalesce(sum(area / total) OVER (PARTITION BY law ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM tt),
pn AS (SELECT *, lead(done) OVER (PARTITION BY law ORDER BY i) AS next_done FROM pc),
pos AS (SELECT z.*, least(t0 + CASE WHEN share > done THEN 2 * (share - done) / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * (share - done), 0))) ELSE 0 END, t1) AS position
  FROM z JOIN pn ON law = rank % {len(SCHEDULES)} AND share >= done AND (next_done IS NULL OR share < next_done))"""


def _op10_sql() -> str:
    w = ", ".join(f"{x}::DOUBLE" for x in WEIGHTS)
    m = MAX_EPOCHS
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
c AS (SELECT *, [{w}][(rank % {len(WEIGHTS)}) + 1] AS weight, (source_size * {m})::DOUBLE AS cap FROM s),
o AS (SELECT *, cap / weight AS ratio, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE weight * (SELECT arg_min(level, ratio) FROM o WHERE ratio > level) END AS target FROM o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {m})::BIGINT ELSE 0 END AS passes FROM t),
p AS (SELECT d.doc_id, d.source, d.size, d.h, source_size, target, passes, CASE WHEN source_size > 0 THEN target - passes * source_size ELSE 0 END AS rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
q AS (SELECT *, size > 0 AND passes < {m} AND begins + size <= rest AS part FROM p),
g AS (SELECT *, rest - coalesce(sum(size) FILTER (part) OVER (PARTITION BY source), 0) AS gap FROM q),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (part OR size = 0 OR passes >= {m} OR abs(size - gap) >= gap), abs(size - gap), begins) = 1 AND NOT (part OR size = 0 OR passes >= {m} OR abs(size - gap) >= gap) AS fills FROM g),
k AS (SELECT *, CASE WHEN size > 0 THEN passes + (part OR fills)::INT ELSE 0 END::INT AS copies FROM f),
x AS (SELECT k.*, s.rank, coalesce(sum(k.size) FILTER (part) OVER (PARTITION BY k.source), 0)::BIGINT AS got FROM k JOIN s ON k.source IS NOT DISTINCT FROM s.source),
y AS (SELECT *, 0 AS pass, 'first_position' AS what FROM x WHERE copies > 0 UNION ALL SELECT *, copies - 1, 'last_position' FROM x WHERE copies > 0),
z AS (SELECT *, least(((pass * source_size + CASE WHEN fills AND pass = passes THEN got ELSE begins END)::DOUBLE + size::DOUBLE / 2) / target, 1) AS share FROM y),
{_positions_sql()}
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies, max(position) FILTER (what = 'first_position') AS first_position, max(position) FILTER (what = 'last_position') AS last_position FROM x LEFT JOIN (SELECT doc_id, what, position FROM pos) USING (doc_id) GROUP BY ALL
"""


QUERIES = {"op2_decontamination": op2_decontamination, "op3_license_scan": op3_license_scan, "op3_license_texts": op3_license_texts, "op4_exact_dedup": op4_exact_dedup, "op6_line_dedup": op6_line_dedup, "op9_sharding": op9_sharding, "op10_mixing": op10_mixing}
SQL = {"op2_decontamination": OP2_SQL, "op3_license_scan": _op3_sql(), "op4_exact_dedup": OP4_SQL, "op6_line_dedup": OP6_SQL, "op9_sharding": _op9_sql(), "op10_mixing": _op10_sql()}
