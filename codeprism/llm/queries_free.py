"""Queries of the operators that use Arrow batches where DataFrame functions don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import digest_documents
from .collocations import mine_phrases
from .fim import fill_in_middle
from .hyperminhash import near_duplicates
from .suffix import remove_passages
from .toxicity import score_documents
from .warc import archive_pages


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every pair of documents with a common shingle, counted on whole sets; components by reachability.
OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = n.doc_id
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: Base 32 of a hexadecimal digest: five hexadecimal digits are four characters.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to FROM g
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows of 50 bytes as 100 hexadecimal digits, cut from blocks of 500 bytes (and 49 more) of each text.
OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT doc_id, unnest(range(0, greatest(len(x) // 2 - 49, 0), 500)) AS lo, x FROM d),
c AS (SELECT doc_id, lo, substr(x, 2 * lo + 1, 1098) AS x FROM k),
w AS (SELECT doc_id, lo + unnest(range(0, least(len(x) // 2 - 49, 500))) AS p, substr(x, 2 * unnest(range(0, least(len(x) // 2 - 49, 500))) + 1, 100) AS g FROM c),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) < doc_id AS late FROM w),
i AS (SELECT doc_id, p, coalesce(p > lag(p) OVER o + 50, true)::INT AS fresh FROM f WHERE late WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
j AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM i),
s AS (SELECT doc_id, min(p) AS b, max(p) + 50 AS e FROM j GROUP BY doc_id, s),
g AS (SELECT doc_id, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS z FROM s),
h AS (SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS e, string_agg(substr(x, 2 * z + 1, 2 * (b - z)), '' ORDER BY b) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN e IS NULL THEN x ELSE kept || substr(x, 2 * e + 1) END)) AS kept_sha256
FROM d LEFT JOIN h USING (doc_id)
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


#: Lines by splitting at line ends; the places of the cuts in code points.
OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS p, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
e AS (SELECT *, CASE WHEN t = '' THEN [] WHEN p[-1] = '' THEN list_transform(p[:-2], lambda x: length(x) + 1) ELSE list_transform(p, lambda x, i: length(x) + CASE WHEN i < len(p) THEN 1 ELSE 0 END) END AS s FROM d),
c AS (SELECT *, len(s) AS n, ('0x' || h[1:8])::BIGINT % (len(s) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(s) + 1) AS y,
  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e),
k AS (SELECT *, coalesce(list_sum(s[:least(x, y)]), 0)::BIGINT AS a, coalesce(list_sum(s[:greatest(x, y)]), 0)::BIGINT AS b FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(t) AS restored_sha256,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a) ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256 FROM k
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) v(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
x AS (SELECT lang, k, phrase, f, unnest(range(1, k)) AS cut, w FROM c),
s AS (SELECT x.*, a.f AS l, b.f AS r, (1000000::HUGEINT * x.f * x.f) // (a.f::HUGEINT * b.f) AS score FROM x JOIN f a ON a.lang = x.lang AND a.phrase = array_to_string(x.w[:cut], ' ') JOIN f b ON b.lang = x.lang AND b.phrase = array_to_string(x.w[cut + 1:], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
z AS (SELECT m.lang, m.phrase, m.f AS a, l, r, score FROM m LEFT JOIN o ON o.lang = m.lang AND o.phrase = m.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * m.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM z JOIN t USING (lang) QUALIFY rank <= 2000
"""

#: Rank file of the vocabulary that op13 uses; the package has its place on every machine.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))


QUERIES = {"op1_toxicity": op1_toxicity, "op5_warc": op5_warc, "op7_minhash": op7_minhash, "op8_suffix_dedup": op8_suffix_dedup, "op11_fill_in_middle": op11_fill_in_middle, "op12_collocations": op12_collocations, "op13_bpe": op13_bpe}
SQL = {"op5_warc": OP5_SQL, "op7_minhash": OP7_SQL, "op8_suffix_dedup": OP8_SQL, "op11_fill_in_middle": OP11_SQL, "op12_collocations": OP12_SQL}
