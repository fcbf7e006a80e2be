"""Registered queries of code that moved: sequences found again, before and after counts, closures, consolidations, lineages, matchings; each with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, text
from ..operators import moves
from . import generated
from .catalog import _CLONE_TOKENS, query, table

_DOCS = f"t AS (SELECT doc_id, {_CLONE_TOKENS} AS w FROM documents)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clone_tokens(F.col("text")).alias("w"))


def _cut(first: Column, size: Column) -> Column:
    return F.slice("w", first.cast("int"), F.greatest(size, F.lit(0)).cast("int"))


@query(f"""WITH {_DOCS}, p AS (SELECT doc_id, w[(doc_id % 9 + 1)::INT:(doc_id % 9 + 5 + doc_id % 36)::INT] AS p FROM t WHERE len(w) >= 60),
q AS (SELECT DISTINCT p, len(p) AS n, array_to_string(p[:5], chr(31)) AS h FROM p),
f AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, array_to_string(w[unnest(range(1, len(w) - 3)):unnest(range(1, len(w) - 3)) + 4], chr(31)) AS h FROM t),
x AS (SELECT q.p, f.doc_id FROM f JOIN q USING (h) JOIN t ON t.doc_id = f.doc_id WHERE t.w[f.i:f.i + q.n - 1] = q.p)
SELECT p.doc_id, count(*) AS n_places, count(DISTINCT x.doc_id) AS n_documents FROM p JOIN x USING (p) GROUP BY p.doc_id""")
def sequence_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many places and documents each document's cut of 5 to 40 tokens stands; equal cuts are looked for once."""
    d, k = _tokens(spark, sf_dir), F.col("doc_id")
    cuts = d.where(F.size("w") >= 60).select("doc_id", moves.sequence_key(_cut(k % 9 + 1, k % 36 + 5)).alias("key")).withColumn("cut", F.struct("key.n", "key.sha256"))
    found = moves.find_sequences(d.select(k.alias("block"), "w"), cuts.select("key", "cut").distinct(), tokens="w")
    places = found.groupBy("cut").agg(F.count("*").alias("n_places"), F.count_distinct("block").alias("n_documents"))
    return cuts.select("doc_id", "cut").join(places, "cut").select("doc_id", "n_places", "n_documents")


_STANDS = "len(list_filter(range(1, len({0}) - len({1}) + 2), lambda i: {0}[i:i + len({1}) - 1] = {1}))"


@query(f"""WITH {_DOCS}, b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN [] ELSE w[(doc_id % 7 + 1)::INT:(doc_id % 7 + 3 + doc_id % 40)::INT] END AS body,
unnest([w[:(doc_id % 7 + doc_id % 13)::INT], list_reverse(w[:60]), w[(doc_id % 3 + 1)::INT:(doc_id % 3 + 80)::INT], CASE WHEN doc_id % 5 = 0 THEN w ELSE [] END]) AS blk, unnest([1, 2, 3, 4]) AS k FROM t)
SELECT doc_id AS target, min(k) FILTER (CASE WHEN len(body) = 0 THEN len(blk) > 0 ELSE {_STANDS.format("blk", "body")} > 0 END)::INT AS block_index FROM b GROUP BY doc_id""")
def relocated_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = _tokens(spark, sf_dir), F.col("doc_id")
    none = F.array().cast("array<string>")
    frozen = d.select(k.alias("target"), moves.sequence_key(F.when(k % 11 == 0, none).otherwise(_cut(k % 7 + 1, k % 40 + 3))).alias("key"))
    blocks = F.array(_cut(F.lit(1), k % 7 + k % 13), F.reverse(_cut(F.lit(1), F.lit(60))), _cut(k % 3 + 1, F.lit(80)), F.when(k % 5 == 0, F.col("w")).otherwise(none))
    added = d.select(k.alias("target"), F.posexplode(blocks).alias("i", "tokens")).select("target", (F.col("i") + 1).alias("block_index"), "tokens")
    return moves.relocated_bodies(frozen, added)


@query(f"""WITH {_DOCS}, x AS (SELECT doc_id AS "case", w[5:(8 + doc_id % 8)::INT] AS p, w[:60] AS a0, w[61:100] AS b0, w[:4] || w[17:60] AS a1, w[61:100] AS b1, CASE doc_id % 3 WHEN 0 THEN w[5:(8 + doc_id % 8)::INT] WHEN 1 THEN [] ELSE w[5:(8 + doc_id % 8)::INT] || ['('] || w[5:(8 + doc_id % 8)::INT] END AS c1 FROM t WHERE len(w) >= 20),
y AS (SELECT "case", {_STANDS.format("a0", "p")} AS s0, {_STANDS.format("b0", "p")} AS o0, {_STANDS.format("a1", "p")} AS s1, {_STANDS.format("b1", "p")} + {_STANDS.format("c1", "p")} AS o1 FROM x)
SELECT "case", s0::BIGINT AS source_before, o0::BIGINT AS outside_before, s1::BIGINT AS source_after, o1::BIGINT AS outside_after, s1 < s0 AND o1 > o0 AND s1 + o1 >= least(s0 + o0, 1) AS extracted FROM y""")
def extracted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = _tokens(spark, sf_dir).where(F.size("w") >= 20), F.col("doc_id")
    window = _cut(F.lit(5), k % 8 + 4)
    rest, none = F.slice("w", 61, 40), F.array().cast("array<string>")
    again = F.when(k % 3 == 0, window).when(k % 3 == 1, none).otherwise(F.concat(window, F.array(F.lit("(")), window))
    unit = lambda name, tokens: F.struct(F.lit(name).alias("unit"), tokens.alias("tokens"))
    texts = lambda *units: d.select(k.alias("case"), F.explode(F.array(*units)).alias("u")).select("case", "u.*")
    windows = d.select(k.alias("case"), F.lit(1).alias("window"), F.lit("a").alias("source"), moves.sequence_key(window).alias("key"))
    out = moves.occurrence_balance(windows, texts(unit("a", F.slice("w", 1, 60)), unit("b", rest)), texts(unit("a", F.concat(F.slice("w", 1, 4), F.slice("w", 17, 44))), unit("b", rest), unit("c", again)))
    return out.drop("window")


_SHAPES = f"WITH {generated.SHAPES_SQL}"


@query(f"""{_SHAPES} SELECT o AS "case", 'A' AS file, 10 AS "begin", 12 AS "end", '0' AS targets FROM s UNION ALL SELECT o, 'B', 20 + n % 3, 22 + n % 3, CASE WHEN n % 3 = 0 THEN '1' ELSE '' END FROM s
UNION ALL SELECT o, 'C', 4 * i + 1, 4 * i + 3, '' FROM (SELECT o, unnest(range(r))::INT AS i FROM s)""")
def removed_clone_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = generated.order_shapes(spark, sf_dir)
    k = F.concat(F.lit("k"), (F.col("o") % 50).cast("string"))
    whole = F.concat(F.lit("int f(int a) {\n  return a + "), k, F.lit("; // same\n}"))
    spread = F.concat(F.lit("int f( int a )\n{ return a /* x */ +  "), k, F.lit(";\n}"))
    filler = F.lit("int unlike(int b);\n#define X(a) (a)\n")
    removed = F.array(
        F.struct(F.lit("A").alias("file"), F.lit(8).alias("first_line"), F.concat(filler, whole).alias("text")), F.struct(F.lit("B").alias("file"), (F.col("n") % 3 + 20).alias("first_line"), spread.alias("text")),
        F.struct(F.lit("C").alias("file"), F.lit(1).alias("first_line"), F.repeat(F.concat(whole, F.lit("\n\n")), F.col("r")).alias("text")),
    )
    tokens = code.clone_tokens_with_lines(F.col("x.text"), F.lit("c"))
    blocks = s.select(F.col("o").alias("case"), F.explode(removed).alias("x")).select("case", "x.file", "x.first_line", tokens.alias("tokens"))
    ends = F.array(F.struct(F.lit(0).alias("target"), F.lit("A").alias("file"), F.lit(10).alias("begin"), F.lit(12).alias("end")), F.struct(F.lit(1).alias("target"), F.lit("B").alias("file"), F.lit(20).alias("begin"), F.lit(22).alias("end")))
    frozen = s.select(F.col("o").alias("case"), F.explode(ends).alias("e"), moves.sequence_key(text.clone_tokens(whole, F.lit("c"))).alias("key")).select("case", "e.*", "key")
    return moves.removed_occurrences(frozen, blocks).select("case", "file", "begin", "end", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"))


@query(f"""{_SHAPES}, x AS (SELECT o, n, r, d, CASE WHEN o % 13 = 0 THEN 1 WHEN o % 29 = 0 THEN 3 ELSE 2 END AS ends, o % 19 = 0 AS differ, o % 23 = 0 AS hollow, n % 4 <> 0 AS keep0, r > 2 AS keep1, d = 3 AS changed, o % 3 <> 0 AS del, (n % 4 = 0)::INT + (o % 31 = 0)::INT AS added FROM s),
y AS (SELECT *, keep0::INT + (ends > 1 AND keep1)::INT AS kept, ends - keep0::INT - (ends > 1 AND keep1)::INT AS gone FROM x),
z AS (SELECT *, CASE WHEN ends <> 2 THEN 'baseline_target_anchors_unavailable' WHEN hollow OR differ THEN 'clone_endpoints_are_not_one_declaration_contract' WHEN gone = 0 THEN 'clone_endpoints_not_consolidated' WHEN kept > 0 AND changed THEN 'retained_clone_endpoint_changed' WHEN NOT del THEN 'clone_endpoint_deletion_unverified' WHEN kept + added <> 1 THEN 'clone_consolidation_implementation_count_invalid' ELSE 'CLONE_ENDPOINTS_CONSOLIDATED' END AS reason FROM y)
SELECT o AS "case", reason = 'CLONE_ENDPOINTS_CONSOLIDATED' AS ok, reason, kept + added AS implementations, array_to_string(list_filter([CASE WHEN keep0 THEN 0 END, CASE WHEN ends > 1 AND keep1 THEN 1 END], lambda v: v IS NOT NULL), ',') AS retained FROM z""")
def clone_consolidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, o = generated.order_shapes(spark, sf_dir), F.col("o")
    n_ends = F.when(o % 13 == 0, 1).when(o % 29 == 0, 3).otherwise(2)
    ends = s.select("*", F.explode(F.sequence(F.lit(0), n_ends - 1)).alias("target"))
    h = lambda name: F.concat(F.lit(name), (o % 100).cast("string"))
    shape = {"identity": h("i"), "signature": h("s"), "body": F.when(o % 23 == 0, "").otherwise(h("b")), "complete": h("c"), "n_body": F.lit(9), "n_complete": F.lit(14)}
    columns = [v.alias(k) for k, v in shape.items() if k != "identity"]
    baseline = ends.select(o.alias("case"), "target", F.when((o % 19 == 0) & (F.col("target") == 1), "other").otherwise(shape["identity"]).alias("identity"), *columns)
    kept = F.when(F.col("target") == 0, F.col("n") % 4 != 0).when(F.col("target") == 1, F.col("r") > 2).otherwise(False)
    now = ends.select(o.alias("case"), "target", kept.alias("resolved"), F.when((o % 19 == 0) & (F.col("target") == 1), "other").otherwise(shape["identity"]).alias("identity"), "d", *columns)
    now = now.withColumn("signature", F.when(F.col("d") == 3, "changed").otherwise(F.col("signature"))).drop("d")
    deleted = ends.select(o.alias("case"), "target", (o % 3 != 0).alias("deleted")).where("deleted")
    copies = F.when(F.col("n") % 4 == 0, 1).otherwise(0) + F.when(o % 31 == 0, 1).otherwise(0)
    added = s.where(copies > 0).select("*", F.explode(F.sequence(F.lit(1), copies))).select(o.alias("case"), shape["identity"].alias("identity"), *columns)
    added = added.unionByName(added.withColumn("complete", F.lit("unlike")))
    return moves.consolidation(baseline, now, deleted, added).select("case", "ok", "reason", F.col("implementations").cast("int").alias("implementations"), F.array_join(F.col("retained").cast("array<string>"), ",").alias("retained"))


@query(f"""{_SHAPES}, x AS (SELECT o, n, r, d, CASE WHEN o % 7 = 0 THEN 2 WHEN o % 11 = 0 THEN 0 ELSE 1 END AS cur, o % 5 <> 0 AS res, d = 0 AS has, n % 3 <> 0 AS newsig, o % 13 = 0 AS own, o % 17 = 0 AS fil, o % 2 = 0 AS tou, o % 3 = 0 AS anch, o % 4 = 0 AS free, r > 0 AS rep, (o // 10) AS grp FROM s),
y AS (SELECT *, cur > 0 AND res AND NOT has AND newsig AS strict FROM x),
z AS (SELECT *, CASE WHEN cur > 1 THEN 'current_target_index_not_unique' WHEN NOT strict THEN '' WHEN own THEN 'migration_successor_owner_changed' WHEN fil THEN 'migration_successor_file_changed' WHEN NOT tou THEN 'migration_declaration_not_edited' WHEN anch THEN '' WHEN free THEN 'migration_free_function_successor_not_strictly_anchored' WHEN NOT rep THEN 'migration_successor_not_same_unique_hunk' ELSE '' END AS reason FROM y),
m AS (SELECT *, reason = '' AND strict AS moved FROM z), p AS (SELECT grp, free, fil, d, count(*) AS preds FROM m WHERE moved GROUP BY ALL)
SELECT m.grp AS "case", m.o AS target, CASE WHEN reason <> '' THEN 'rejected' WHEN moved THEN 'api_abi_migration' ELSE 'strict_identity' END AS mode, CASE WHEN moved THEN CASE WHEN preds > 1 THEN 'many_to_one' ELSE 'one_to_one' END END AS relation, CASE WHEN moved THEN CASE WHEN anch THEN 'strict_patch_anchor_with_changed_signature' ELSE 'same_hunk_identity_replacement' END END AS witness, reason
FROM m LEFT JOIN p ON p.grp = m.grp AND p.free = m.free AND p.fil = m.fil AND p.d = m.d""")
def declaration_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, o = generated.order_shapes(spark, sf_dir), F.col("o")
    rows = s.withColumns({"case": F.expr("o div 10"), "target": o, "owner_": F.when(o % 4 == 0, "").otherwise("Own"), "name_": F.lit("f")})
    frozen = rows.select("case", "target", F.lit("a.c").alias("file"), F.lit(5).alias("line"), F.col("owner_").alias("owner"), F.col("name_").alias("name"), F.lit("f(int a, int b)").alias("signature"), (o % 3 == 0).alias("anchored"))
    copies = F.when(o % 7 == 0, 2).when(o % 11 == 0, 0).otherwise(1)
    now = rows.where(copies > 0).select("*", F.explode(F.sequence(F.lit(1), copies)))
    now = now.select("case", "target", F.when(o % 17 == 0, "b.c").otherwise("a.c").alias("file"), (F.col("d") + 6).alias("line"), F.when(o % 13 == 0, "Else").otherwise(F.col("owner_")).alias("owner"), F.col("name_").alias("name"), F.when(F.col("n") % 3 == 0, "f(int a, int b)").otherwise("f(Pair p)").alias("signature"), (F.col("d") == 0).alias("has_group"), (o % 5 != 0).alias("resolved"))
    return moves.declaration_lineage(frozen, now, rows.where(o % 2 == 0).select("case", "target"), rows.where("r > 0").select("case", "target"))


_PAIRED = """o AS (SELECT p_partkey AS id, 'f' || (p_partkey % 20) AS file, 'n' || (p_partkey % 60) AS name, 's' || (p_partkey % 35) AS sig, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'b' || p_partkey END AS body FROM part),
w AS (SELECT id, file, CASE WHEN id % 3 = 0 THEN 'm' || id ELSE name END AS name, CASE WHEN id % 5 = 0 THEN 'z' || id ELSE sig END AS sig, CASE WHEN id % 7 = 0 THEN NULL ELSE body END AS body FROM o WHERE id % 9 <> 0)"""


def _round(k: int, left: str) -> str:
    return f"""r{k} AS (SELECT *, max(score) OVER (PARTITION BY a) AS ma, max(score) OVER (PARTITION BY b) AS mb FROM {left}), c{k} AS (SELECT *, count_if(score = ma) OVER (PARTITION BY a) AS ca, count_if(score = mb) OVER (PARTITION BY b) AS cb FROM r{k}),
m{k} AS (SELECT a, b, score, {k} AS round FROM c{k} WHERE score = ma AND score = mb AND ca = 1 AND cb = 1), l{k} AS (SELECT a, b, score FROM {left} WHERE a NOT IN (SELECT a FROM m{k}) AND b NOT IN (SELECT b FROM m{k}))"""


@query(f"""WITH {_PAIRED}, pr AS (SELECT o.id AS a, w.id AS b, coalesce(o.name = w.name, false)::INT + coalesce(o.sig = w.sig, false)::INT + coalesce(o.body = w.body, false)::INT AS score FROM o JOIN w USING (file)), l0 AS (SELECT * FROM pr WHERE score > 0),
{_round(1, "l0")}, {_round(2, "l1")}, {_round(3, "l2")}, m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)
SELECT o.id AS old, m.b AS new, m.score::BIGINT AS score, m.round, CASE WHEN m.b IS NOT NULL THEN 'matched' WHEN o.id IN (SELECT a FROM l3) THEN 'ambiguous' ELSE 'unmatched' END AS status FROM o LEFT JOIN m ON m.a = o.id""")
def matched_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    named = lambda c, m: F.concat(F.lit(c), (k % m).cast("string"))
    old = table(spark, sf_dir, "part").select(k.alias("id"), named("f", 20).alias("file"), named("n", 60).alias("name"), named("s", 35).alias("sig"), F.when(k % 4 != 0, F.concat(F.lit("b"), k.cast("string"))).alias("body"))
    i = F.col("id")
    fresh = lambda c: F.concat(F.lit(c), i.cast("string"))
    new = old.where(i % 9 != 0).select("id", "file", F.when(i % 3 == 0, fresh("m")).otherwise(F.col("name")).alias("name"), F.when(i % 5 == 0, fresh("z")).otherwise(F.col("sig")).alias("sig"), F.when(i % 7 != 0, F.col("body")).alias("body"))
    return moves.match_declarations(old, new, ["file"], ["name", "sig", "body"], rounds=3)


@query("""WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'f' || (l_orderkey % 97) AS file, 'm' || l_linenumber AS name, 'x' || (min(l_partkey) % 211) AS lineage FROM lineitem GROUP BY l_orderkey, l_linenumber), a AS (SELECT id + 1000000000 AS id, CASE WHEN id % 5 = 0 THEN 'g' || (id % 7) ELSE file END AS file, name, CASE WHEN id % 17 = 0 THEN '' ELSE lineage END AS lineage FROM b WHERE id % 11 <> 0),
bn AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY id) AS k FROM b), an AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY id) AS k FROM a),
g AS (SELECT id, nullif(lineage, '') AS lineage, row_number() OVER (PARTITION BY lineage ORDER BY id) AS r FROM bn WHERE (file, name, k) NOT IN (SELECT (file, name, k) FROM an)), c AS (SELECT id, nullif(lineage, '') AS lineage, row_number() OVER (PARTITION BY lineage ORDER BY id) AS r FROM an WHERE (file, name, k) NOT IN (SELECT (file, name, k) FROM bn))
SELECT g.id AS gone, c.id AS came, coalesce(g.lineage, c.lineage) AS lineage FROM g FULL JOIN c ON g.lineage = c.lineage AND g.r = c.r""")
def moved_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    b = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("f"), (F.col("l_orderkey") % 97).cast("string")).alias("file"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("name"), F.concat(F.lit("x"), (F.col("l_partkey") % 211).cast("string")).alias("lineage"))
    i = F.col("id")
    a = b.where(i % 11 != 0).select((i + 1000000000).alias("id"), F.when(i % 5 == 0, F.concat(F.lit("g"), (i % 7).cast("string"))).otherwise(F.col("file")).alias("file"), "name", F.when(i % 17 == 0, "").otherwise(F.col("lineage")).alias("lineage"))
    return moves.moved_entities(b, a, ["file", "name"], "lineage", ["id"])
