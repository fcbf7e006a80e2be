"""The registered queries of the code-quality engine over the driver's tables, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import clones, ranking, relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "exact_clone_groups"

_WS = r"[\x20\x09-\x0D]+"
_TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]"
_CLONE_TOKENS = rf"regexp_extract_all(regexp_replace(coalesce(text, ''), '{_WS}', '', 'g'), '{_TOK}')"
_LEXICAL = rf"regexp_extract_all(coalesce(text, ''), '{_TOK}')"
_PRINTS = f"SELECT doc_id, len(t)::BIGINT AS n_tokens, CASE WHEN len(t) > 0 THEN sha256(array_to_string(t, chr(31))) ELSE '' END AS fingerprint FROM (SELECT doc_id, {_CLONE_TOKENS} AS t FROM documents)"


def query(sql: str):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""SELECT doc_id,
  len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g'), '\r\n|[\n\r\x0B\x0C]'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS brace_lines,
  len(list_filter(regexp_split_to_array(regexp_replace(text, '#[^\n]*', '', 'g'), '\r\n|[\n\r\x0B\x0C]'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS hash_lines FROM documents""")
def text_meaningful_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.count_meaningful_lines(text.strip_brace_comments(t)).alias("brace_lines"), text.count_meaningful_lines(text.strip_hash_comments(t)).alias("hash_lines"))


@query(_PRINTS)
def text_tokens_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT fingerprint, count(*) AS n_members, min(doc_id) AS first_member, max(doc_id) AS last_member, max(n_tokens) AS n_tokens FROM ({_PRINTS}) WHERE fingerprint <> '' GROUP BY fingerprint HAVING count(*) > 1")
def exact_clone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.clone_groups(text_tokens_fingerprint(spark, sf_dir), "doc_id")


@query(f"SELECT a, doc_id AS b, n_tokens AS score FROM (SELECT *, min(doc_id) OVER (PARTITION BY fingerprint) AS a FROM ({_PRINTS}) WHERE fingerprint <> '') WHERE doc_id <> a")
def exact_clone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.clone_pairs(text_tokens_fingerprint(spark, sf_dir), "doc_id")


def _shingles(table_: str, key: str) -> str:
    return f"SELECT {key}, list_distinct(list_transform(range(1, len(t) - 3), lambda i: substr(sha256(array_to_string(t[i:i + 4], chr(31))), 1, 16))) AS s FROM (SELECT {key}, {_LEXICAL} AS t FROM {table_}) WHERE len(t) >= 5"


@query(f"""WITH d AS ({_shingles('documents', 'doc_id')}), b AS ({_shingles('benchmark', 'item_id')}),
k AS (SELECT item_id, unnest(list_sort(s)[1:64]) AS h, len(list_sort(s)[1:64])::BIGINT AS n_sketch FROM b), e AS (SELECT doc_id, unnest(s) AS h FROM d)
SELECT doc_id, item_id, count(*) AS n_shared, max(n_sketch) AS n_sketch, count(*) / max(n_sketch)::DOUBLE AS coverage FROM e JOIN k USING (h) GROUP BY doc_id, item_id HAVING count(*) / max(n_sketch)::DOUBLE >= 0.8""")
def near_copy_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.containment(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")


def _window_sql(table_: str, key: str) -> str:
    return f"SELECT {key}, h, min(p)::BIGINT AS p FROM (SELECT {key}, unnest(range(len(t) - 11)) AS p, unnest(list_transform(range(1, len(t) - 10), lambda i: sha256(array_to_string(t[i:i + 11], chr(31))))) AS h FROM (SELECT {key}, {_LEXICAL} AS t FROM {table_}) WHERE len(t) >= 12) GROUP BY {key}, h"


@query(f"""WITH l AS ({_window_sql('documents', 'doc_id')}), r AS ({_window_sql('benchmark', 'item_id')}), j AS (SELECT doc_id, item_id, l.p AS left_at, r.p AS right_at FROM l JOIN r USING (h))
SELECT doc_id, item_id, left_at, right_at, n_windows FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id) AS n_windows, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY left_at, right_at) AS rn FROM j) WHERE rn = 1""")
def shared_token_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.first_shared_window(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS t, p_brand AS i, o_custkey AS o FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT 2 AS k, x.t, x.o, x.i || '|' || y.i AS members FROM b x JOIN b y ON x.t = y.t AND x.i < y.i
  UNION ALL SELECT 3, x.t, x.o, x.i || '|' || y.i || '|' || z.i FROM b x JOIN b y ON x.t = y.t AND x.i < y.i JOIN b z ON y.t = z.t AND y.i < z.i)
SELECT k::BIGINT AS k, members, count(DISTINCT t) AS n_transactions, count(DISTINCT o) AS n_owners FROM s GROUP BY k, members HAVING count(DISTINCT t) >= 3 AND count(DISTINCT o) >= 3""")
def frequent_groups_k2_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p, o = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    items = l.select("l_orderkey", "l_partkey").join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return relations.frequent_groups(items, "l_orderkey", "p_brand", "o_custkey", 3, 3, 3)


@query("""WITH m AS (SELECT c_custkey, count(DISTINCT o_orderkey) AS nom, count(l_orderkey) AS wmc, coalesce(sum(l_quantity::DECIMAL(18,2)), 0)::DOUBLE AS loc FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey),
s AS (SELECT *, (nom >= 10)::INT + (wmc >= 30)::INT + (loc >= 100)::INT + (nom >= 15 AND wmc >= 50)::INT AS signals FROM m)
SELECT c_custkey, nom, wmc, loc, signals, nom >= 5 AND wmc >= 20 AND signals >= 2 AS god_class FROM s""")
def multi_signal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, l = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    # lines are summed up by order first, so each order is one row
    lines = l.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    m = o.select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("nom"), F.sum("n").alias("wmc"), F.sum("q").alias("loc"))
    m = c.select("c_custkey").join(m, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("nom", F.lit(0)).alias("nom"), F.coalesce("wmc", F.lit(0)).alias("wmc"), F.coalesce(F.col("loc").cast("double"), F.lit(0.0)).alias("loc"))
    args = (F.col("nom"), F.col("wmc"), F.col("loc"))
    return m.withColumn("signals", rules.god_class_signals(*args)).withColumn("god_class", rules.god_class(*args))


_DOMINANT = "SELECT user_id, event_type AS receiver, n AS access, total::BIGINT AS total, n / total::DOUBLE AS ratio FROM (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE rn = 1"


@query(f"SELECT *, access >= 4 AND ratio >= 0.6 AS envious FROM ({_DOMINANT})")
def dominant_receiver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.dominant(table(spark, sf_dir, "events"), "user_id", "event_type").withColumn("envious", (F.col("access") >= 4) & (F.col("ratio") >= rules.ENVY_RATIO))


@query(f"""SELECT user_id, access, total, coalesce(list_min(list_filter(range(access + 1), lambda r: CASE WHEN greatest(access - r, least(greatest(total - r, 0), 10)) > 0 THEN (access - r) / greatest(access - r, least(greatest(total - r, 0), 10))::DOUBLE ELSE 0 END < 0.6)), access) AS reduction FROM ({_DOMINANT})""")
def ratio_required_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ranking.dominant(table(spark, sf_dir, "events"), "user_id", "event_type")
    return d.select("user_id", "access", "total", rules.envy_reduction(F.col("access"), F.col("total"), F.lit(10).cast("long")).alias("reduction"))


_LOW = ", ".join(f"'{x}'" for x in rules.LOW_INFO_NAMES)
_SHORT = ", ".join(f"'{x}'" for x in rules.SHORT_NAMES_ALLOWED)


@query(rf"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents UNION SELECT DISTINCT unnest(regexp_extract_all(p_name, '[A-Za-z_][A-Za-z0-9_]*')) FROM part)
SELECT name, CASE WHEN lower(name) IN ({_LOW}) THEN 'low_info_name' WHEN length(name) <= 2 AND lower(name) NOT IN ({_SHORT}) THEN 'too_short' WHEN regexp_matches(name, '^[a-zA-Z][0-9]+$') THEN 'letter_digit' WHEN regexp_matches(name, '^[a-zA-Z]+$') AND length(name) >= 3 AND replace(name, name[1], '') = '' THEN 'repeated_char' END AS reason FROM n""")
def name_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda t, c: table(spark, sf_dir, t).select(F.explode(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name"))
    return words("documents", F.col("text")).union(words("part", F.col("p_name"))).distinct().select("name", rules.name_reason(F.col("name")).alias("reason"))


@query("SELECT 'part' AS kind, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unreferenced_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = relations.unreferenced(table(spark, sf_dir, "part"), "p_partkey", table(spark, sf_dir, "lineitem"), "l_partkey")
    customers = relations.unreferenced(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey")
    return parts.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id")).union(customers.select(F.lit("customer"), "c_custkey"))


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'r' || r_regionkey, 'world' FROM region),
c AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION SELECT c.child, e.parent, c.depth + 1 FROM c JOIN e ON c.ancestor = e.child WHERE c.depth < 8)
SELECT child, ancestor, min(depth)::BIGINT AS depth FROM c GROUP BY child, ancestor""")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda t, p, c, q, d: table(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(c).cast("string")).alias("child"), F.concat(F.lit(q), F.col(d).cast("string")).alias("parent"))
    world = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("world").alias("parent"))
    return relations.ancestor_closure(edge("nation", "n", "n_nationkey", "r", "n_regionkey").union(edge("supplier", "s", "s_suppkey", "n", "s_nationkey")).union(world))


@query("""WITH m AS (SELECT o_orderdate < TIMESTAMP '1998-01-01' AS before, o_custkey, sha256(max(o_orderpriority || o_orderstatus)) AS digest FROM orders GROUP BY ALL),
b AS (SELECT o_custkey, digest FROM m WHERE before), a AS (SELECT o_custkey, digest FROM m WHERE NOT before)
SELECT o_custkey, CASE WHEN b.digest IS NULL THEN 'added' WHEN a.digest IS NULL THEN 'deleted' WHEN a.digest = b.digest THEN 'equal' ELSE 'changed' END AS status FROM b FULL JOIN a USING (o_custkey)""")
def manifest_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("before", F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    m = o.groupBy("before", "o_custkey").agg(F.sha2(F.max(F.concat("o_orderpriority", "o_orderstatus")), 256).alias("digest"))
    return relations.manifest_delta(m.where("before"), m.where("not before"), "o_custkey", "digest")


@query(f"""WITH p AS ({_PRINTS}), d AS (SELECT source, fingerprint, lang, regexp_matches(text, '(?i)licen[cs]e') AS touched FROM documents JOIN p USING (doc_id)),
cone AS (SELECT DISTINCT source FROM d WHERE touched)
SELECT DISTINCT source, fingerprint FROM d WHERE lang <> 'en' AND fingerprint <> '' AND source IN (SELECT source FROM cone) AND (source, fingerprint) NOT IN (SELECT (source, fingerprint) FROM d WHERE lang = 'en')""")
def catalog_additions_in_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = docs.select("source", "lang", text.fingerprint(text.clone_tokens(F.col("text"))).alias("fingerprint"), F.col("text").rlike("(?i)licen[cs]e").alias("touched"))
    new = relations.additions(d.where("lang = 'en'"), d.where("lang <> 'en' and fingerprint <> ''"), ["source", "fingerprint"])
    return new.join(d.where("touched").select("source").distinct(), "source", "left_semi").select("source", "fingerprint").distinct()


@query("""WITH h AS (SELECT user_id, event_type, count(*) FILTER (day(ts) <= 15) AS b, count(*) FILTER (day(ts) > 15) AS a FROM events GROUP BY ALL) SELECT user_id, event_type, a - b AS n_added FROM h WHERE a > b""")
def multiset_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("early", F.dayofmonth("ts") <= 15)
    return relations.multiset_additions(e.where("early"), e.where("not early"), ["user_id", "event_type"])


@query("""SELECT o_orderkey, count(*) AS n_lines, min(l_shipdate) AS first_ship FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate <= l_shipdate + INTERVAL 10 DAY AND l_shipdate <= o_orderdate + INTERVAL 60 DAY GROUP BY o_orderkey""")
def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    meet = relations.overlaps(F.col("o_orderdate"), F.expr("o_orderdate + INTERVAL 60 DAY"), F.col("l_shipdate"), F.expr("l_shipdate + INTERVAL 10 DAY"))
    both = o.select("o_orderkey", "o_orderdate").join(l.select("l_orderkey", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey")).where(meet)
    return both.groupBy("o_orderkey").agg(F.count("*").alias("n_lines"), F.min("l_shipdate").alias("first_ship"))


_SPANS = "SELECT o_orderkey AS span, o_custkey, o_orderdate AS b, o_orderdate + INTERVAL (30 * substr(o_orderpriority, 1, 1)::INT) DAY AS e FROM orders"


@query(f"""WITH s AS ({_SPANS}), p AS (SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, span FROM p JOIN s USING (o_custkey) WHERE l_shipdate BETWEEN b AND e QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY e - b, b, span) = 1""")
def smallest_containing_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    days = F.substring("o_orderpriority", 1, 1).cast("int") * 30
    spans = o.select(F.col("o_orderkey").alias("span"), "o_custkey", F.col("o_orderdate").alias("b"), (F.col("o_orderdate") + F.make_dt_interval(days)).alias("e"))
    points = l.select("l_orderkey", "l_linenumber", "l_shipdate").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return relations.smallest_containing(points, spans, "o_custkey", "l_shipdate", "b", "e", ["l_orderkey", "l_linenumber"], "span")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hunk FROM events""")
def asof_line_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.as_of(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "hunk").select("event_id", "user_id", "hunk")


@query("""WITH f AS (SELECT *, coalesce(event_type <> lag(event_type) OVER w, true)::INT AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM f)
SELECT user_id, run, event_type, count(*) AS n_rows FROM r GROUP BY ALL""")
def contiguous_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.islands(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part), d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY rn, p_brand) = 1),
c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY rn) <= 7) SELECT p_partkey, p_brand, p_name, row_number() OVER (ORDER BY rn, p_brand) AS place FROM c QUALIFY place <= 30""")
def round_robin_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.round_robin(table(spark, sf_dir, "part"), "p_brand", "p_name", [F.col("p_retailprice").desc(), F.col("p_partkey")]).select("p_partkey", "p_brand", "p_name", "place")


@query("""SELECT o_orderpriority AS grp, count(*) AS n_rows, count_if(o_orderstatus = 'F')::BIGINT AS captured, count_if(o_orderstatus = 'F') / count(*)::DOUBLE AS rate, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS mean, median(o_totalprice) AS median, quantile_disc(o_totalprice, 0.9) AS p90
FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority))""")
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.audit_rollup(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F", F.col("o_totalprice"))


@query("""SELECT status, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM (SELECT user_id, CASE WHEN event_type = 'error' AND value > 100 THEN 'infra_error' WHEN event_type = 'error' THEN 'test_failed' WHEN json_extract(props, '$.k')::INT > 90 THEN 'timeout' WHEN event_type = 'purchase' THEN 'pass' ELSE 'unavailable' END AS status FROM events) GROUP BY status""")
def status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when((F.col("event_type") == "error") & (F.col("value") > 100), "infra_error").when(F.col("event_type") == "error", "test_failed").when(k > 90, "timeout").when(F.col("event_type") == "purchase", "pass").otherwise("unavailable")
    return table(spark, sf_dir, "events").select("user_id", status.alias("status")).groupBy("status").agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"))


_YEARLY = "SELECT o_custkey, year(o_orderdate)::INT AS y, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS price FROM orders GROUP BY ALL"
_DELTA = f"SELECT o_custkey, y, before_n, n AS after_n, CASE WHEN before_n = 0 THEN 0.0::DOUBLE ELSE (before_n - n) / before_n::DOUBLE END AS reduction_n, CASE WHEN before_price = 0 THEN 0.0::DOUBLE ELSE (before_price - price) / before_price END AS reduction_price FROM (SELECT *, lag(n) OVER w AS before_n, lag(price) OVER w AS before_price FROM ({_YEARLY}) WINDOW w AS (PARTITION BY o_custkey ORDER BY y)) WHERE before_n IS NOT NULL"


@query(_DELTA)
def metric_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    yearly = o.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price"))
    w = Window.partitionBy("o_custkey").orderBy("y")
    d = yearly.withColumns({"before_n": F.lag("n").over(w), "before_price": F.lag("price").over(w)}).where("before_n is not null")
    return d.select("o_custkey", "y", "before_n", F.col("n").alias("after_n"), rules.relative_reduction(F.col("before_n"), F.col("n")).alias("reduction_n"), rules.relative_reduction(F.col("before_price"), F.col("price")).alias("reduction_price"))


@query(f"SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN reduction_n <= 0 AND reduction_price <= 0 THEN 'NO_PROGRESS' WHEN after_n >= 5 THEN 'FINDING_PRESENT' WHEN reduction_price < 0 THEN 'REGRESSION' ELSE 'PASS' END AS verdict FROM ({_DELTA})) GROUP BY verdict")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when((F.col("reduction_n") <= 0) & (F.col("reduction_price") <= 0), "NO_PROGRESS").when(F.col("after_n") >= 5, "FINDING_PRESENT").when(F.col("reduction_price") < 0, "REGRESSION").otherwise("PASS")
    return metric_delta(spark, sf_dir).select(verdict.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT o_orderkey, o_custkey, (SELECT arg_max(m.o_orderkey, (m.o_totalprice, -m.n)) FROM n m WHERE m.o_custkey = n.o_custkey AND m.n <= n.n) AS best FROM n""")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_so_far(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", "o_orderkey").select("o_orderkey", "o_custkey", "best")


@query("""SELECT user_id, n_signatures, CASE WHEN n_signatures >= 4 AND passed > 0 AND failed > 0 THEN 'FLAKY' WHEN failed > 0 AND passed = 0 THEN 'FAIL' WHEN passed > 0 THEN 'PASS' ELSE 'UNAVAILABLE' END AS status FROM (SELECT user_id, count(DISTINCT event_type) AS n_signatures, count_if(event_type = 'purchase') AS passed, count_if(event_type = 'error') AS failed FROM events GROUP BY user_id)""")
def flaky_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("n_signatures"), F.count_if(F.col("event_type") == "purchase").alias("passed"), F.count_if(F.col("event_type") == "error").alias("failed"))
    status = F.when((F.col("n_signatures") >= 4) & (F.col("passed") > 0) & (F.col("failed") > 0), "FLAKY").when((F.col("failed") > 0) & (F.col("passed") == 0), "FAIL").when(F.col("passed") > 0, "PASS").otherwise("UNAVAILABLE")
    return g.select("user_id", "n_signatures", status.alias("status"))


@query("""WITH r AS (SELECT *, count_if(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM events), l AS (SELECT * FROM r QUALIFY epoch = max(epoch) OVER (PARTITION BY user_id))
SELECT user_id, max(epoch)::BIGINT AS resets, count(*) AS n_events, arg_max(event_type, (ts, event_id)) AS last_type FROM l GROUP BY user_id""")
def last_state_after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").withColumn("epoch", F.count(F.when(F.col("event_type") == "signup", 1)).over(w))
    g = e.groupBy("user_id", "epoch").agg(F.count("*").alias("n_events"), F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("last_type"))
    return g.groupBy("user_id").agg(F.max(F.struct("epoch", "n_events", "last_type")).alias("m")).select("user_id", F.col("m.epoch").alias("resets"), F.col("m.n_events").alias("n_events"), F.col("m.last_type").alias("last_type"))


@query("""WITH f AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR, true)::INT AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM s GROUP BY user_id, s""")
def inactivity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_keys(props) = ['k'] AS allowed FROM events""")
def json_context_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), (F.array_join(F.json_object_keys("props"), ",") == "k").alias("allowed"))


@query(r"""SELECT source, sum(len(regexp_extract_all(text, '(?i)\bth[a-z]*')))::BIGINT AS n_methods, sum(len(regexp_extract_all(text, '[.!?]')))::BIGINT AS n_asserts, count_if(regexp_matches(text, '(?i)licen[cs]e'))::BIGINT AS n_disabled FROM documents GROUP BY source""")
def test_strength_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.sum(F.regexp_count("text", F.lit(p))).cast("long")
    return table(spark, sf_dir, "documents").groupBy("source").agg(n(r"(?i)\bth[a-z]*").alias("n_methods"), n("[.!?]").alias("n_asserts"), F.count_if(F.col("text").rlike("(?i)licen[cs]e")).alias("n_disabled"))


@query(r"""SELECT page_id, len(regexp_extract_all(m, '(?i)<a [^>]*href='))::BIGINT AS n_links, length(m)::BIGINT AS n_chars FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS m FROM pages)""")
def pages_link_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = F.regexp_replace(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    return table(spark, sf_dir, "pages").select("page_id", masked.alias("m")).select("page_id", F.regexp_count("m", F.lit(r"(?i)<a [^>]*href=")).cast("long").alias("n_links"), F.length("m").cast("long").alias("n_chars"))
