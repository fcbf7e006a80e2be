"""Registered queries of the scans, metrics, detectors, signatures and logs, over sources made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, lexical, logs, text
from ..operators import failures, findings, relations
from ..sources import scans
from ..sources.batches import spread
from . import generated
from .catalog import _LOW, _SHORT, query, table

_SHAPES = f"WITH {generated.SHAPES_SQL}"
_SW = "(r > 0)::INT"
_JEND = f"(9 + 2 * d + {_SW} * (2 + 2 * r))"
_PEND = "(8 + d + 2 * r + n)"


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' shapes over many tasks: sources are made of them where they are parsed, so that these short rows are moved and not the sources."""
    return spread(generated.order_shapes(spark, sf_dir), "o")


def _java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.java_source(_shapes(spark, sf_dir))


def _python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.python_source(_shapes(spark, sf_dir))


_FUNCTION = ["owner", "name", "begin_line", "end_line", "n_params", "loc", "nesting", "complexity", "switches", "branches", "ncss"]


@query(f"""{_SHAPES} SELECT 'C' || c AS owner, 'm' || o AS name, 5 AS begin_line, {_JEND} AS end_line, n AS n_params, 3 + 2 * d + {_SW} * (2 + 2 * r) AS loc, greatest(d, {_SW}) AS nesting,
(d * (d + 1) // 2 + d + {_SW})::INT AS complexity, {_SW} AS switches, r AS branches, 4 + d + {_SW} * (1 + 2 * r) AS ncss FROM s""")
def java_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_code(spark, _java(spark, sf_dir), "functions", apart=True).select(*_FUNCTION)


@query(f"""{_SHAPES} SELECT 'C' || c AS owner, 'm' || o AS name, 5 AS begin_line, {_PEND} AS end_line, n AS n_params, 3 + d + 2 * r + n AS loc, greatest(d, {_SW}) AS nesting,
(d * (d + 1) // 2 + r)::INT AS complexity, (r > 1)::INT AS switches, greatest((d > 0)::INT, r) AS branches, 0 AS ncss FROM s""")
def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_code(spark, _python(spark, sf_dir), "functions", apart=True).select(*_FUNCTION)


_METRICS = f"""SELECT c, o, 'java' AS language, 1 AS nom, 1 AS nof, greatest(1, d + {_SW}) AS wmc, {_JEND} - 1 AS loc FROM s UNION ALL SELECT c, o, 'python', 1, 2, greatest(1, d + r), {_PEND} - 2 FROM s"""


@query(f"""{_SHAPES}, m AS ({_METRICS}) SELECT language, 'class' AS kind, 'C' || c AS name, nom, nof, wmc, loc, 'B' || (c % 5) AS supers, CASE WHEN language = 'java' THEN 'I' ELSE '' END AS interfaces FROM m""")
def code_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _java(spark, sf_dir).unionByName(_python(spark, sf_dir))
    joined = lambda c: F.array_join(c, "|").alias(c)
    return scans.scan_code(spark, files, "classes", apart=True).select("language", "kind", "name", "nom", "nof", "wmc", "loc", joined("supers"), joined("interfaces"))


@query(f"""{_SHAPES}, m AS ({_METRICS}), g AS (SELECT c, language, sum(nom)::BIGINT AS nom, sum(wmc)::BIGINT AS wmc, sum(loc)::BIGINT AS loc FROM m GROUP BY ALL),
p AS (SELECT *, list_filter([CASE WHEN nom >= 10 THEN 'nom' END, CASE WHEN wmc >= 30 THEN 'wmc' END, CASE WHEN loc >= 100 THEN 'loc' END, CASE WHEN nom >= 15 AND wmc >= 50 THEN 'nom_wmc' END], lambda x: x IS NOT NULL) AS s FROM g)
SELECT c, language, nom, wmc, loc, array_to_string(s, '|') AS signals, nom >= 5 AND wmc >= 20 AND len(s) >= 2 AS god_class, len(s) + wmc / 30.0::DOUBLE AS score FROM p""")
def god_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _java(spark, sf_dir).unionByName(_python(spark, sf_dir))
    classes = scans.scan_code(spark, files, "classes", apart=True).withColumn("c", F.substring("name", 2, 20).cast("long"))
    g = findings.god_classes(classes, ["c", "language"])
    return g.select("c", "language", "nom", "wmc", "loc", F.array_join("signals", "|").alias("signals"), "god_class", "score")


_RECEIVERS = "SELECT o, 'java' AS language, unnest([{'v': 'this', 'n': 1, 'w': 1}, {'v': 'other', 'n': r, 'w': r}, {'v': 'helper', 'n': 1, 'w': 0}]) AS a FROM s UNION ALL SELECT o, 'python', unnest([{'v': 'self', 'n': d + 1, 'w': 1}, {'v': 'other', 'n': r, 'w': r}, {'v': 'helper', 'n': n + 1, 'w': 0}]) FROM s"


@query(f"""{_SHAPES}, a AS ({_RECEIVERS}) SELECT o, language, a.v AS receiver, a.n::BIGINT AS access, (a.n - a.w)::BIGINT AS reads, a.w::BIGINT AS writes FROM a WHERE a.n > 0""")
def receiver_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _java(spark, sf_dir).unionByName(_python(spark, sf_dir))
    a = findings.receiver_counts(scans.scan_code(spark, files, "accesses", apart=True))
    return a.select(F.substring("function", 2, 20).cast("long").alias("o"), "language", "receiver", "access", "reads", "writes")


@query(f"""{_SHAPES}, a AS ({_RECEIVERS}), f AS (SELECT o, language, a.v AS receiver, a.n::BIGINT AS access FROM a WHERE a.n > 0),
t AS (SELECT o, language, sum(access)::BIGINT AS total FROM f GROUP BY ALL),
b AS (SELECT * FROM f WHERE receiver NOT IN ('this', 'self') QUALIFY row_number() OVER (PARTITION BY o, language ORDER BY access DESC, receiver) = 1),
l AS (SELECT o, 'java' AS language, 3 + 2 * d + {_SW} * (2 + 2 * r) AS loc FROM s UNION ALL SELECT o, 'python', 3 + d + 2 * r + n FROM s),
x AS (SELECT o, language, receiver, access, total, loc, access / total::DOUBLE AS ratio FROM b JOIN t USING (o, language) JOIN l USING (o, language)),
y AS (SELECT *, list_min(list_filter(range(access + 1), lambda k: CASE WHEN greatest(access - k, total - k) > 0 THEN (access - k) / greatest(access - k, total - k)::DOUBLE ELSE 0 END < 0.6)) AS k FROM x)
SELECT o, language, receiver, access, total, round(ratio, 6) AS ratio, loc >= 5 AND access >= 4 AND ratio >= 0.6 AS envious, CASE WHEN loc < 5 THEN 0 ELSE least(greatest(access - 3, 0), coalesce(k, access)) END::BIGINT AS required FROM y""")
def feature_envy(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _java(spark, sf_dir).unionByName(_python(spark, sf_dir))
    functions = scans.scan_code(spark, files, "functions", apart=True, columns=["path", "language", "owner", "name", "begin_line", "loc"])
    e = findings.feature_envy(functions, scans.scan_code(spark, files, "accesses", apart=True, columns=["path", "language", "owner", "function", "begin_line", "receiver", "written"]))
    return e.select(F.substring("name", 2, 20).cast("long").alias("o"), "language", "receiver", "access", "total", "budget.ratio", F.col("budget.finding_present").alias("envious"), F.col("budget.required_reduction").alias("required"))


@query(rf"""{_SHAPES}, i AS (SELECT o, 'java' AS language, 'method' AS kind, 'm' || o AS name FROM s UNION ALL SELECT o, 'python', 'method', 'm' || o FROM s
UNION ALL SELECT o, 'java', 'param', 'a' || unnest(range(1, n + 1)) FROM s UNION ALL SELECT o, 'python', 'param', 'a' || unnest(range(1, n + 1)) FROM s UNION ALL SELECT o, 'java', 'local', 't' FROM s UNION ALL SELECT o, 'python', 'local', 'x' FROM s),
x AS (SELECT language, kind, name, CASE WHEN lower(name) IN ({_LOW}) THEN 'low_info_name' WHEN length(name) <= 2 AND lower(name) NOT IN ({_SHORT}) AND (language <> 'java' OR kind = 'method') THEN 'too_short' WHEN regexp_matches(name, '^[a-zA-Z][0-9]+$') THEN 'letter_digit' END AS reason FROM i)
SELECT language, kind, reason, count(*) AS n, count(DISTINCT name) AS n_names FROM x WHERE reason IS NOT NULL GROUP BY ALL""")
def mysterious_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _java(spark, sf_dir).unionByName(_python(spark, sf_dir))
    found = findings.mysterious_names(scans.scan_code(spark, files, "identifiers", apart=True))
    return found.groupBy("language", "kind", "reason").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))


@query(f"""{_SHAPES}, f AS (SELECT 'm' || o AS name, 'java' AS language, 4 + d + {_SW} * (1 + 2 * r) AS m, n AS p, (d * (d + 1) // 2 + d + {_SW})::INT AS x, {_SW} AS w FROM s UNION ALL SELECT 'm' || o, 'python', 3 + d + 2 * r + n, n, greatest(d, {_SW}), (r > 1)::INT FROM s)
SELECT name, language, unnest(list_filter([CASE WHEN m >= CASE language WHEN 'java' THEN 60 ELSE 50 END THEN 'long_method' END, CASE WHEN p >= 6 THEN 'long_parameter_list' END, CASE WHEN x >= CASE language WHEN 'java' THEN 20 ELSE 5 END THEN 'nested_complexity' END, CASE WHEN w > 0 THEN 'switch_statements' END], lambda v: v IS NOT NULL)) AS smell FROM f""")
def function_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _java(spark, sf_dir).unionByName(_python(spark, sf_dir))
    return findings.function_findings(scans.scan_code(spark, files, "functions", apart=True)).select("name", "language", "smell")


@query(f"""{_SHAPES}, g AS (SELECT n, count(*) AS n_methods, count(DISTINCT c) AS n_owners FROM s WHERE n >= 3 GROUP BY n),
k AS (SELECT k, sum(n_methods)::BIGINT AS n_methods FROM g, (SELECT unnest(range(3, 8)) AS k) WHERE n >= k GROUP BY k)
SELECT k AS n_members, n_methods, array_to_string(list_transform(range(1, k + 1), lambda i: 'map<string,int[]>:a' || i), '|') AS members FROM k WHERE n_methods >= 3""")
def data_clumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = scans.scan_code(spark, _java(spark, sf_dir), "functions", apart=True)
    groups = spark.range(3, 8).select(F.array_join(F.transform(F.sequence(F.lit(1), F.col("id").cast("int")), lambda i: F.concat(F.lit("map<string,int[]>:a"), i.cast("string"))), "|").alias("members"), F.col("id").alias("n_members"))
    found = findings.clump_occurrences(functions, groups, "members")
    return found.groupBy("members", "n_members").agg(F.countDistinct("name").alias("n_methods")).where("n_methods >= 3").select("n_members", "n_methods", "members")


@query(f"""{_SHAPES} SELECT o, length('    String t = "if (x) {{ }} /* switch */";')::INT AS line_length, false AS has_literal, {_SW}::INT AS switches, r AS cases, CASE WHEN r > 0 THEN r::DOUBLE ELSE 0 END AS density, {_JEND} AS loc, true AS forwards FROM s""")
def masked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    forward = F.concat(F.lit("{ // on\n return this.m"), F.col("o").cast("string"), F.lit('("x;", a); }'))
    m = _java(spark, sf_dir).select("o", code.masked("content").alias("m"), code.switch_metrics("content").alias("w"), code.non_comment_loc("content").alias("loc"), code.thin_forwarder(forward).alias("forwards"))
    literal = F.contains("m", F.lit("Fake")) | F.contains("m", F.lit("if (x)"))
    return m.select("o", F.length(F.get(F.split("m", "\n"), 5)).alias("line_length"), literal.alias("has_literal"), F.col("w.switches").alias("switches"), F.col("w.cases").alias("cases"), F.col("w.density").alias("density"), F.col("loc").cast("int").alias("loc"), "forwards")


@query(f"""{_SHAPES} SELECT o, 'm' || o AS basename, n::BIGINT AS n_params, array_to_string(list_transform(range(1, n + 1), lambda i: 'java.util.map<string,int[]>:a' || i), '|') AS params,
array_to_string(list_transform(range(1, n + 1), lambda i: 'Map<String, int[]>'), ',') AS types, 'm' || o || '(' || array_to_string(list_transform(range(1, n + 1), lambda i: 'Map'), ',') || ')' AS stable,
'm' || o || '(' || array_to_string(list_transform(range(1, n + 1), lambda i: 'java.util.Map'), ',') || ')' AS qualified, array_to_string(list_sort(list_transform(range(1, n + 1), lambda i: 'map:a' || i)), '|') AS erased,
'src/x.java#C' || c || '#m' || o || '(' || array_to_string(list_transform(range(1, n + 1), lambda i: 'java.util.Map'), ',') || ')' AS identity, 'm' || o AS plain_name, 'a/b.c' AS path, 'src/x.java' AS relative FROM s""")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spread(generated.order_shapes(spark, sf_dir))
    params = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("final java.util.Map<String, int[]> a"), i.cast("string"))), ", ")
    s = s.withColumn("sig", F.concat(F.lit("public static int p.C"), F.col("c").cast("string"), F.lit(".m"), F.col("o").cast("string"), F.lit("("), params, F.lit(")")))
    group = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("Map<String, int[]>:A"), i.cast("string"))), "|")
    listed = F.concat(F.lit("("), F.col("plist"), F.lit(")"))  # of a signature without a list: null, which has none either
    java = F.lit("java")
    s = relations.by_value(s, {"plist": lexical.parameter_list(F.col("sig")), "members": group}, lambda: {
        "n_params": lexical.count_params(listed, java), "params": F.array_join(lexical.parameter_fingerprints(listed, java), "|"), "types": lexical.java_type_fingerprint(listed),
        "kinds": lexical.stable_kinds(F.col("plist")), "full_kinds": lexical.stable_kinds(F.col("plist"), True), "erased": lexical.normalize_erased_group(F.col("members")),
    })
    full = F.col("full_kinds")
    return s.select(
        "o", lexical.method_basename(F.col("sig")).alias("basename"), "n_params", "params", "types", lexical.stable_signature(F.col("sig"), kinds=F.col("kinds")).alias("stable"), lexical.stable_signature(F.col("sig"), True, full).alias("qualified"), "erased",
        lexical.stable_clone_identity(F.concat(F.lit("./src/x.java#C"), F.col("c").cast("string"), F.lit("#"), F.col("sig")), full).alias("identity"), text.normalize_method(F.col("sig")).alias("plain_name"), text.normalize_path(F.lit(".\\A/b.c")).alias("path"), lexical.relative_path(F.lit("/r/src/X.java"), F.lit("/r")).alias("relative"),
    )


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS t, p_name FROM part)
SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9_]', '', 'g') AS stem, lower(to_hex(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (h * 31 + x) & 4294967295))) AS java_hash,
substr(sha1(p_name), 1, 12) AS short, substr(sha256(array_to_string(t[1:5], chr(31))), 1, 16) AS anchor, sha256(unhex(array_to_string(list_transform(t, lambda x: printf('%016X', strlen(x)) || hex(encode(x))), ''))) AS sequence,
list_reduce(list_prepend(0::HUGEINT, list_transform(t, lambda x: ('0x' || substr(sha256(x), 1, 16))::UBIGINT::HUGEINT)), lambda v, u: (v * 1000003 + u) % 18446744073709551616::HUGEINT)::VARCHAR AS rolling FROM p""")
def token_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, name = F.split("p_name", " "), F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", lexical.stem_name(name).alias("stem"), lexical.java_hex_hash(name).alias("java_hash"), lexical.short_hash(name).alias("short"), lexical.window_anchor(t).alias("anchor"), lexical.token_sequence_sha256(t).alias("sequence"), lexical.token_rolling64(t).alias("rolling"))


_STEPS = f"WITH {generated.STEPS_SQL}"


@query(f"""{_STEPS} SELECT event_id, CASE WHEN k % 3 = 0 THEN k ELSE 0 END::BIGINT AS pytest, CASE WHEN k % 4 = 1 THEN greatest(k - 2, 0) ELSE 0 END::BIGINT AS unittest, CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END::BIGINT AS ctest,
CASE WHEN k > 0 AND k % 2 = 0 THEN k ELSE 0 END::BIGINT AS curl, CASE WHEN k > 0 AND k % 7 = 0 THEN k ELSE 0 END::BIGINT AS redis, (greatest(k - 1, 0) + greatest(k + 5, 0))::BIGINT AS maven, (k + 1)::BIGINT AS junit FROM e""")
def console_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    t = lambda x: x.cast("string")
    log = F.concat_ws(
        "\n", F.lit("collecting ... 5 items"), F.concat(F.lit("OK ("), t(k + 1), F.lit(" tests)")), F.when(k % 3 == 0, F.concat(F.lit("\x1b[32m==== "), t(k), F.lit(" passed, 1 skipped in 1.25s ====\x1b[0m"))).otherwise(F.concat(t(k), F.lit(" passed"))),
        F.concat(F.lit("Ran "), t(k + 9), F.lit(" tests in 0.1s")), F.lit("OK"), F.when(k % 4 == 1, F.concat(F.lit("Ran "), t(k), F.lit(" tests in 0.5s\n\nOK (skipped=2)"))).otherwise("Ran 3 tests in 1.0s\n\nFAILED (errors=1)"),
        F.lit("1/2 Test #1: alpha ....... Passed 0.01 sec\n2/2 Test #2: beta ....   Passed  1.00 sec"), F.when(k % 5 == 0, "100% tests passed, 0 tests failed out of 2").otherwise("50% tests passed, 1 tests failed out of 2"),
        F.concat(F.lit("TESTDONE: "), t(k), F.lit(" tests out of "), t(k + k % 2), F.lit(" reported OK: 100%")), F.concat(F.lit("Tests: "), t(k), F.lit(" passed, 0 failed, "), t(k + k % 7), F.lit(" total")),
        F.concat(F.lit("Tests run: "), t(k), F.lit(", Failures: 0, Errors: 0, Skipped: 1")), F.concat(F.lit("Tests run: "), t(k + 5), F.lit(", Failures: 0, Errors: 0, Skipped: 0")),
    )
    e = generated.event_steps(spark, sf_dir).withColumn("log", log).withColumn("lines", logs.stripped_lines(F.col("log")))
    c, x, run = F.col("log"), F.col("lines"), F.lit
    return e.select("event_id", logs.pytest_tests(x).alias("pytest"), logs.unittest_tests(x).alias("unittest"), logs.ctest_tests(x).alias("ctest"), logs.curl_tests(run("perl tests/runtests.pl -a"), x).alias("curl"), logs.redis_tests(run("src/redis-server test all"), x).alias("redis"), logs.maven_tests(run("mvn -o test"), c).alias("maven"), logs.junit_console_tests(run("java org.junit.runner.JUnitCore X"), c).alias("junit"))


@query(f"""{_STEPS}, x AS (SELECT *, 'src/A.java:[' || k || ',7] cannot find symbol' AS d1, 'symbol: class X' || k AS c1, 'src/B.java:' || (k + 1) || ': error: missing return' AS d2 FROM e)
SELECT event_id, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS n_diagnostics, d1 || ' | ' || c1 || ' | location: class A' AS first_highlight, CASE WHEN k % 2 = 0 THEN d1 || ' | ' || c1 || ' | location: class A | src/B.java:' || (k + 1) || ': error: missing return' ELSE d1 || ' | ' || c1 || ' | location: class A' END AS summary_text,
20::INT AS n_tail, 'com.x.AppTest.runs:12 expected ' || k AS maven_test FROM x""")
def log_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k").cast("string")
    noise = F.concat_ws("\n", *[F.lit(f"[INFO] step {i}") for i in range(25)])
    log = F.concat_ws(
        "\n", noise, F.concat(F.lit("\x1b[31m[ERROR] src/A.java:["), k, F.lit(",7] cannot find symbol\x1b[0m")), F.concat(F.lit("[ERROR]   symbol: class X"), k), F.lit("  location: class A"), F.lit(""),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("src/B.java:"), (F.col("k") + 1).cast("string"), F.lit(": error: missing return"))).otherwise("plain line"),
        F.concat(F.lit("shop.CartTest > adds"), k, F.lit(" FAILED")), F.concat(F.lit("    java.lang.AssertionError: expected "), k), F.lit("        at shop.CartTest.adds(CartTest.java)"), F.lit(""), F.concat(F.lit("[ERROR] com.x.AppTest.runs:12 expected "), k), F.lit("BUILD FAILURE"),
    )
    e = logs.summarize_output(generated.event_steps(spark, sf_dir), log, F.lit("build"), F.lit(1), "s")
    maven = F.get(F.filter("s.failure_highlights", lambda x: x.startswith("com.x.")), 0)
    return e.select("event_id", F.size("s.diagnostics").alias("n_diagnostics"), F.get("s.diagnostics", 0)["highlight"].alias("first_highlight"), F.col("s.summary_text").alias("summary_text"), F.size("s.tail").alias("n_tail"), maven.alias("maven_test"))


@query(f"""{_STEPS} SELECT event_id, 'exit=' || k || CASE k % 4 WHEN 0 THEN ' | a.c: error: bad <tmp> x | unexpected end | no such file: y' WHEN 1 THEN ' | TIMEOUT | FAILED one | FAILED two' WHEN 2 THEN ' | line one | line two | line three' ELSE '' END AS fingerprint,
CASE WHEN k % 4 = 3 THEN '' WHEN k % 10 = 0 THEN 'timeout' WHEN k % 10 = 1 THEN 'oom' WHEN k % 10 = 2 THEN 'resource' ELSE '' END AS infra,
CASE k % 4 WHEN 0 THEN 'NATIVE_SEGMENTATION_FAULT|NATIVE_CORE_DUMP' WHEN 1 THEN 'NINJA_FAILED_EDGE|NINJA_BUILD_STOPPED' ELSE '' END AS native,
repeat('a', 66) || ' ... ' || repeat('b', 29) AS bounded FROM e""")
def failure_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    text = F.when(k % 4 == 0, "start\na.c:  error: bad /tmp/q7/x.o x\nunexpected\tend\nno such file: y\nmore failed").when(k % 4 == 1, "x', 'FAILED one\nFAILED two\n[FAIL] three\nTIMEOUT\n").when(k % 4 == 2, "line  one\n\n line two \nline three\nline four").otherwise("")
    status = F.when(k % 10 == 0, "Timed_Out ").otherwise("failed")
    infra = F.when(k % 10 == 1, "cc1: out of memory").otherwise("no")
    native = F.when(k % 4 == 0, "Segmentation fault (core dumped)").when(k % 4 == 1, "FAILED: obj/x.o\nninja: build stopped: subcommand failed").otherwise("fine")
    long = F.concat(F.repeat(F.lit("a"), 400), F.repeat(F.lit("b"), 400))
    return generated.event_steps(spark, sf_dir).select("event_id", logs.failure_fingerprint(k, text).alias("fingerprint"), logs.infra_kind(k % 4 != 3, status, F.when(k % 10 == 2, 137).otherwise(1), infra).alias("infra"), F.array_join(logs.native_diagnostics(native), "|").alias("native"), logs.bounded_text(long, 100).alias("bounded"))


@query(f"""{_SHAPES} SELECT 'c' AS language, '' AS owner, 'f' || o AS name, n AS n_params, greatest(d, 0) + {_SW} AS nesting, {_SW} AS switches, r AS branches FROM s UNION ALL SELECT 'c', '', 'g', 0, 0, 0, 0 FROM s
UNION ALL SELECT 'cpp', 'ns' || (o % 3) || '.C' || o, 'C' || o, 1, 0, 0, 0 FROM s UNION ALL SELECT 'cpp', 'ns' || (o % 3) || '.C' || o, 'm', n, d, 0, 0 FROM s UNION ALL SELECT 'cpp', 'ns' || (o % 3) || '.C' || o, 'operator()', 1, 0, 0, 0 FROM s UNION ALL SELECT 'cpp', 'ns' || (o % 3) || '.C' || o, 'out', 2, 2, 0, 0 FROM s""")
def native_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C and C++: the switch lies within the innermost if."""
    return scans.scan_code(spark, generated.native_source(_shapes(spark, sf_dir)), "functions", apart=True, columns=["language", "owner", "name", "n_params", "nesting", "switches", "branches"])


@query(f"""{_SHAPES} SELECT 'c' AS language, 'module' AS kind, '' AS name, 2 AS nom, '' AS supers, count(*) AS n FROM s UNION ALL SELECT 'cpp', 'class', 'ns' || (o % 3) || '.C' || o, 4, 'Base', 1 FROM s UNION ALL SELECT 'cpp', 'enum', 'ns' || (o % 3) || '.C' || o || '.E', 0, '', 1 FROM s""")
def native_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.scan_code(spark, generated.native_source(_shapes(spark, sf_dir)), "classes", apart=True, columns=["language", "kind", "name", "nom", "supers"])
    return found.groupBy("language", "kind", "name", "nom", F.array_join("supers", "|").alias("supers")).agg(F.count("*").alias("n"))


_CASES = f"""{_STEPS}, x AS (SELECT event_id, user_id, k, k % 10 >= 8 AS skipped, k % 5 AS t FROM e),
c AS (SELECT user_id, event_id, 1 AS rank, 'a/b.' || (k % 3) AS test, k % 4 AS code, 'exit=' || (k % 4) || ' | error ' || k AS f FROM x WHERE t = 0 AND NOT skipped UNION ALL SELECT user_id, event_id, 1, 'same', 1, repeat('z', k % 3 + 1) FROM x WHERE t = 0 AND NOT skipped
UNION ALL SELECT user_id, event_id, 2, 'one-' || (k % 6), -1, 'exit=-1 | error: bad <tmp>' FROM x WHERE t = 1 AND NOT skipped UNION ALL SELECT user_id, event_id, 2, 'two', 3, 'exit=3 | plain | lines' FROM x WHERE t = 1 AND NOT skipped
UNION ALL SELECT user_id, event_id, 3, CASE WHEN k % 2 = 0 THEN 'test' ELSE 'sample_test' END, 7, 'exit=7 | no marks' FROM x WHERE t = 2 AND NOT skipped)"""


@query(f"""{_CASES}, b AS (SELECT user_id, test, code, arg_min(f, (-length(f), f)) AS f FROM c WHERE rank = 1 GROUP BY ALL UNION ALL SELECT user_id, test, code, arg_min(f, (-length(f), f)) FROM c WHERE rank = 2 AND user_id NOT IN (SELECT user_id FROM c WHERE rank = 1) GROUP BY ALL
UNION ALL SELECT user_id, test, code, arg_min(f, (-length(f), f)) FROM c WHERE rank = 3 AND user_id NOT IN (SELECT user_id FROM c WHERE rank < 3) GROUP BY ALL),
g AS (SELECT user_id, list({{'t': test, 'c': code, 'f': f}} ORDER BY test, code) AS l FROM b GROUP BY user_id), h AS (SELECT *, len(l) AS n, 'tests=' || len(l) || ':' AS p FROM g)
SELECT user_id AS run, n::BIGINT AS n_tests, array_to_string(list_transform(l, lambda x: x.t || '|' || x.c || '|' || x.f), '~') AS signature,
(p || array_to_string(list_transform(l[:8], lambda x: (x.t || '@' || x.c || ':' || x.f)[:greatest(8, (128 - length(p) - least(n, 8) + 1) // least(n, 8))]), ';'))[:128] AS compact FROM h""")
def failing_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    n = lambda m: (k % m).cast("string")
    marked = F.concat(
        F.lit('noise TMUX_FAIL_CASE {"test": "a/b.'), n(3), F.lit('", "exit_code": '), n(4), F.lit(', "diagnostic_fingerprint": "exit='), n(4), F.lit(" | error "), k.cast("string"), F.lit('"} tail\nFAIL other: exit 2\nTMUX_FAIL_CASE {broken\nTMUX_FAIL_CASE {"test": "bad name", "exit_code": 1, "diagnostic_fingerprint": "x"}\n'),
        F.lit('TMUX_FAIL_CASE {"test": "same", "exit_code": 1, "diagnostic_fingerprint": "'), F.repeat(F.lit("z"), k % 3 + 1), F.lit('"}\nTMUX_FAIL_CASE [1]\n'),
    )
    headed = F.concat(F.lit("start\n[x] FAIL one-"), n(6), F.lit(": exit -1 now\n  error:  bad /tmp/q/1\nFAIL: two\nFAIL two: exit 3\nplain\nlines\n"))
    log = F.when(k % 5 == 0, marked).when(k % 5 == 1, headed).when(k % 5 == 2, "no marks")
    e = generated.event_steps(spark, sf_dir)
    skipped = k % 10 >= 8
    steps = e.where(k % 5 < 3).select(F.col("user_id").alias("run"), F.when(skipped, "build").when(k % 2 == 0, "test").otherwise("sample_test").alias("step"), F.lit(None).cast("boolean").alias("success"), F.lit("Failed ").alias("status"), F.lit(7).alias("returncode"), log.alias("text"))
    passed = e.where(k % 5 == 3).select(F.col("user_id").alias("run"), F.lit("test").alias("step"), F.lit(True).alias("success"), F.lit("ok").alias("status"), F.lit(0).alias("returncode"), F.lit("FAIL ghost: exit 1").alias("text"))
    s = failures.failure_signatures(failures.failing_tests(steps.unionByName(passed)))
    return s.select("run", "n_tests", F.array_join("signature", "~").alias("signature"), "compact")
