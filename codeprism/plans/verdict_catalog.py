"""Registered queries of adjudication, diffs, curation, audits, relations between methods, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import code, gate, rules
from ..operators import diffs, findings, java, ranking, relations
from ..sinks import files
from ..sources import scans
from ..storage import fresh_path
from ..streaming import folds
from . import generated
from .catalog import _YEARLY, query, table

_STEPS = f"WITH {generated.STEPS_SQL}"
_SHAPES = f"WITH {generated.SHAPES_SQL}"

_CHANGES = f"""ch AS (SELECT o_custkey AS c, y, lag(n) OVER w AS bn, lag(price) OVER w AS bp, n AS an, price AS ap FROM ({_YEARLY}) WINDOW w AS (PARTITION BY o_custkey ORDER BY y)),
f AS (SELECT *, c % 7 <> 0 AS has_diff, c % 11 <> 0 AS base_ok, c % 13 <> 0 AS ok, CASE c % 10 WHEN 3 THEN 2.0 WHEN 4 THEN 1.5 WHEN 5 THEN NULL ELSE c % 2 END::DOUBLE AS hits, c % 17 = 0 AS unlocated, c % 6 <> 0 AS preserved FROM ch WHERE bn IS NOT NULL),
g AS (SELECT *, CASE WHEN NOT ok THEN 'CURRENT_DETECTOR_UNAVAILABLE' WHEN hits IS NULL THEN 'CURRENT_DETECTOR_RESULT_INVALID' WHEN hits <> floor(hits) THEN 'CURRENT_DETECTOR_RESULT_INVALID' WHEN hits > 1 THEN 'TARGET_AMBIGUOUS' ELSE '' END AS failure FROM f),
h AS (SELECT *, CASE WHEN NOT has_diff THEN 'EDIT_REQUIRED' WHEN NOT base_ok THEN 'BASELINE_METRIC_UNAVAILABLE' WHEN failure <> '' THEN failure WHEN unlocated THEN 'TARGET_NOT_LOCATED' WHEN NOT preserved THEN 'SEMANTIC_CONTRACT_REGRESSION' WHEN NOT (bn > an OR bp > ap) THEN 'NO_STRUCTURAL_PROGRESS' ELSE 'METRIC_PROGRESS' END AS reason FROM g)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    yearly = o.groupBy(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price"))
    after = F.create_map(F.lit("n"), F.col("n"), F.lit("price"), F.col("price"))
    w = Window.partitionBy("c").orderBy("y")
    c = F.col("c")
    hits = F.when(c % 10 == 3, 2.0).when(c % 10 == 4, 1.5).when(c % 10 != 5, (c % 2).cast("double"))
    rows = yearly.withColumn("after", after).withColumn("before", F.lag("after").over(w)).where("before is not null").withColumn("failure", gate.detector_failure(c % 13 != 0, hits, True))
    return rows.withColumn("v", gate.contract(c % 11 != 0, F.col("before"), F.col("after"), F.col("failure"), c % 17 == 0, c % 6 != 0, c % 7 != 0))


@query(f"""WITH {_CHANGES} SELECT c, y, reason, reason = 'METRIC_PROGRESS' AS progress, base_ok AS available, round((bn - an) / bn, 6) AS reduction FROM h""")
def contract_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reduction = F.element_at(gate.objective_delta(F.col("before"), F.col("after")), "n")["relative_reduction"]
    return _changes(spark, sf_dir).select("c", "y", "v.reason", "v.progress", "v.available", reduction.alias("reduction"))


@query(f"""WITH {_CHANGES}, q AS (SELECT *, reason = 'METRIC_PROGRESS' AS progress, an >= 3 AS finding, CASE WHEN y % 2 = 0 THEN 'data_clumps' ELSE 'god_class' END AS smell FROM h),
z AS (SELECT *, CASE WHEN c % 19 = 0 THEN 'BASELINE_CHECKPOINT_MISSING' WHEN failure <> '' AND c % 19 <> 0 THEN failure WHEN finding AND progress THEN 'FINDING_REMAINS' WHEN smell = 'data_clumps' AND progress THEN 'DATA_CLUMPS_PROJECT_FULL_REQUIRED' ELSE reason END AS blocked,
 (failure = '' OR c % 19 = 0) AND progress AND NOT finding AND smell <> 'data_clumps' AS passed FROM q)
SELECT coalesce(CASE WHEN NOT passed THEN blocked END, 'PASS') AS verdict, smell, count(*) AS n FROM z GROUP BY ALL""")
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir).withColumn("smell", F.when(F.col("y") % 2 == 0, "data_clumps").otherwise("god_class"))
    required = F.col("c") % 19 != 0
    g = gate.gate(F.col("smell"), required, F.col("failure"), F.col("v.progress"), F.col("n") >= 3, F.when(~required, "baseline_checkpoint_missing"), F.col("v.reason"), F.lit(True), F.lit("sample_optimized"))
    return rows.select("smell", F.coalesce(g["reason"], F.lit("PASS")).alias("verdict")).groupBy("verdict", "smell").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey, ['data_clumps', 'feature_envy', 'code_clone_type1', 'dead_code', 'long_method', 'god_class'][(p_partkey % 6 + 1)::INT] AS smell, p_size::DOUBLE AS value FROM part),
n AS (SELECT *, CASE smell WHEN 'data_clumps' THEN 'occurrence_count' WHEN 'feature_envy' THEN 'envy_access_diff' WHEN 'code_clone_type1' THEN 'clone_token_count' ELSE 'value' END AS name FROM p),
m AS (SELECT *, CASE smell WHEN 'data_clumps' THEN 2.0 WHEN 'feature_envy' THEN 1.0 WHEN 'code_clone_type1' THEN 29.0 WHEN 'dead_code' THEN 0.0 WHEN 'long_method' THEN 19.0 END::DOUBLE AS most FROM n)
SELECT p_partkey, smell, name, most AS passing_max, CASE WHEN most IS NOT NULL THEN greatest(value - most, 0) END AS remaining FROM m""")
def objective_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    smells = F.array(*[F.lit(x) for x in ("data_clumps", "feature_envy", "code_clone_type1", "dead_code", "long_method", "god_class")])
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(smells, (F.col("p_partkey") % 6).cast("int")).alias("smell"), F.col("p_size").cast("double").alias("value"))
    name = F.when(F.col("smell") == "data_clumps", "occurrence_count").when(F.col("smell") == "feature_envy", "envy_access_diff").when(F.col("smell") == "code_clone_type1", "clone_token_count").otherwise("value")
    most = gate.passing_max(F.col("smell"), F.col("name"), F.when(F.col("smell") == "long_method", 20.0), F.lit(3.0), F.lit(30.0), F.lit(1.0))
    return p.withColumn("name", name).withColumn("passing_max", most).withColumn("remaining", gate.deficit(F.col("value"), F.col("passing_max"))).select("p_partkey", "smell", "name", "passing_max", "remaining")


@query(f"""{_STEPS}, x AS (SELECT *, k % 9 = 0 AS success, k % 3 <> 0 AS broken, k % 4 AS t FROM e)
SELECT event_id,
 CASE WHEN success THEN 'PASS' WHEN broken THEN CASE WHEN k % 10 = 1 THEN 'TEST_SOURCE_DELETED' WHEN k % 2 = 0 AND t = 0 THEN 'SAMPLE_TEST_SPEC_MISSING' WHEN k % 2 = 0 AND t = 2 THEN 'SAMPLE_TEST_EVIDENCE_MISSING' WHEN k % 5 = 0 THEN 'BUILD_FAILED' WHEN t = 1 THEN 'TEST_FAILED' ELSE 'BUILD_TEST_FAILED' END WHEN k % 6 = 0 THEN 'IMPROVED' ELSE 'SMELL_GUARD_FAILED' END AS verify,
 CASE WHEN k % 5 = 0 THEN 'AGENT_TIMEOUT' WHEN t = 0 THEN CASE WHEN k % 8 = 0 THEN 'PASS' ELSE 'VERIFY_FAILED' END WHEN t = 1 THEN 'TEST_FAILED' ELSE 'VERIFY_FAILED' END AS terminal,
 CASE WHEN k % 7 >= 2 AND k % 7 < 4 THEN 'FLAKY_TEST_INCONCLUSIVE' WHEN t = 0 AND k % 3 = 0 THEN 'FLAKY_TEST_INCONCLUSIVE' WHEN t = 1 AND k % 5 = 0 THEN 'FINAL_VERIFY_INFRA_FAILED' ELSE ['PASS', 'TEST_FAILED', 'IMPROVED', 'BUILD_FAILED'][t + 1] END AS reconciled,
 CASE WHEN t = 0 THEN 'BUILD_TIMEOUT' WHEN t = 1 THEN 'BUILD_COMPILE_ERROR' WHEN t = 2 AND k % 3 = 0 THEN 'SAMPLE_TEST_EVIDENCE_MISSING' WHEN t = 2 THEN 'TEST_OOM' WHEN k % 3 = 0 THEN 'TEST_EVIDENCE_MISSING' ELSE '' END AS category,
 CASE WHEN k % 2 = 0 THEN 'LIMIT' ELSE '' END AS control, CASE WHEN k % 3 = 0 THEN 'LOOP' ELSE '' END AS verification, CASE WHEN k % 3 = 0 THEN 'LOOP' WHEN k % 2 = 0 THEN 'LIMIT' ELSE '' END AS final,
 printf('%.1f', k + 0.25::DOUBLE) AS duration, printf('%.1f', CASE WHEN k % 2 = 0 THEN 1.5::DOUBLE ELSE k + 0.25::DOUBLE END) AS setup FROM x""")
def terminal_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    t, none = k % 4, F.lit(None).cast("string")
    verify = gate.verify_status(
        k % 9 == 0, k % 3 == 0, F.when(k % 10 == 1, "TEST_SOURCE_DELETED").otherwise("x"), F.when(k % 2 == 0, "sample_optimized").otherwise("project_full"), k % 5 != 0, t != 1,
        F.when(t == 0, "missing").when(t == 2, "test_not_executed").otherwise("ran"), F.lit(0), F.lit(None).cast("boolean"), none, k % 6 == 0, F.lit(False),
    )
    terminal = gate.terminal_status(F.when(k % 5 == 0, "AGENT_TIMEOUT").otherwise(""), F.when(t == 0, "PASS").when(t == 1, "TEST_FAILED"), F.lit(0), F.when(k % 8 == 0, "resolved"), F.lit(True), F.lit(True))
    status = F.get(F.array(*[F.lit(x) for x in ("PASS", "TEST_FAILED", "IMPROVED", "BUILD_FAILED")]), t)
    reconciled = gate.reconcile(status, F.when(k % 5 == 0, "timeout").otherwise(""), t == 1, k % 3 == 0, F.when(k % 7 < 4, k % 7).otherwise(0))
    category = gate.failure_category(F.when(t == 0, "timeout").when(t == 1, ""), F.when(t == 2, "sample_test").otherwise("test"), F.when(k % 3 == 0, "test_not_executed").otherwise("failed"), F.when(t == 2, "oom"), F.when((t == 3) & (k % 3 == 0), "TEST_FAILED").otherwise("x"), F.when(k % 3 == 0, "no_tests_collected"))
    why = gate.termination_reasons(F.when(k % 3 == 0, "LOOP").otherwise(""), none, F.lit(""), F.when(k % 2 == 0, "LIMIT"))
    time = gate.timing(k + 0.25, F.lit(0.0), F.when(k % 2 == 0, 1.5))
    return generated.event_steps(spark, sf_dir).select("event_id", verify.alias("verify"), terminal.alias("terminal"), reconciled.alias("reconciled"), category.alias("category"), why["control"].alias("control"), why["verification"].alias("verification"), why["final"].alias("final"), time["duration_seconds"].alias("duration"), time["setup_duration_seconds"].alias("setup"))


@query(f"""{_STEPS}, x AS (SELECT *, k % 5 AS t FROM e) SELECT event_id,
 CASE t WHEN 0 THEN NULL WHEN 1 THEN 'target context cannot contain detector verdict fields: metric, score' WHEN 2 THEN 'unsupported target context fields: other' WHEN 3 THEN 'declaration_lines must be unique positive integers' ELSE NULL END AS problem,
 CASE t WHEN 0 THEN k ELSE NULL END::DOUBLE AS loc, CASE WHEN t = 0 THEN 1 WHEN t = 4 THEN 0 ELSE 0 END AS n_numbers,
 CASE t WHEN 0 THEN 'TARGET_AMBIGUOUS' WHEN 1 THEN 'GONE_' || k WHEN 2 THEN 'BASELINE_CAPTURE_FAILED' WHEN 3 THEN 'GUARD_SCOPE_TOO_LARGE' ELSE 'BASELINE_CAPTURE_FAILED' END AS cause,
 CASE t WHEN 0 THEN 'PASS' WHEN 1 THEN 'INFRA_FAILED' WHEN 2 THEN 'OFFLINE_DEPENDENCY_MISSING' WHEN 3 THEN 'DEPENDENCY_RESOLUTION_FAILED' ELSE 'TEST_FAILED' END AS category, CASE WHEN t = 3 THEN 'medium' ELSE 'high' END AS confidence,
 ['elf', 'archive', 'mach-o-or-class', 'llvm-bitcode', ''][t + 1] AS kind FROM x""")
def context_and_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    t, ks = k % 5, k.cast("string")
    json = F.when(t == 0, F.concat(F.lit('{"target_class": "A", "target_parameter_count": '), ks, F.lit("}"))).when(t == 1, '{"score": 1, "metric": 2, "zzz": 3}').when(t == 2, '{"other": 1}').when(t == 3, '{"declaration_lines": [3, 3]}').otherwise('{"declaration_lines": [4, 2], "group": "a|b"}')
    numbers = gate.numeric_objectives(F.when(t == 0, F.concat(F.lit('{"loc": '), ks, F.lit(', "flag": true, "name": "x"}'))).otherwise('{"flag": false}'))
    message = F.when(t == 0, "x TARGET_AMBIGUOUS: Y").when(t == 1, F.concat(F.lit("a: GONE_"), ks, F.lit(" now"))).when(t == 2, "no code here").when(t == 3, "GUARD_SCOPE_TOO_LARGE").otherwise("a: lower")
    c = gate.dependency_category(t == 0, F.when(t == 1, "timeout").when(t == 4, "test_failed").otherwise("x"), t == 2, F.lit(False), (t == 2) | (t == 3))
    data = F.unhex(F.when(t == 0, "7F454C46020101").when(t == 1, "213C617263683E0A00").when(t == 2, "CAFEBABE0000").when(t == 3, "4243C0DE35").otherwise("0A0B0C0D"))
    return generated.event_steps(spark, sf_dir).select("event_id", rules.suspicious_context(json).alias("problem"), F.element_at(numbers, "loc").alias("loc"), F.size(numbers).alias("n_numbers"), gate.root_cause(message).alias("cause"), c["category"].alias("category"), c["confidence"].alias("confidence"), gate.binary_kind(data).alias("kind"))


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch for each order: n lines replaced by r, between two lines of context, from line 10 on."""
    s = generated.order_shapes(spark, sf_dir)
    lines = lambda n, mark, text: F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit(f"{mark}{text} v"), i.cast("string"), F.lit("\n"))), "")).otherwise("")
    name = F.concat(F.lit("f"), F.col("o").cast("string"), F.lit(".h"))
    patch = F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -10,"), (F.col("n") + 2).cast("string"), F.lit(" +10,"), (F.col("r") + 2).cast("string"), F.lit(" @@\n head\n"), lines(F.col("n"), "-", "old"), lines(F.col("r"), "+", "new"), F.lit(" tail\n"))
    return s.select("o", "n", "r", name.alias("file"), patch.alias("patch"))


def _patch_lines(spark: SparkSession, patches: DataFrame) -> DataFrame:
    scans.register(spark)
    return spark.sql("SELECT d.* FROM {p} p, LATERAL diff_lines(p.patch) d", p=patches.select("patch"))


@query(f"""{_SHAPES}, t AS (SELECT o, n, r, unnest([5, 10, 11, 10 + n, 11 + n, 40]) AS l FROM s)
SELECT DISTINCT 'f' || o || '.h' AS file, l AS old_line, (CASE WHEN l <= 10 THEN l WHEN l <= 10 + n THEN CASE WHEN l <= 10 + r THEN l END ELSE l - n + r END)::BIGINT AS new_line FROM t""")
def mapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _patches(spark, sf_dir)
    targets = p.select("file", F.explode(F.array(F.lit(5), F.lit(10), F.lit(11), F.col("n") + 10, F.col("n") + 11, F.lit(40))).alias("old_line")).distinct()
    return diffs.map_lines(targets, _patch_lines(spark, p)).select("file", "old_line", F.col("new_line").cast("long").alias("new_line"))


@query(f"""{_SHAPES} SELECT 'f' || o || '.h' AS file, CASE WHEN r > 0 THEN 11 ELSE 10 END AS "begin", CASE WHEN r > 0 THEN 10 + r ELSE 10 END AS "end", CASE WHEN r > 0 THEN array_to_string(list_transform(range(1, r + 1), lambda i: 'new v' || i), chr(10)) END AS added, array_to_string(list_transform(range(1, n + 1), lambda i: 'old v' || i), chr(10)) AS removed FROM s""")
def changed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _patch_lines(spark, _patches(spark, sf_dir))
    block = lambda k, n: diffs.blocks(lines, k).select("file", F.col("content").alias(n))
    return diffs.changed_ranges(lines).select("file", "begin", "end").join(block("+", "added"), "file", "left").join(block("-", "removed"), "file", "left")


@query(f"""{_SHAPES}, t AS (SELECT o, 'f' || o || '.h' AS file, n, r, 11 AS l FROM s UNION ALL SELECT o, 'f' || o || '.h', n, r, 11 + n FROM s)
SELECT o AS target, file, l AS old_line, (CASE WHEN l = 11 THEN CASE WHEN r > 0 THEN 11 END ELSE 11 + r END)::BIGINT AS new_line, CASE WHEN l = 11 THEN CASE WHEN r = 0 THEN 'missing' ELSE 'renamed' END WHEN n = r THEN 'kept' ELSE 'moved' END AS status FROM t""")
def target_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _patches(spark, sf_dir)
    base = p.select(F.col("o").alias("target"), "file", F.lit(11).alias("old_line"), F.lit("old").alias("name"), F.lit("K").alias("owner")).unionByName(p.select(F.col("o").alias("target"), "file", F.col("n") + 11, F.lit("tail"), F.lit("K")).toDF("target", "file", "old_line", "name", "owner"))
    now = p.where("r > 0").select("file", F.lit(11).alias("line"), F.lit("new").alias("name"), F.lit("K").alias("owner")).unionByName(p.select("file", (F.col("r") + 11).alias("line"), F.lit("tail").alias("name"), F.lit("K").alias("owner")))
    return diffs.identity_verdicts(base, now, _patch_lines(spark, p)).select("target", "file", "old_line", F.col("new_line").cast("long").alias("new_line"), "status")


@query(f"""{_SHAPES} SELECT o AS target, n <= 3 AS deleted, sha256(array_to_string(list_transform(range(1, n + 1), lambda i: sha256('old v' || i)), chr(10))) AS digest FROM s""")
def deleted_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _patches(spark, sf_dir)
    content = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("old v"), i.cast("string"))), "\n")
    w = p.select(F.col("o").alias("target"), "file", F.lit(11).alias("begin"), diffs.deletion_witness(content, F.lit(1), F.col("n")).alias("w"), "n")
    # of longer declarations one line is another one
    hashes = F.transform("w.line_hashes", lambda h, i: F.when((i == 3) & (F.col("n") > 3), "x").otherwise(h))
    gone = diffs.anchor_deletions(w.select("target", "file", "begin", hashes.alias("line_hashes")), _patch_lines(spark, p))
    return gone.join(w.select("target", F.col("w.declaration_sha256").alias("digest")), "target").select("target", "deleted", "digest")


_CAND = "cand AS (SELECT p_partkey AS id, p_brand AS project, p_type AS file, p_size AS begin_line, p_retailprice AS metric_value, p_partkey % 4 <> 0 AS valid FROM part)"
_CURATED = f"""WITH {_CAND}, t AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY metric_value DESC, file, begin_line, id) AS turn FROM cand),
o1 AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY project, file, begin_line ORDER BY turn) = 1), o2 AS (SELECT * FROM o1 QUALIFY row_number() OVER (PARTITION BY project ORDER BY turn) <= 7),
sel AS (SELECT id FROM o2 ORDER BY turn, project LIMIT 30), cu AS (SELECT t.*, id IN (SELECT id FROM sel) AS selected FROM t)"""


def _curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("project"), F.col("p_type").alias("file"), F.col("p_size").alias("begin_line"), F.col("p_retailprice").alias("metric_value"))
    return ranking.curate(p, [*ranking.candidate_order("feature_envy"), F.col("id")])


@query(f"{_CURATED} SELECT id, project, turn, selected FROM cu")
def curated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curated(spark, sf_dir).select("id", "project", "turn", "selected")


@query(f"""{_CURATED}, k AS (SELECT * FROM cu WHERE selected AND valid), kc AS (SELECT project, count(*) AS c FROM k GROUP BY project),
sp AS (SELECT cu.*, 7 - coalesce(c, 0) AS room FROM cu LEFT JOIN kc USING (project) WHERE NOT selected AND valid AND (project, file, begin_line) NOT IN (SELECT (project, file, begin_line) FROM k)),
s1 AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY project, file, begin_line ORDER BY turn) = 1), s2 AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY project ORDER BY turn) <= room),
s3 AS (SELECT id FROM s2 ORDER BY turn, project LIMIT (SELECT greatest(30 - count(*), 0) FROM k))
SELECT id, false AS replacement FROM k UNION ALL SELECT id, true FROM s3""")
def valid_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.select_valid(_curated(spark, sf_dir), F.col("id") % 4 != 0)


_METHODS = "ms AS (SELECT (o % 400)::INT AS owner, 'm' || (o % 23) AS name, d AS arity, o % 3 > 0 AS private, o % 5 = 0 AS annotated, o FROM s), cl AS (SELECT (o % 400)::INT AS owner, 'm' || (c % 23) AS caller, r AS caller_arity, 'm' || ((o + c) % 23) AS name, d AS arity FROM s)"


@query(f"""{_SHAPES}, {_METHODS}, u AS (SELECT owner, name, arity FROM ms GROUP BY ALL HAVING count(*) = 1), r AS (SELECT DISTINCT owner, name, arity FROM cl WHERE (caller <> name OR caller_arity <> arity) AND (owner, name, arity) IN (SELECT (owner, name, arity) FROM u))
SELECT o, owner, name, arity FROM ms WHERE private AND NOT annotated AND (owner, name, arity) NOT IN (SELECT (owner, name, arity) FROM r)""")
def dead_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = generated.order_shapes(spark, sf_dir)
    name = lambda c, n: F.concat(F.lit("m"), (c % 23).cast("string")).alias(n)
    methods = s.select((F.col("o") % 400).cast("int").alias("owner"), name(F.col("o"), "name"), F.col("d").alias("arity"), (F.col("o") % 3 > 0).alias("private"), (F.col("o") % 5 == 0).alias("annotated"), "o")
    calls = s.select((F.col("o") % 400).cast("int").alias("owner"), name(F.col("c"), "caller"), F.col("r").alias("caller_arity"), name(F.col("o") + F.col("c"), "name"), F.col("d").alias("arity"))
    return findings.dead_code(methods, calls).select("o", "owner", "name", "arity")


@query(f"""WITH RECURSIVE {generated.SHAPES_SQL}, b AS (SELECT DISTINCT 'K' || (o % 40) AS owner, 'go' || (o % 6) AS name, d AS arity, o % 14 AS t FROM s),
e AS (SELECT 'K' || s_suppkey AS child, 'K' || (s_suppkey // 2) AS parent FROM supplier WHERE s_suppkey BETWEEN 1 AND 39), a AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT a.child, e.parent, depth + 1 FROM a JOIN e ON a.ancestor = e.child),
k AS (SELECT *, ['empty_override', 'unsupported_operation', 'empty_return', 'null_stub', 'constant_stub', 'logging_stub', 'empty_override', 'unsupported_operation', 'constant_stub', NULL, NULL, NULL, NULL, NULL][t + 1] AS kind FROM b), d AS (SELECT DISTINCT owner, name, arity FROM b)
SELECT DISTINCT k.owner, k.name, k.arity, k.kind, first_value(a.ancestor) OVER (PARTITION BY k.owner, k.name, k.arity, k.kind ORDER BY depth, a.ancestor) AS parent FROM k JOIN a ON a.child = k.owner JOIN d ON d.owner = a.ancestor AND d.name = k.name AND d.arity = k.arity WHERE kind IS NOT NULL""")
def refused_bequests(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = [
        "{ // return null;\n }", '{ throw new UnsupportedOperationException("a;b"); }', "{ return /* 1 */ ; }", "{ return null; }", "{ return 1.5f; }", '{ LOG.warn("no; " + x); }', "{ ; }", "{ throw unsupported(new java.lang.UnsupportedOperationException()); }", '{ return "a + b"; }',
        '{ LOG.warn("no"); log.info(x); }', "{ return -1; }", "{ return a + b; }", "{ x(); }", "{ if (a) { return null; } }",
    ]
    s = generated.order_shapes(spark, sf_dir)
    methods = s.select(F.concat(F.lit("K"), (F.col("o") % 40).cast("string")).alias("owner"), F.concat(F.lit("go"), (F.col("o") % 6).cast("string")).alias("name"), F.col("d").alias("arity"), F.get(F.array(*[F.lit(b) for b in bodies]), (F.col("o") % 14).cast("int")).alias("body")).distinct()
    k = lambda x: F.concat(F.lit("K"), x.cast("string"))
    edges = table(spark, sf_dir, "supplier").where(F.col("s_suppkey").between(1, 39)).select(k(F.col("s_suppkey")).alias("child"), k(F.expr("s_suppkey div 2")).alias("parent"))
    return findings.refused_bequests(methods, relations.ancestor_closure(edges))


@query("""WITH r AS (SELECT c_custkey AS file, CASE WHEN c_nationkey % 6 = 5 THEN '' ELSE 'p' || (c_nationkey % 6) END AS package, CASE WHEN c_custkey % 3 = 0 THEN ['x.T' || (c_custkey % 9), 'q.T' || (c_custkey % 9)] ELSE [] END AS imports, CASE c_custkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['p1'] WHEN 2 THEN ['z'] ELSE ['p1', 'p2'] END AS wildcards, CASE WHEN c_custkey % 8 = 2 THEN ['p3'] ELSE [] END AS statics,
CASE WHEN c_custkey % 11 = 0 THEN ['String', '', ''] WHEN c_custkey % 13 = 0 THEN ['a.B', '', ''] WHEN c_custkey % 17 = 0 THEN ['int', '', '[][]'] WHEN c_custkey % 19 = 0 THEN ['T' || (c_custkey % 9), '.In', '[]'] WHEN c_custkey % 23 = 0 THEN ['E', '', '[]'] WHEN c_custkey % 5 = 0 THEN ['T' || (c_custkey % 9), '', '[]'] ELSE ['T' || (c_custkey % 9), '', ''] END AS w FROM customer),
d AS (SELECT 'p' || (s_suppkey % 4) AS p, 'T' || (s_suppkey % 7) AS n FROM supplier WHERE s_suppkey BETWEEN 1 AND 26 AND s_suppkey % 4 <> 0),
x AS (SELECT *, w[1] AS h, (SELECT count(*) FROM d WHERE n = w[1] AND p = package) AS own, (SELECT count(*) FROM d WHERE n = w[1] AND (list_contains(wildcards, p) OR list_contains(statics, p))) AS hits, (SELECT min(p) FROM d WHERE n = w[1] AND (list_contains(wildcards, p) OR list_contains(statics, p))) AS src FROM r),
y AS (SELECT *, CASE WHEN h = 'E' THEN 'q.Bound' WHEN h = 'int' OR h = 'a.B' THEN h WHEN len(imports) > 0 AND imports[2] = 'q.' || h THEN imports[2] WHEN own = 1 THEN package || '.' || h WHEN own > 1 THEN '__ambiguous_java_type__' || h WHEN h = 'String' THEN 'java.lang.String' WHEN hits = 1 THEN src || '.' || h WHEN hits > 1 OR len(wildcards) > 1 THEN '__ambiguous_java_type__' || h WHEN len(wildcards) = 1 THEN wildcards[1] || '.' || h WHEN package <> '' THEN package || '.' || h ELSE h END AS o FROM x)
SELECT file, w[1] || w[2] || w[3] AS name, CASE WHEN w[2] <> '' AND (starts_with(o, '__') OR o = h) THEN h ELSE o END || w[2] || w[3] AS resolved FROM y""")
def resolved_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k, p = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_nationkey") % 6
    none = F.array().cast("array<string>")
    t = lambda x, m: F.concat(F.lit("T"), (x % m).cast("string"))
    listed = lambda *x: F.array(*[F.lit(v) for v in x])
    name = F.when(k % 11 == 0, "String").when(k % 13 == 0, "a.B").when(k % 17 == 0, "int[][]").when(k % 19 == 0, F.concat(t(k, 9), F.lit(".In[]"))).when(k % 23 == 0, "E[]").when(k % 5 == 0, F.concat(t(k, 9), F.lit("[]"))).otherwise(t(k, 9))
    wild = F.when(k % 4 == 0, none).when(k % 4 == 1, listed("p1")).when(k % 4 == 2, listed("z")).otherwise(listed("p1", "p2"))
    refs = c.select(k.alias("file"), F.when(p < 5, F.concat(F.lit("p"), p.cast("string"))).alias("package"), F.when(k % 3 == 0, F.array(F.concat(F.lit("x."), t(k, 9)), F.concat(F.lit("q."), t(k, 9)))).alias("imports"), wild.alias("wildcards"), F.when(k % 8 == 2, listed("p3")).otherwise(none).alias("static_wildcards"), F.create_map(F.lit("E"), F.lit("q.Bound")).alias("type_parameters"), name.alias("name"))
    s = F.col("s_suppkey")
    known = table(spark, sf_dir, "supplier").where(s.between(1, 26) & (s % 4 != 0)).select(F.concat(F.lit("p"), (s % 4).cast("string"), F.lit("."), t(s, 7)).alias("type"))
    return java.resolve_types(refs, known).select("file", "name", "resolved")


@query(f"""{_SHAPES} SELECT o, n AS methods, n + r AS assertions, (d > 1)::INT AS disabled, (r > 0)::INT AS skips, array_to_string(list_filter([CASE WHEN r > 1 THEN 'assertions_reduced' END, CASE WHEN d > 1 THEN 'disabled_increased' END], lambda x: x IS NOT NULL), '|') AS violations FROM s""")
def test_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = generated.order_shapes(spark, sf_dir)
    methods = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("@Test // @Test assertTrue(\n void t"), i.cast("string"), F.lit('() { assertEquals("assertTrue(", x); }\n'))), "")
    extra = F.repeat(F.lit("/* fail( */ void h() { assert x > 1; }\n"), F.col("r"))
    source = F.concat(methods, extra, F.when(F.col("d") > 1, "@Disabled class D {}\n").otherwise("// @Disabled\n"), F.when(F.col("r") > 0, "void a() { assumeTrue(y); }").otherwise(""))
    rows = s.select("o", "n", "r", code.test_strength(source).alias("t"))
    now = F.create_map(*[x for k in ("methods", "assertions", "disabled", "skips") for x in (F.lit(k), F.col(f"t.{k}"))])
    before = F.create_map(F.lit("methods"), F.col("n"), F.lit("assertions"), F.when(F.col("r") > 1, F.col("n") + F.col("r") + 1).otherwise(F.col("n")), F.lit("disabled"), F.lit(0), F.lit("skips"), F.lit(1))
    return rows.select("o", "t.methods", "t.assertions", "t.disabled", "t.skips", F.array_join(gate.test_change_violations(before, now), "|").alias("violations"))


@query("""WITH q AS (SELECT o_orderpriority AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT g, max(v) FILTER (rn = ceil(n * 0.5)::BIGINT) AS p50, max(v) FILTER (rn = ceil(n * 0.9::DOUBLE)::BIGINT) AS p90 FROM q GROUP BY g""")
def nearest_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.nearest_rank(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("v")), ["g"], "v", [0.5, 0.9])


@query("""WITH x AS (SELECT 'n' || s_nationkey AS project, 'f' || s_suppkey AS path, sha256(s_name) AS sha FROM supplier)
SELECT project, sha256('{' || string_agg('"' || path || '":"' || sha || '"', ',' ORDER BY path) || '}') AS tree_sha256 FROM x GROUP BY project""")
def tree_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("project"), F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"), F.sha2("s_name", 256).alias("sha256"))
    return files.tree_digest(s, ["project"])


@query("""WITH x AS (SELECT o_custkey AS project, year(o_orderdate)::INT AS revision, o_orderpriority AS command FROM orders) SELECT project, revision, count(*) AS n_rows FROM x GROUP BY ALL HAVING count(DISTINCT command) > 1""")
def conflicting_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.year("o_orderdate").alias("revision"), F.col("o_orderpriority").alias("command"))
    return ranking.conflicting(o, ["project", "revision"], ["command"])


@query("""SELECT count(*) AS plan_count, (SELECT count(*) FROM events)::BIGINT AS completed, false AS success, (SELECT count(*) FROM events WHERE event_type = 'purchase')::BIGINT AS passed, (SELECT count(DISTINCT event_type) FROM events)::BIGINT AS n_categories FROM customer""")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("execution_id"), F.when(F.col("event_type") == "purchase", "PASS").otherwise(F.col("event_type")).alias("category"))
    s = ranking.status_summary(table(spark, sf_dir, "customer"), e)
    return s.select("plan_count", "completed", "success", F.element_at("category_counts", "PASS").alias("passed"), F.size("category_counts").cast("long").alias("n_categories"))


@query(f"""{_CURATED} SELECT row_number() OVER (ORDER BY project, id) AS sample_id, project, file, begin_line, '{{"receiver_type":"r' || id || '","z":"say ""hi"", ok"}}' AS target_context_json FROM cu WHERE selected""".replace('""hi""', '\\"hi\\"'))
def sample_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _curated(spark, sf_dir).where("selected").withColumn("receiver", F.concat(F.lit("r"), F.col("id").cast("string")))
    rows = files.sample_rows(rows, ["project", "id"], {"z": F.lit('say "hi", ok'), "receiver_type": F.col("receiver")})
    path = fresh_path(spark, "sink")
    files.write_csv(rows.select("sample_id", "project", "file", "begin_line", "target_context_json"), path)
    return files.read_csv(spark, path, "sample_id long, project string, file string, begin_line int, target_context_json string")


@query("""SELECT c_custkey, c_mktsegment, 0::BIGINT AS broken FROM customer""")
def sealed_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "sink")
    files.capture_baseline(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), path)
    back = spark.read.parquet(path)
    return back.select("c_custkey", "c_mktsegment", F.lit(files.broken_seals(back).count()).cast("long").alias("broken"))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 AS res, o_totalprice AS red FROM orders WHERE o_orderkey % 7 <> 0)
SELECT o_custkey, arg_max(o_orderkey, (res, red, -o_orderkey)) AS o_orderkey FROM x GROUP BY o_custkey""")
def best_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.struct((F.col("o_orderkey") % 3).alias("resolution"), F.col("o_totalprice").alias("reduction"))).alias("rank"))
    return files.best_checkpoints(o, ["o_custkey"], "rank", "o_orderkey").select("o_custkey", "o_orderkey")


@query(f"""{_STEPS} SELECT event_id, k % 3 > 0 AS production FROM e""")
def path_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    path = F.when(k % 3 == 0, "src/test/java/A.java").when(k % 3 == 1, "src/main/java/A.java").otherwise("lib/x.py")
    return generated.event_steps(spark, sf_dir).select("event_id", diffs.production_source(path, F.when(k % 3 == 2, "python").otherwise("java")).alias("production"))


@query(f"""{_STEPS} SELECT event_id, CASE WHEN k % 4 = 3 THEN NULL ELSE k % 7 + 2 END::INT AS tests, CASE WHEN k % 4 = 3 THEN NULL ELSE (k % 5 = 0)::INT END AS failures, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 5 = 0 THEN 0 ELSE k % 7 + 1 END::INT AS executed,
CASE WHEN k % 3 = 0 THEN 'M:a.c|R100:b.c>c.c' WHEN k % 3 = 1 THEN 'A:d.py' ELSE NULL END AS changes, CASE k % 4 WHEN 0 THEN 'app/src/test' WHEN 1 THEN 'old/tests' ELSE NULL END AS root, ['test', 'production', 'build_metadata', 'other'][k % 4 + 1] AS category,
CASE WHEN k % 12 = 11 THEN 'INVALID_LOOP_POLICY: --max-smell-verify-cycles must be between 0 and 10' WHEN k % 6 = 0 THEN 'INVALID_LOOP_POLICY: --loop-no-progress-limit must be between 1 and 5' WHEN k < 60 THEN 'INVALID_LOOP_POLICY: --sample-deadline must be between 60 and 7200 seconds' END AS policy,
CASE WHEN k % 5 = 0 THEN 'PASS' WHEN k % 5 = 1 THEN 'NON_REPAIRABLE_FAILURE' WHEN k % 12 >= 8 THEN 'MAX_SMELL_VERIFY_CYCLES_REACHED' WHEN k % 6 >= 3 THEN 'NO_PROGRESS_LIMIT_REACHED' END AS ending FROM e""")
def reports_and_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    t, none = k % 4, F.array().cast("array<string>")
    case = lambda n: F.concat(F.lit("<testcase name='x'>"), n, F.lit("</testcase>"))
    failure = F.when(k % 5 == 0, "<failure/>").otherwise("")
    inside = F.concat(F.lit("<testsuite tests='1'>"), case(failure), F.lit("</testsuite><testsuite tests='"), (k % 7 + 1).cast("string"), F.lit("'>"), case(F.lit("<skipped/>")), F.lit("</testsuite>"))
    xml = F.when(t == 3, "<testsuites><broken").otherwise(F.concat(F.lit("<testsuites>"), inside, F.lit("</testsuites>")))
    e = generated.event_steps(spark, sf_dir).withColumn("content", xml)
    counts = scans.junit_reports(spark, e.select("event_id", "content")).select("event_id", "tests", "failures", "executed")
    payload = F.when(k % 3 == 0, "M\0a.c\0R100\0b.c\0c.c\0").when(k % 3 == 1, "A\0d.py\0").otherwise("R090\0x.c")
    changes = F.array_join(F.transform(scans.name_status(payload), lambda r: F.concat(r["status"], F.lit(":"), F.array_join(r["paths"], ">"))), "|")
    root = scans.test_root(F.when(t == 0, "app/src/test/java/A.java").when(t == 1, "old/tests/x.py").when(t == 2, "src/main/test/B.java").otherwise("lib/C.java"))
    category = gate.change_category(F.when(t == 0, "odd/name.c").when(t == 1, "src/main/A.java").when(t == 2, "a/CMakeLists.txt").otherwise("README.md"), F.array(F.lit("odd/name.c")))
    policy = gate.policy_problem(k % 12, k % 6, k, F.array(F.lit("smell"), F.lit("test")), F.lit("verify-failure"))
    ending = gate.loop_ending(k % 5 == 0, k % 5 != 1, k % 12, F.lit(8), k % 6, F.lit(3))
    return e.select("event_id", changes.alias("changes"), root.alias("root"), category.alias("category"), policy.alias("policy"), ending.alias("ending")).join(counts, "event_id", "left")


@query("""WITH e AS (SELECT user_id::VARCHAR AS session, event_id AS seq, CASE WHEN event_type IN ('purchase', 'error') THEN 'verify' ELSE event_type END AS tool, CASE WHEN event_type = 'error' AND value > 50 THEN 'error' ELSE 'completed' END AS status, event_type AS verdict FROM events),
x AS (SELECT *, max(CASE WHEN tool = 'verify' THEN seq END) OVER (PARTITION BY session) AS last_try, max(CASE WHEN tool = 'verify' AND status = 'completed' THEN seq END) OVER (PARTITION BY session) AS last_done FROM e)
SELECT session, count(*) FILTER (tool = 'verify') AS attempts, count(*) FILTER (tool = 'verify' AND status = 'completed') AS completed, count(*) FILTER (tool <> 'verify' AND seq > last_done) AS tools_after, max(CASE WHEN seq = last_done AND last_try = last_done THEN verdict END) AS last_status, count(*) AS events FROM x GROUP BY session""")
def tool_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.when(kind.isin("purchase", "error"), "verify").otherwise(kind).alias("tool"), F.when((kind == "error") & (F.col("value") > 50), "error").otherwise("completed").alias("status"), kind.alias("verdict"))
    return folds.tool_trace(e)


@query("""WITH s AS (SELECT c_custkey AS id, 'p' || c_nationkey AS project, CASE WHEN c_custkey % 3 = 0 THEN 'own' || c_custkey ELSE ' ' END AS test_command FROM customer),
p AS (SELECT 'p' || n_nationkey AS project, CASE WHEN n_nationkey % 2 = 0 THEN 'proj' || n_nationkey END AS test_command, 'b' || n_nationkey AS build_command FROM nation WHERE n_nationkey < 20)
SELECT id, coalesce(nullif(trim(s.test_command), ''), p.test_command, 'make check') AS test_command, coalesce(p.build_command, 'make') AS build_command, CASE WHEN project IN (SELECT project FROM p) THEN NULL ELSE 'PROJECT_REVISION_NOT_FOUND' END AS problem FROM s LEFT JOIN p USING (project)""")
def resolved_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias("project")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name("c_nationkey"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("own"), F.col("c_custkey").cast("string"))).otherwise(" ").alias("test_command"))
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string")
    project = n.where("n_nationkey < 20").select(name("n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("proj"), k)).alias("test_command"), F.concat(F.lit("b"), k).alias("build_command"))
    language = n.select(name("n_nationkey"), F.lit("make check").alias("test_command"), F.lit("make").alias("build_command"))
    known = project.select("project", F.lit("abc").alias("project_commit"), F.lit("def").alias("tree_hash"), F.lit(None).cast("string").alias("problem"))
    out = scans.resolve_settings(c, [project, language], "project", ["test_command", "build_command"])
    return scans.resolve_revisions(out, known).select("id", "test_command", "build_command", "problem")
