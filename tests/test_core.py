"""Every registered query against its SQL, and the rules, scans and diffs on small fixtures."""

import datetime as dt
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from codeprism.functions import gate, lexical, logs, rules, text
from codeprism.operators import clones, diffs, findings, ranking, relations
from codeprism.plans import catalog, code_catalog, verdict_catalog  # noqa: F401
from codeprism.sinks import files
from codeprism.sources import brace, scans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents benchmark pages conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(catalog.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    key = lambda r: tuple(repr(x) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)


def test_name_ladder(spark):
    want = {"tmp": "low_info_name", "a": "too_short", "id": None, "i": None, "x1": "too_short", "x123": "letter_digit", "zzzz": "repeated_char", "_": "too_short", "Data": "low_info_name", "total": None}
    got = spark.createDataFrame([(k,) for k in want], "n string").select("n", rules.name_reason(F.col("n"))).collect()
    assert {r[0]: r[1] for r in got} == want


def test_god_class_thresholds(spark):
    rows = [(5, 20, 100, False), (10, 30, 0, True), (4, 90, 900, False), (15, 50, 0, True), (5, 30, 100, True), (5, 29, 99, False)]
    got = spark.createDataFrame(rows, "nom long, wmc long, loc long, want boolean").select("want", rules.god_class(F.col("nom"), F.col("wmc"), F.col("loc"))).collect()
    assert all(a == b for a, b in got)


@pytest.mark.parametrize("access,total,cap", [(0, 0, 5), (4, 4, 4), (6, 10, 10), (5, 20, 8), (9, 10, 3)])
def test_envy_reduction(spark, access, total, cap):
    def brute():
        for r in range(access + 1):
            a, t = access - r, max(total - r, 0)
            d = max(a, min(t, cap))
            if (a / d if d else 0.0) < 0.6:
                return r
        return access

    row = spark.createDataFrame([(access, total, cap)], "a long, t long, c long").select(rules.envy_reduction(F.col("a"), F.col("t"), F.col("c"))).first()
    assert row[0] == brute()


def test_paths_and_groups(spark):
    r = spark.createDataFrame([("./Src\\A.CPP", "pkg.Foo#Bar.run(int a)", "group=a; x=1", "java.util.List:b|int:a")], "p string, m string, e string, g string")
    got = r.select(text.normalize_path(F.col("p")), text.language_of(F.col("p")), text.normalize_method(F.col("m")), text.evidence_value(F.col("e"), "x"), lexical.normalize_group(F.col("g")), lexical.erase_type(F.lit("final @A(x) Map<String, List<A<B<C>>>> ..."))).first()
    assert tuple(got) == ("src/a.cpp", "cpp", "run", "1", "int:a|list:b", "Map[]")


PATCH = """--- a/x.py
+++ b/x.py
@@ -1,3 +1,4 @@
 one
-two
+TWO
+two and a half
 three
@@ -10,3 +11,2 @@
 ten
-eleven
 twelve
"""


def test_diff_lines_map_and_blocks(spark):
    lines = spark.createDataFrame(list(scans.parse_patch(PATCH)), "file string, hunk int, kind string, old_line int, new_line int, content string")
    targets = spark.createDataFrame([("x.py", n) for n in (1, 2, 3, 7, 10, 11, 12, 20)], "file string, old_line int")
    got = {r["old_line"]: r["new_line"] for r in diffs.map_lines(targets, lines).collect()}
    assert got == {1: 1, 2: 2, 3: 4, 7: 8, 10: 11, 11: None, 12: 12, 20: 20}
    assert [tuple(r) for r in diffs.blocks(lines).collect()] == [("x.py", 1, 2, 3, "TWO\ntwo and a half")]
    assert {(r["begin"], r["end"]) for r in diffs.changed_ranges(lines).collect()} == {(2, 3), (11, 11)}
    with pytest.raises(ValueError):
        list(scans.parse_patch(PATCH[:-20]))


def test_functions_and_scan(spark, tmp_path):
    src = "def f(self, a, b=1, *c):\n    if a:\n        for x in b:\n            pass\n    elif b:\n        pass\n    else:\n        pass\n\ndef g():\n    return 1\n"
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "m.py").write_text(src)
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests" / "t.py").write_text(src)
    files = scans.source_files(spark, str(tmp_path))
    assert [r["path"] for r in files.collect()] == ["pkg/m.py"]
    got = {r["name"]: tuple(r)[2:] for r in scans.functions(spark, files).collect()}
    assert got == {"f": (1, 8, 3, 2, 4, 3), "g": (10, 11, 0, 0, 0, 0)}


def test_brace_scan():
    java = """package a;
public class Foo extends Bar<String> implements Baz, Qux<Integer> {
  private int x = 0, y;
  @Override(value = "}") public int run(final int a, Map<String, List<Integer>> m) throws E {
    if (a > 0 && m != null || x == 1) { for (int i = 0; i < a; i++) { x += i; } }
    else if (a < 0) { return run(a, m); }
    else { y = 2; }
    Runnable r = () -> { if (x > 0) { y++; } };
    Object o = new Object() { public String toString() { return "" + x; } };
    this.helper.doIt(a).z = other.field;
    return a > 0 ? 1 : 2;
  }
  Foo() { super(); }
}
"""
    functions, types = brace.scan(java, "java")
    assert [(f.owner, f.name, f.line, f.end_line, len(f.params)) for f in functions] == [("Foo", "run", 4, 12, 2), ("Foo", "toString", 9, 9, 0), ("Foo", "Foo", 13, 13, 0)]
    assert [(t.kind, t.name, t.supers, t.interfaces) for t in types if t.kind != "anonymous"] == [("class", "Foo", ["Bar"], ["Baz", "Qux"])]
    run = brace.parse_body(functions[0].body_text)
    # if 1, && and || 2, for 2, else-if 1, else 1, recursion 1, the lambda's if 2, ternary 1
    assert brace.cognitive(run, "run") == 11
    assert brace.nesting(run, "java") == 2
    assert sorted(brace.accesses(functions[0].body_text)) == [("other", "field", 7, False, False), ("this", "doIt", 7, False, True), ("this", "helper", 7, False, False), ("this", "z", 7, True, False)]
    assert [n for n, _ in brace.local_names(functions[0].body_text)] == ["i", "r", "o"]
    cpp = """#if A
class K : public Base {
  int a;
 public:
  K(int q) : a(q), v{1, 2} { a = 1; }
  bool operator==(const K& o) const { return a == o.a; }
  std::vector<int> v;
};
#else
int broken( {
#endif
static int K::run(struct foo *p, int arr[10], void (*cb)(int)) { try { f(); } catch (const E& e) { g(); } return 0; }
struct foo *mk(void) { return 0; }
"""
    functions, types = brace.scan(cpp, "cpp")
    assert [(f.owner, f.name, len(f.params)) for f in functions] == [("K", "K", 1), ("K", "operator==", 1), ("K", "run", 3), ("", "mk", 0)]
    assert types[0].supers == ["Base"] and brace.field_names(cpp[types[0].at : types[0].end][cpp[types[0].at :].find("{") :], "cpp") == ["a", "v"]
    masked = brace.mask('a = "x//y"; // c\n/* d\n */ \'"\' b')
    assert masked == "a =       ;     \n    \n        b" and len(masked) == len('a = "x//y"; // c\n/* d\n */ \'"\' b')
    assert brace.test_strength("@Test void a() { assertEquals(1, 2); /* @Test */ } @Disabled @Test void b() { assumeTrue(x); }") == (2, 1, 1, 1)


def test_python_accesses_fold_aliases():
    src = "def f(r, q):\n    x = r.part\n    x.go()\n    x = q\n    x.stop = 1\n    for x in y:\n        x.z\n"
    assert [t[3:] for t in scans.code_accesses(src, "python")] == [("r", "part", 2, False, False), ("r", "go", 3, False, True), ("q", "stop", 5, True, False), ("x", "z", 7, False, False)]
    nested = "def f():\n    with a:\n        try:\n            if b:\n                pass\n        except E:\n            pass\n"
    assert [r[6] for r in scans.code_functions(nested, "python")] == [1]


def test_failures_and_targets(spark):
    r = spark.range(1).select(logs.failure_fingerprint(F.lit(2), F.lit("one\ntwo\nthree\nfour")), logs.failure_fingerprint(F.lit(1), F.lit("")), gate.root_cause(F.lit("x: SCOPE_GONE now")), gate.root_cause(F.lit("a TARGET_AMBIGUOUS b")), gate.root_cause(F.lit("nothing")), rules.suspicious_context(F.lit('{"score": 1, "z": 2}')), rules.suspicious_context(F.lit("")), gate.binary_kind(F.unhex(F.lit("7F454C4602")))).first()
    assert tuple(r) == ("exit=2 | one | two | three", "exit=1", "SCOPE_GONE", "TARGET_AMBIGUOUS", "BASELINE_CAPTURE_FAILED", "target context cannot contain detector verdict fields: score", None, "elf")


def test_dead_code_and_bequests(spark):
    methods = spark.createDataFrame([("A", "used", 0, True, False, "{ x(); }"), ("A", "dead", 1, True, False, "{ dead(1); }"), ("A", "main", 1, True, False, "{}"), ("B", "go", 0, False, False, "{ throw new UnsupportedOperationException(); }"), ("P", "go", 0, False, False, "{ run(); }")], "owner string, name string, arity int, private boolean, annotated boolean, body string")
    calls = spark.createDataFrame([("A", "x", 0, "used", 0), ("A", "dead", 1, "dead", 1)], "owner string, caller string, caller_arity int, name string, arity int")
    assert [r["name"] for r in findings.dead_code(methods, calls).collect()] == ["dead"]
    # a call by an overload of the same name is no self-recursion
    assert findings.dead_code(methods, spark.createDataFrame([("A", "x", 0, "used", 0), ("A", "dead", 2, "dead", 1)], calls.schema)).collect() == []
    above = relations.ancestor_closure(spark.createDataFrame([("B", "P"), ("P", "Q")], "child string, parent string"))
    assert [tuple(r) for r in findings.refused_bequests(methods, above).collect()] == [("B", "go", 0, "unsupported_operation", "P")]
    with pytest.raises(ValueError):
        relations.ancestor_closure(spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "child string, parent string"))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b" * 70_000)], "sample_id int, decision string").withColumns({"evidence": F.lit("e"), "log": F.lit("l")})
    files.write_artifacts(rows.where("sample_id = 1"), str(tmp_path / "ok"))
    assert spark.read.json(str(tmp_path / "ok" / "decision")).first()["decision"] == "a"
    with pytest.raises(Exception, match="exceeds 65536"):
        files.write_artifacts(rows, str(tmp_path / "big"))
    files.capture_baseline(rows, str(tmp_path / "c000"))
    with pytest.raises(Exception, match="exists"):
        files.capture_baseline(rows, str(tmp_path / "c000"))
    back = spark.read.parquet(str(tmp_path / "c000"))
    assert files.broken_seals(back).count() == 0 and files.broken_seals(back.withColumn("log", F.lit("x"))).count() == 2
    files.append_results(rows.select("sample_id").limit(1), str(tmp_path / "r"))
    files.append_results(rows.select("sample_id").limit(1), str(tmp_path / "r"))
    assert files.read_csv(spark, str(tmp_path / "r"), "sample_id int").count() == 2
    files.write_json(rows.select("sample_id", "log"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).orderBy("value").first()[0] == '{"log":"l","sample_id":1}'
    assert files.markdown(rows.select("sample_id"), "T") == "# T\n\n| sample_id |\n| --- |\n| 1 |\n| 2 |\n"


def test_maximal_matches(spark):
    a = spark.createDataFrame([(1, "q a b c d e f z a b c"), (2, "x y")], "i int, text string")
    b = spark.createDataFrame([(7, "a b c d e f g a b c")], "j int, text string")
    got = {tuple(r) for r in clones.maximal_matches(a, "i", b, "j", n=3).collect()}
    assert got == {(1, 7, 1, 0, 6), (1, 7, 8, 0, 3), (1, 7, 1, 7, 3), (1, 7, 8, 7, 3)}
    assert tuple(clones.first_maximal_window(a, "i", b, "j", n=3).first()) == (1, 7, 1, 0, 6)
    assert clones.longest_match(a, "i", b, "j", n=3).first()["n_tokens"] == 6


def test_locations(spark):
    rows = spark.createDataFrame([("a.py:3;b.c:method=int f(int, char)|line=9 <-> c.cpp:class=K|line=1",)], "location string")
    got = [(r["location_file"], r["location_line"], r["location_name"], r["location_ok"]) for r in scans.locations(rows).collect()]
    assert got == [("a.py", 3, None, True), ("b.c", 9, "int f(int, char)", True), ("c.cpp", 1, "K", True)]


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    got = {(r[0], r[1], r[2]) for r in relations.ancestor_closure(e).collect()}
    assert {g for g in got if g[0] == "a"} == {("a", "b", 1), ("a", "c", 2)}


def test_round_robin_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice("abcde"), rng.choice("pqrstuvwxyz"), rng.randint(0, 50)) for i in range(120)]
    by = {}
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        by.setdefault(r[1], []).append(r)
    order = [by[p][k] for k in range(max(map(len, by.values()))) for p in sorted(by) if k < len(by[p])]
    seen, count, want = set(), {}, []
    for r in order:
        if len(want) < 30 and r[2] not in seen and count.get(r[1], 0) < 7:
            want.append(r[0])
            seen.add(r[2])
            count[r[1]] = count.get(r[1], 0) + 1
    got = ranking.round_robin(spark.createDataFrame(rows, "id int, p string, f string, m int"), "p", "f", [F.col("m").desc(), F.col("id")])
    assert [r["id"] for r in got.orderBy("place").collect()] == want


def test_streaming_sessions(spark, tmp_path):
    from codeprism.streaming import folds

    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(seconds=s)) for s in (0, 100, 399, 1000)] + [(2, t0 + dt.timedelta(days=1))]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "user_id long, ts timestamp").write.parquet(path)
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(path)
    q = folds.inactivity_sessions(stream).writeStream.format("memory").queryName("folds").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n_events"] for r in spark.sql("select * from folds where user_id = 1").collect()) == [1, 3]


def test_streaming_trace_resets(spark, tmp_path):
    from codeprism.streaming import folds

    schema = "session string, seq long, tool string, status string, verdict string"
    batches = [[("s", 1, "edit", "completed", None), ("s", 2, "verify", "completed", "FAIL"), ("s", 3, "edit", "completed", None)], [("s", 4, "verify", "error", None)], [("s", 5, "verify", "completed", "PASS"), ("s", 6, "read", "completed", None)]]
    (tmp_path / "in").mkdir()
    path = str(tmp_path / "in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    want = [("s", 1, 1, 1, "FAIL", 3), ("s", 2, 1, 1, None, 4), ("s", 3, 2, 1, "PASS", 6)]
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        q = folds.tool_trace(stream).writeStream.foreachBatch(lambda b, n: out.extend(tuple(r) for r in b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert out == want[: i + 1]
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    assert [tuple(r) for r in folds.tool_trace(whole).collect()] == want[2:]


def test_revision_manifest(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"projects": {"a": {"project_commit": "c1", "tree_hash": "t1"}, "b": {"project_commit": " ", "tree_hash": "t"}}}')
    got = scans.revisions(spark, str(tmp_path / "r.json"))
    assert {tuple(r) for r in got.collect()} == {("a", "c1", "t1", None), ("b", "", "t", "PROJECT_COMMIT_MISSING")}
    out = scans.resolve_revisions(spark.createDataFrame([(1, "a"), (2, "z")], "id int, project string"), got)
    assert {(r["id"], r["problem"]) for r in out.collect()} == {(1, None), (2, "PROJECT_REVISION_NOT_FOUND")}


def test_entry_schema(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["fingerprint", "n_members", "first_member", "last_member", "n_tokens"]
    assert all(re.fullmatch(r"\w+", k) for k in e.queries())


def test_sources_are_made_where_they_are_parsed(spark):
    plan = code_catalog.code_classes(spark, SF)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    # short rows are dealt out, by a hash that a join's partitioning doesn't make needless; texts are not
    assert moved and all("xxhash64" in line for line in moved)
    text = "class A { int f(int a) {\n if (a > 1) { a--; } return this.x; } }"
    f = brace.scan(text, "java")[0][0]
    again = brace.tokenize(brace.mask(f.code))
    assert [t.text for t in f.tokens] == [t.text for t in again] and f.tokens.pairs == again.pairs
    assert list(brace.accesses(f.code, 1, f.tokens)) == list(brace.accesses(f.code, 1))
    # a body that is never closed is read again from its text
    assert brace.scan("class A { void f() { this.xy", "java")[0][0].tokens == []


def test_signatures_run_over_many_tasks(spark):
    assert code_catalog.signatures(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_parameters_are_walked_by_marks(spark):
    texts = ["", ",", "a,b", "Map<String, int[]> a, b", "f(x, y), {1, 2}>, ]", "\n ,(,\U0001f600<", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(lexical._marks(F.col("t")).alias("m"), lexical.split_params(F.col("t")).alias("s"), lexical.split_java_types(F.col("t")).alias("j")).collect()
    assert ["".join(r.m) for r in rows] == [t or "" for t in texts]
    assert rows[3].m == ["Map", "<", "String", ",", " int", "[", "]", ">", " a", ",", " b"]
    assert [r.s for r in rows] == [[], [], ["a", "b"], ["Map<String, int[]> a", "b"], ["f(x, y)", "{1, 2}>", "]"], ["(,\U0001f600<"], []]
    assert rows[3].j == ["Map<String, int[]> a", " b"] and rows[4].j == ["f(x, y)", " {1", " 2}>", " ]"] and rows[0].j == []
