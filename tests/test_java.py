"""The Java model: parsing, type names, overloads, dead code; cases that the language's rules decide."""

import itertools
import random

import pytest

from codeprism.operators import java, relations
from codeprism.sources import java_model, scans
from codeprism.sources.java_model import parse, rejection

SOURCE = """package p.q;
import java.util.*; import a.B; import static c.D.*; import static c.E.f;
/** class Fake { void no() {} } */
@Deprecated @SuppressWarnings({"x","y"})
public abstract class Outer<T extends Number & Comparable<T>> extends Base<List<T>> implements I, J.K<int[]> {
  private static final Map<String, List<int[]>> m = new HashMap<>(), n;
  int a = helper(1), b[] = {1, 2}, c;
  { init0("s"); }
  static { boot('c'); }
  private T pick(final T x, @N("q") String... rest) throws E, F { int k = 3; for (Other o : all()) { o.go(k, x, "a;b{", (long) k, new Foo<>(1), new int[3], null, -1, this.c, pick(x)); } return x; }
  abstract void none(int z);
  Outer(int a) { super(a); this.a = a; Runnable r = this::run; r = () -> { run(); Outer.this.run(); }; new Thread(r).start(); }
  <R> R run() { return new Object() { int inner(int q) { return helper(q); } }.inner(2) > 0 ? null : (R) null; }
  enum Color { RED(1) { void paint() { brush(1L); } }, BLUE; private Color() { this(0); } Color(int z) { } void paint() {} }
  record Point(int x, String... y) { Point { check(x); } static int zero() { return 0; } }
  interface Deep { default int d() { return Collections.<String>emptyList().size(); } int e(); }
  @interface Ann { int value() default 3; }
}
class Second { Outer.Point pt; String s() { return ""; } void u() { s().length(); pt.x(); a.B.go(1.5f, 1e3, 0x1F, 2.0, 10L, true, 'c'); int[] w, z[] = null; foo(w, z); try (Res r = open()) { r.close(); } catch (Ex e) { log(e); } } }
"""


def test_parse():
    d = parse(SOURCE)
    assert (d["package"], d["imports"], d["wildcards"], d["static_wildcards"]) == ("p.q", ["a.B", "c.E.f"], ["java.util"], ["c.D"])
    assert [(t["type"], t["kind"], t["supers"]) for t in d["types"]] == [("p.q.Outer", "class", ["Base", "I", "J.K"]), ("p.q.Outer.Color", "enum", []), ("p.q.Outer.Point", "record", []), ("p.q.Outer.Deep", "interface", []), ("p.q.Second", "class", [])]
    assert [tuple(f.values()) for f in d["types"][0]["fields"]] == [("m", "Map"), ("n", "Map"), ("a", "int"), ("b", "int[]"), ("c", "int")]
    methods = [(m["owner"].rsplit(".", 1)[1], m["name"], [p["kind"] for p in m["params"]], m["varargs"], m["is_constructor"], m["returns"]) for m in d["methods"]]
    assert methods == [
        ("Outer", "pick", ["Number", "String[]"], True, False, "Number"), ("Outer", "Outer", ["int"], False, True, ""), ("Outer", "run", [], False, False, "java.lang.Object"),
        ("Color", "Color", [], False, True, ""), ("Color", "Color", ["int"], False, True, ""), ("Color", "paint", [], False, False, "void"),
        ("Point", "Point", ["int", "String[]"], False, True, ""), ("Point", "zero", [], False, False, "int"), ("Deep", "d", [], False, False, "int"), ("Second", "s", [], False, False, "String"), ("Second", "u", [], False, False, "void"),
    ]
    calls = {(c["name"], c["receiver"]): (c["receiver_kind"], c["receiver_type"], c["arguments"], c["reference"], c["caller"]) for c in d["calls"]}
    assert calls["go", "o"] == ("value", "Other", ["int", "Number", "java.lang.String", "long", "Foo", "int[]", "<null>", "", "int", "Number"], False, 0)
    assert calls["run", "this"] == ("this", "", [], True, 1) and calls["run", "Outer.this"][:2] == ("outer", "Outer")
    assert calls["helper", ""][2:] == (["int"], False, None) and calls["boot", ""][2] == ["char"] and calls["brush", ""][2] == ["long"]
    assert calls["length", "s()"][:2] == ("value", "String") and calls["x", "pt"][:2] == ("value", "Outer.Point") and calls["emptyList", "Collections"][:2] == ("type", "Collections")
    assert calls["go", "a.B"][2] == ["float", "double", "int", "double", "long", "boolean", "char"] and calls["foo", ""][2] == ["int[]", "int[][]"] and calls["close", "r"][1] == "Res"
    assert not {"super", "this", "inner", "Fake", "no"} & {c["name"] for c in d["calls"]} - {"inner"}


@pytest.mark.parametrize("text", ["", "class", "class A {", "} } ;", "class A { void f( }", "enum E { A, B", "@", "class A<T { int x = (; }", "interface I { void f(); } \x0c class B { }"])
def test_parse_survives_damage(text):
    parse(text)


def test_parse_takes_linear_time():
    import time

    took = []
    for n in (500, 4000):
        source = "class A {\n" + "".join(f"  int m{i}(int x) {{ if (x > {i}) {{ return m{i}(x - 1); }} return other.go(x, \"{i}\"); }}\n" for i in range(n)) + "}\n"
        began = time.process_time()
        assert len(parse(source)["methods"]) == n
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]


@pytest.mark.parametrize(
    ("body", "kind"),
    [
        ("{ }", "empty_override"), ("{ /* return null; */ // x\n }", "empty_override"), ("{ ; }", "empty_override"), ('{ throw new UnsupportedOperationException("a;b"); }', "unsupported_operation"), ("{ throw new IllegalStateException(); }", ""),
        ("{ return; }", "empty_return"), ("{ return null; }", "null_stub"), ("{ return 1; }", "constant_stub"), ("{ return -1; }", ""), ('{ return "a" ; }', "constant_stub"), ("{ return 'c'; }", "constant_stub"), ("{ return true; }", "constant_stub"), ("{ return x; }", ""),
        ('{ LOG.warn("a"); }', "logging_stub"), ('{ System.out.println("a;b"); }', "logging_stub"), ('{ LOG.warn("a"); log.info("b"); }', ""), ("{ logs.warn(x); }", ""), ("{ LOG.close(); }", ""), ("{ if (a) { return null; } }", ""), ("{ return null; return null; }", ""), (None, ""),
    ],
)
def test_rejection(body, kind):
    assert rejection(body) == kind


def test_resolve_types(spark):
    refs = [("p", ["a.X", "b.X"], ["b", "c"], n) for n in ("X", "Y", "String", "q.Z", "W", "Nope", "X.In", "w.In", "int[]", "List<X>", "@A final W...", "", "Y.In")]
    refs += [("", None, None, "V"), ("", None, ["b"], "V"), (None, [], ["b"], "Q"), ("p", [], [], "Dup"), ("p", [], [], "T[]")]
    df = spark.createDataFrame([(*r, {"T": "q.Bound"}) for r in refs], "package string, imports array<string>, wildcards array<string>, name string, type_parameters map<string,string>")
    known = spark.createDataFrame([("b.Y",), ("c.Y",), ("p.W",), ("b.W",), ("p.Dup",), ("p.Dup",), ("V",)], "type string")
    got = {(r.package or "", tuple(r.wildcards or ()), r.name): r.resolved for r in java.resolve_types(df, known).collect()}
    p, none = ("p", ("b", "c")), ("p", ())
    amb = java.AMBIGUOUS
    assert got == {
        (*p, "X"): "b.X", (*p, "Y"): f"{amb}Y", (*p, "String"): "java.lang.String", (*p, "q.Z"): "q.Z", (*p, "W"): "p.W", (*p, "Nope"): f"{amb}Nope", (*p, "X.In"): "b.X.In", (*p, "w.In"): "w.In", (*p, "int[]"): "int[]",
        (*p, "List<X>"): f"{amb}List", (*p, "@A final W..."): "p.W[]", (*p, ""): "Object", (*p, "Y.In"): "Y.In",
        ("", (), "V"): "V", ("", ("b",), "V"): "V", ("", ("b",), "Q"): "b.Q", (*none, "Dup"): f"{amb}Dup", (*none, "T[]"): "q.Bound[]",
    }


def test_nulls_are_told_from_texts(spark):
    df = spark.createDataFrame([(None, "x", "A"), ("x", None, "A")], "package string, z string, name string").selectExpr("*", "array() AS imports", "array() AS wildcards")
    got = {r.z: r.resolved for r in java.resolve_types(df, spark.createDataFrame([("x.A",), ("A",)], "type string")).collect()}
    assert got == {"x": "A", None: "x.A"}


TYPES = [("p.A", ["p.I"]), ("p.B", ["p.A"]), ("p.C", ["B"]), ("p.I", []), ("q.X", ["p.Missing"])]
METHODS = [
    (1, "p.A", "f", ["int"], False, ["private"]), (2, "p.A", "f", ["java.lang.String"], False, ["private"]), (3, "p.A", "f", ["java.lang.Object"], False, ["private"]),
    (4, "p.A", "g", ["long"], False, []), (5, "p.A", "g", ["java.lang.Integer"], False, []), (6, "p.A", "g", ["int[]"], True, []),
    (7, "p.B", "h", ["p.I"], False, ["public"]), (8, "p.B", "h", ["p.A"], False, ["public"]), (9, "p.B", "h", ["p.B"], False, ["public"]),
    (10, "p.A", "k", ["p.A", "p.I"], False, []), (11, "p.A", "k", ["p.I", "p.A"], False, []), (12, "p.A", "v", ["java.lang.Object[]"], True, []), (13, "p.B", "pr", [], False, ["protected"]), (14, "p.A", "z", [], False, ["private"]),
]
CALLS = [  # owners, name, arguments, caller's owner, receiver, reference: target, state
    (["p.A"], "f", ["java.lang.String"], "p.A", "", False, 2, "resolved"), (["p.A"], "f", ["<null>"], "p.A", "", False, 2, "resolved"), (["p.A"], "f", ["byte"], "p.A", "", False, 1, "resolved"), (["p.A"], "f", [""], "p.A", "", False, None, "unknown_argument"),
    (["p.A"], "g", ["int"], "p.A", "", False, 4, "resolved"), (["p.A"], "g", ["java.lang.Integer"], "p.A", "", False, 5, "resolved"), (["p.A"], "g", ["int", "int"], "p.A", "", False, 6, "resolved"), (["p.A"], "g", [], "p.A", "", False, 6, "resolved"),
    (["p.C"], "h", ["p.C"], "p.A", "", False, 9, "resolved"), (["p.C"], "h", ["p.I"], "p.A", "", False, 7, "resolved"), (["p.A"], "k", ["p.A", "p.A"], "p.A", "", False, None, "ambiguous"), (["p.B"], "f", ["int"], "p.B", "", False, None, "no_method"),
    (["p.A"], "v", ["int"], "p.A", "", False, 12, "resolved"), (["p.A"], "v", ["int[]"], "p.A", "", False, 12, "resolved"), (["p.A"], "v", ["java.lang.String[]"], "p.A", "", False, 12, "resolved"), (["p.A"], "f", ["q.X"], "p.A", "", False, None, "unproven"),
    (["p.C"], "pr", [], "q.X", "", False, None, "not_accessible"), (["p.A"], "z", [], None, "", False, None, "not_accessible"), (["q.X", "p.A"], "z", [], "p.A", "this", False, 14, "resolved"), (["p.A"], "k", ["p.A"], "p.A", "", False, None, "not_applicable"),
    (["p.A"], "z", [], "p.A", "this", True, 14, "resolved"), (["p.A"], "f", [], "p.A", "this", True, None, "ambiguous"), ([], "f", [], "p.A", "super", False, None, "no_method"),
]


def test_resolve_calls(spark):
    types = spark.createDataFrame(TYPES, "type string, supers array<string>")
    methods = spark.createDataFrame([(*m, [], False) for m in METHODS], "id int, owner string, name string, params array<string>, varargs boolean, modifiers array<string>, annotations array<string>, is_constructor boolean")
    calls = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(CALLS)], "call int, owners array<string>, name string, arguments array<string>, caller_owner string, receiver string, reference boolean")
    got = {r.call: (r.target, r.state) for r in java.resolve_calls(calls.unionByName(calls), methods, types).collect()}
    want = {i: c[6:] for i, c in enumerate(CALLS)}
    assert got == want
    assert java.resolve_calls(calls.limit(0), methods, types).count() == 0
    assert {r.state for r in java.resolve_calls(calls, methods.limit(0), types.limit(0)).collect()} == {"no_method"}


def test_closure_against_walks(spark):
    rng = random.Random(4)
    for n, hops in ((12, 20), (40, 40)):
        edges = {(f"t{rng.randrange(n)}", f"t{rng.randrange(n)}") for _ in range(n)} | {(f"c{i}", f"c{i + 1}") for i in range(17)}
        edges = {(a, b) for a, b in edges if a != b}
        up = {}
        for a, b in edges:
            up.setdefault(a, set()).add(b)
        want = set()
        for a in up:
            seen, front = {a: 0}, [a]
            for depth in itertools.count(1):
                front = [y for x in front for y in up.get(x, ()) if y not in seen and not seen.update({y: depth})]
                if not front:
                    break
            want |= {(a, b, d) for b, d in seen.items() if d}
        assert {tuple(r) for r in relations.ancestor_closure(spark.createDataFrame(sorted(edges), "child string, parent string"), hops).collect()} == want


FILES = {
    "SameName.java": "class SameNameTarget {\n  private void helper() {}\n}\nclass SameNameCaller {\n  void live() { helper(); }\n  void helper() {}\n}\n",
    "Over.java": 'class Over {\n  private void select(int v) {}\n  private void select(String v) {}\n  private void mixed(int v) {}\n  void mixed(String v) {}\n  private void unsure(String v) {}\n  private void unsure(Object v) {}\n  void live() { select("used"); mixed("public overload"); unsure(null); }\n}\nclass Api { void inherited(String v) {} }\nclass Below extends Api {\n  private void inherited(int v) {}\n  void live() { inherited("parent"); }\n}\n',
    "Loop.java": "class Loop { private void loop() { loop(); } }\n",
    "Used.java": "class Used {\n  private void used() {}\n  private static void staticUsed() {}\n  private void receiverUsed() {}\n  private void referenceUsed() {}\n  void live(Used peer) { used(); Used.staticUsed(); peer.receiverUsed(); Runnable r = this::referenceUsed; }\n}\n",
    "notes.txt": "class NoJava { private void idle() {} }",
}


def test_dead_code_from_sources(spark):
    files = spark.createDataFrame([(k, "java" if k.endswith("java") else "text", v) for k, v in FILES.items()] + [("Null.java", "java", None), ("Empty.java", "java", "")], "path string, language string, content string")
    types, methods, calls = java_model.project_model(files)
    dead = {(r.owner, r.name, *r.params) for r in java.dead_methods(calls, methods, types).collect()}
    assert dead == {("SameNameTarget", "helper"), ("Over", "select", "int"), ("Over", "mixed", "int"), ("Over", "unsure", "java.lang.Object"), ("Below", "inherited", "int"), ("Loop", "loop")}
    types, methods, calls = java_model.project_model(files.limit(0))
    assert java.dead_methods(calls, methods, types).collect() == []


def named(source, language):
    return [(f[0], f[1], f[4]) for f in scans.code_functions(source, language)]


def test_scans_of_templates_enums_and_anonymous_types():
    cpp = "template <class T> class A { T f(int a) { return a; } };\ntemplate<class U, class V = B<U>> U g(V v) { return v; }\nstruct S { T operator()(int x) { return x; } bool operator==(const S& o) const { return true; } };\nT N::S::operator+(int y) { return y; }\ntemplate <> int A<int>::h(int z) { return z; }"
    assert named(cpp, "cpp") == [("A", "f", 1), ("", "g", 1), ("S", "operator()", 1), ("S", "operator==", 1), ("N.S", "operator+", 1), ("A", "h", 1)]
    assert [c[1] for c in scans.code_classes(cpp, "cpp")] == ["A", "S"]
    source = "enum E { A(1) { void f() { x(); } }, B { int g() { return 1; } }; E(int a) { } void h() { } }\nrecord P(int x) { P { check(x); } }\nclass C { Runnable r = new Runnable() { public void run() { go(); } }; int q = 1; void m() { } }"
    assert named(source, "java") == [("E", "f", 0), ("E", "g", 0), ("E", "E", 1), ("E", "h", 0), ("P", "P", 0), ("C", "run", 0), ("C", "m", 0)]
    assert named("int f(int a) { return a; }\nstruct s { int x; };\nstatic struct s g(void) { struct s v = { 1 }; return v; }", "c") == [("", "f", 1), ("", "g", 0)]


def test_lines_end_at_line_feeds_alone():
    assert list(scans.parse_patch("--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\x0cb\n-c\u2028\n+d\n")) == [("x", 1, " ", 1, 1, "a\x0cb"), ("x", 1, "-", 2, None, "c\u2028"), ("x", 1, "+", None, 2, "d")]
    assert [(f[1], f[12], f[13]) for f in scans.code_functions("x = 1\n\x0c\ndef f(a):\n    return a\n", "python")] == [("f", "def f(a):", "    return a")]


def test_only_calls_that_may_reach_a_candidate_are_resolved(spark, monkeypatch):
    files = spark.createDataFrame([("A.java", "class A { private void f(int x) {} private void g() {} void r() { f(1); open(); B.f(2); } } class B { static void f(int x) {} void q() { g(); r(); } }")], "path string, content string")
    types, methods, calls = java_model.project_model(files)
    seen, whole = [], java.resolve_calls
    monkeypatch.setattr(java, "resolve_calls", lambda c, *rest: seen.append(c) or whole(c, *rest))
    assert [(r.owner, r.name) for r in java.dead_methods(calls, methods, types).collect()] == [("A", "g")]
    assert sorted((r.name, r.caller_owner) for r in seen[0].collect()) == [("f", "A"), ("f", "A")] and calls.count() == 5


def test_pairs_of_types_are_made_once(spark):
    types = spark.createDataFrame([("p.A", [])], "type string, supers array<string>")
    pairs = spark.createDataFrame([("int", "long"), ("p.A", "p.B")], "argument string, parameter string").withColumn("argument", java.F.concat("argument", java.F.substring(java.F.uuid(), 1, 0)))
    told = java.conversions(pairs, types, java.hierarchy(types))
    assert "uuid" not in told._jdf.queryExecution().toString()
    assert {tuple(r) for r in told.collect()} == {("int", "long", "compatible", "compatible"), ("p.A", "p.B", "unknown", "unknown")}
