"""Texts that are alike but for the numbers in their names are scanned once, with the rows of a scan of each."""

from pyspark.sql import functions as F

from codeprism.functions import lexical
from codeprism.operators import findings, java, relations
from codeprism.plans import code_catalog
from codeprism.sources import alike, java_model, scans

JAVA = 'class C12 extends B3 { int f1 = 0x1F; /* C12 */ @A1("x%s9") int m7(int a1, List<T2> a2) { if (a1 > 2 && b3.x1 == 1e5) { m7(a1, null); } String s = "a1%d"; for (int i9 = 0; i9 < 3; i9++) { a1.f2 = x[i9].g3(); } return this.f1; } }'
PYTHON = "class C12(B3):\n    z9 = 1\n    def m7(self, a1: 'int64' = 3, *b2):\n        if a1:\n            self.q1 = b2.x3\n        elif a1 == 2:\n            pass\n        return x1.y2()\n"
C = "#if A1\nint f1(int a2)\n{\n#else\nint f1(void) {\n#endif\n if (a2 > 0x10) { switch (a2) { case 1: break; default: ; } }\n char c = 'a'; long q = 1'000; return g2(\"}1\");\n}\n"
CPP = "namespace n1 { template <class T1> class C22 : public B1<T1> { C22(int a) : x1{a} {} enum E3 { A1, B2 }; bool operator()(int z1) { return z1; } ~C22() {} }; }\nint n1::C22<T1>::o5(int q) { while (q) q--; }\n"
ODD = [("python", "x = 0x1F\nb = b'a1'\ndef f1(a=1_000):\n    return '\\x41'\n"), ("java", "class \xe91 { int \ua0001() { } }"), ("python", "def f1(:"), ("c", "int a1() { x2"), ("java", ""), ("cobol", "f1")]


def test_alike_texts_have_their_own_rows():
    texts = [(language, text) for language, t in [("java", JAVA), ("python", PYTHON), ("c", C), ("cpp", CPP), *ODD] for text in (t, t.replace("12", "345"), t.replace("1", "7"), t.replace("1", "01"), t.replace("12", "3"))]
    for what, (scan, fields) in scans._SCANS.items():
        columns = tuple(f.split()[0] for f in fields.split(", "))
        for language, text in texts:
            assert [list(r) for r in scans._scan(what, columns)(text, language)] == [list(r) for r in scan(text, language)], (what, language, text)


def test_alike_texts_are_scanned_once():
    seen = []

    def scan(text):
        seen.append(text)
        yield text, [text.upper()], {"k": ["100%", text]}

    rows = alike.alike(scan)
    for n in ("1", "22", "333"):
        assert list(rows(f"a{n} b7 c{n} {{4}}")) == [(f"a{n} b7 c{n} {{4}}", [f"A{n} B7 C{n} {{4}}"], {"k": ["100%", f"a{n} b7 c{n} {{4}}"]})]
    assert len(seen) == 1
    # other numbers, another pattern of equal ones, and long texts are others
    for text in ("a1 b7 c1 {5}", "a1 b7 c2 {4}", "a1" * alike.MOST_CHARS):
        assert list(rows(text))[0][0] == text
    assert len(seen) == 4 and seen[-1] == "a1" * alike.MOST_CHARS


def test_only_asked_columns_are_made(spark):
    files = spark.createDataFrame([("A.java", "java", JAVA)], "path string, language string, content string")
    found = scans.scan_code(spark, files, "functions", columns=["name", "language", "n_params"])
    assert found.columns == ["name", "language", "n_params"] and [tuple(r) for r in found.collect()] == [("m7", "java", 2)]


def test_columns_by_value_are_those_of_each_row(spark):
    texts = ["int p.C.m(final List<String> a, int[] b)", "x(final List<String> a, int[] b)", "plain", "f()", "f( )", None, None, "a.b(java.util.Map<A, B> m, @X(1) q.R... r)"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, sig string")
    listed = F.concat(F.lit("("), F.col("p"), F.lit(")"))
    java = F.lit("java")
    got = relations.by_value(rows, {"p": lexical.parameter_list(F.col("sig"))}, lambda: {"n": lexical.count_params(listed, java), "f": lexical.parameter_fingerprints(listed, java), "t": lexical.java_type_fingerprint(listed), "k": lexical.stable_kinds(F.col("p")), "q": lexical.stable_kinds(F.col("p"), True)})
    sig, key = F.col("sig"), F.concat(F.lit("./a#b#"), F.col("sig"))
    got = got.select("i", "n", "f", "t", lexical.stable_signature(sig, kinds=F.col("k")), lexical.stable_signature(sig, True, F.col("q")), lexical.stable_clone_identity(key, F.col("q")))
    plain = rows.select("i", lexical.count_params(sig, java), lexical.parameter_fingerprints(sig, java), lexical.java_type_fingerprint(sig), lexical.stable_signature(sig), lexical.stable_signature(sig, True), lexical.stable_clone_identity(key))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_signatures_take_equal_lists_apart_once(spark):
    plan = code_catalog.signatures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan  # walks over parameters stand in the table of distinct lists


def test_envy_counts_accesses_once(spark):
    files = spark.createDataFrame([("A.java", "java", "class A { int f(B o, B p) { o.x(); p.y(); p.z = 1; o.w(); return this.q + o.v; } int g() { return this.q; } }")], "path string, language string, content string")
    e = findings.feature_envy(scans.scan_code(spark, files, "functions"), scans.scan_code(spark, files, "accesses"))
    # a function without foreign accesses is none's; the most accesses decide, and all of them are the total
    assert [tuple(r) for r in e.select("name", "receiver", "access", "total").collect()] == [("f", "o", 3, 6)]
    assert e._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # one pass over the functions, one over the accesses


def test_java_models_of_alike_texts():
    models = java_model._models()
    before = "package p2;\nimport q1.T4;\n@Keep1 class C12 extends B2 { int f1 = 0x1F; double g = 1e5; class In3 { } private void m7(int a1, T4... t) { m7(a1, this.f1); new C12().m7(1, 2L); Runnable r9 = this::m8; } String m8() { return \"x1\"; } }"
    for text in (before, before.replace("12", "345"), before.replace("1", "2"), before.replace("7", "8"), before.replace("0x1F", "0x2F"), "class \ua000 { }", "", "class A1 {"):
        assert list(models(text)) == [tuple(java_model.parse(text).values())], text
    # the same parse stands behind texts with other numbers in their names
    assert next(models("interface Q1 { }"))[0] is next(models("interface Q2 { }"))[0] and next(models("interface Q2 { }"))[4][0]["type"] == "Q2"


def test_keys_are_short_and_tell_nulls_apart(spark):
    rows = spark.createDataFrame([(None, ["a"]), ("", ["a"]), ("", []), ("", None), ("x", ["a", "b"]), ("x", ["a,b"])], "s string, l array<string>")
    keys = [bytes(r[0]) for r in rows.select(java._key("s", "l")).collect()]
    assert len(set(keys)) == 6 and {len(k) for k in keys} == {16}
