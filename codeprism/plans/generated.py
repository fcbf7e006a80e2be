"""Sources, logs, signatures and patches made from the driver's tables, so that parsers run on many rows whose right results the tables tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def order_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o, c (order and customer), n (lines), r (of them returned), d (n modulo 4)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("l_returnflag") == "R").cast("int").alias("r"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"))
    return orders.join(lines, F.col("o") == F.col("l_orderkey")).select("o", "c", "n", "r", (F.col("n") % 4).alias("d"))


#: The same in SQL.
SHAPES_SQL = "s AS (SELECT o_orderkey AS o, o_custkey AS c, count(*)::INT AS n, count_if(l_returnflag = 'R')::INT AS r, (count(*) % 4)::INT AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"


def _each(n: Column, make) -> Column:
    """make(i) for i = 1 to n, one after the other."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), make), "")).otherwise("")


def _text(c: Column) -> Column:
    return c.cast("string")


def java_source(s: DataFrame) -> DataFrame:
    """o, path, language and content: a class C<c> extends B<c mod 5> with one method m<o> of n parameters, d nested ifs and r cases."""
    params = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("final Map<String, int[]> a"), _text(i))), ", ")
    ifs = _each(F.col("d"), lambda i: F.concat(F.lit("    if (a1 != null && f > "), _text(i), F.lit(") {\n")))
    cases = _each(F.col("r"), lambda i: F.concat(F.lit("      case "), _text(i), F.lit(":\n        other.total = f;\n")))
    switch = F.when(F.col("r") > 0, F.concat(F.lit("    switch (f) {\n"), cases, F.lit("    }\n"))).otherwise("")
    content = F.concat(
        F.lit("package p;\n// class Fake { void no() {} }\npublic class C"), _text(F.col("c")), F.lit(" extends B"), _text(F.col("c") % 5), F.lit(" implements I {\n  private int f = 0;\n  int m"), _text(F.col("o")), F.lit("("), params,
        F.lit(') {\n    String t = "if (x) { } /* switch */";\n'), ifs, F.lit("    this.f++;\n"), F.repeat(F.lit("    }\n"), F.col("d")), switch, F.lit("    return helper.size();\n  }\n}\n"),
    )
    return s.select("o", "c", "n", "r", "d", F.concat(F.lit("src/C"), _text(F.col("c")), F.lit(".java")).alias("path"), F.lit("java").alias("language"), content.alias("content"))


def python_source(s: DataFrame) -> DataFrame:
    """The same in Python: n parameters behind self, d nested ifs, a chain of r branches, and n uses of an alias."""
    params = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("a"), _text(i), F.when(i % 2 == 0, ": int = 0").otherwise(": str = ''"))), ", ")
    pad = lambda i: F.repeat(F.lit("    "), i)
    ifs = _each(F.col("d"), lambda i: F.concat(pad(i + 1), F.lit("if self.f > "), _text(i), F.lit(":\n")))
    chain = _each(F.col("r"), lambda i: F.concat(F.lit("        "), F.when(i == 1, "if").otherwise("elif"), F.lit(" a1 == "), _text(i), F.lit(":\n            other.total = 1\n")))
    uses = _each(F.col("n"), lambda i: F.concat(F.lit("        x.use"), _text(i), F.lit("()\n")))
    content = F.concat(
        F.lit("# class Fake: pass\nclass C"), _text(F.col("c")), F.lit("(B"), _text(F.col("c") % 5), F.lit("):\n    g = 1\n\n    def m"), _text(F.col("o")), F.lit("(self, "), params, F.lit("):\n        x = helper.part\n"),
        ifs, pad(F.col("d") + 2), F.lit("self.f = 1\n"), chain, uses, F.lit("        return x\n"),
    )
    return s.select("o", "c", "n", "r", "d", F.concat(F.lit("lib/c"), _text(F.col("c")), F.lit(".py")).alias("path"), F.lit("python").alias("language"), content.alias("content"))


def native_source(s: DataFrame) -> DataFrame:
    """A C and a C++ file of each order: a function behind a preprocessor branch, initialisers, a template class in a namespace, operators, a method outside of its class."""
    o, k = _text(F.col("o")), _text(F.col("o") % 3)
    params = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.when(i % 2 == 0, "const struct s *a").otherwise("unsigned long a"), _text(i))), ", ")
    ifs = _each(F.col("d"), lambda i: F.concat(F.lit("  if (a1 > "), _text(i), F.lit(") { /* { */\n")))
    close = F.repeat(F.lit("  }\n"), F.col("d"))
    cases = F.when(F.col("r") > 0, F.concat(F.lit("  switch (a1) {\n"), _each(F.col("r"), lambda i: F.concat(F.lit("  case "), _text(i), F.lit(": break;\n"))), F.lit("  }\n"))).otherwise("")
    c = F.concat(F.lit("#include <x.h>\n#define OPEN {\n#if A\nint f"), o, F.lit("("), params, F.lit(")\n{\n#else\nint f"), o, F.lit("(void) {\n#endif\n"), ifs, cases, close, F.lit('  return s("}");\n}\nstatic struct s g(void) { struct s v = { 1, { 2 } }; return v; }\n'))
    cpp = F.concat(
        F.lit("namespace ns"), k, F.lit(" {\ntemplate <class T, class U = V<T>> class C"), o, F.lit(" : public Base<T> {\n public:\n  C"), o, F.lit("(int a) : x(a), y{a} { }\n  T m("), params, F.lit(") const {\n"), ifs, close, F.lit("  return [&](int q) { return q; }(1);\n  }\n  bool operator()(int z) { return z > 0; }\n  enum E { A, B };\n};\n}\n"),
        F.lit("template <class T> int ns"), k, F.lit("::C"), o, F.lit("<T>::out(int q, T t) { for (;;) { while (q) { q--; } } return 0; }\n"),
    )
    files = F.array(F.struct(F.lit("c").alias("language"), F.concat(F.lit("src/f"), o, F.lit(".c")).alias("path"), c.alias("content")), F.struct(F.lit("cpp").alias("language"), F.concat(F.lit("src/c"), o, F.lit(".cpp")).alias("path"), cpp.alias("content")))
    return s.select("o", "n", "r", "d", F.explode(files).alias("x")).select("o", "n", "r", "d", "x.*")


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, k (of props) and event_type of the events, for logs of build and test steps."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), "user_id")


STEPS_SQL = "e AS (SELECT event_id, event_type, json_extract(props, '$.k')::INT AS k, user_id FROM events)"
