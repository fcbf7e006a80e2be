"""Detectors over the tables of code scans: functions, classes, identifiers, accesses, calls. Each is one pass or an equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code, lexical, rules
from ..storage import small_side
from . import java

#: What a receiver is called when it is the method's own object.
OWN = ("self", "cls", "this")
SMELLS = ("long_method", "long_parameter_list", "nested_complexity", "switch_statements")


def function_findings(functions: DataFrame) -> DataFrame:
    """path, language, owner, name, begin_line, smell and value of functions at or above their language's threshold.

    Java's length is counted in statements and its complexity is cognitive; other languages count meaningful lines and the
    deepest nesting. Any dispatch is a switch finding. A value that can't be told is no finding.
    """
    java = F.col("language") == "java"
    value = {"long_method": F.when(java, F.col("ncss")).otherwise(F.col("loc")), "long_parameter_list": F.col("n_params"), "nested_complexity": F.when(java, F.col("complexity")).otherwise(F.col("nesting")), "switch_statements": F.col("switches")}
    found = [F.when(v >= (F.lit(1) if s == "switch_statements" else rules.threshold(F.col("language"), F.lit(s), 1 << 30)), F.struct(F.lit(s).alias("smell"), v.alias("value"))) for s, v in value.items()]
    return functions.select("path", "language", "owner", "name", "begin_line", F.explode(F.array_compact(F.array(*found))).alias("f")).select("path", "language", "owner", "name", "begin_line", "f.smell", "f.value")


def god_classes(classes: DataFrame, by: Sequence[str], atfd: str | None = None) -> DataFrame:
    """Summed nom, wmc, loc by key, the profile's signals, whether it holds, and the score: signals + wmc / 30."""
    g = classes.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("nom", "wmc", "loc")], *([F.max(atfd).alias("atfd")] if atfd else []))
    args = [F.col(c) for c in ("nom", "wmc", "loc")] + ([F.col("atfd")] if atfd else [])
    return g.withColumns({"signals": rules.god_class_signal_names(*args), "god_class": rules.god_class(*args)}).withColumn("score", F.size("signals") + F.col("wmc") / 30.0)


def foreign_types(source: Column, own: Column) -> Column:
    """How many foreign things a class's text reaches: receivers of calls and capitalised names, without its own and the usual ones."""
    # fixed values: receivers and types that don't count
    usual = F.array(*[F.lit(x) for x in ("this", "super", "self", "String", "Object", "Integer", "Long", "Boolean", "Double", "Float", "List", "Map", "Set", "Override", "System", "Math")])
    receivers = F.regexp_extract_all(source, F.lit(r"\b([A-Za-z_$][\w$]*)\.[A-Za-z_$][\w$]*\s*\("), F.lit(1))
    types = F.regexp_extract_all(source, F.lit(r"\b[A-Z][\w$]*\b"), F.lit(0))
    return F.size(F.array_except(F.array_distinct(F.concat(receivers, types)), F.concat(usual, F.array(own)))).cast("long")


_FUNCTION = ["path", "language", "owner", "function", "begin_line"]


def receiver_counts(accesses: DataFrame) -> DataFrame:
    """Accesses, reads and writes of each receiver in each function."""
    return accesses.groupBy(*_FUNCTION, "receiver").agg(F.count("*").alias("access"), F.count_if(~F.col("written")).alias("reads"), F.count_if("written").alias("writes"))


def feature_envy(functions: DataFrame, accesses: DataFrame, caps: DataFrame | None = None) -> DataFrame:
    """Each function's dominant foreign receiver (most accesses; ties: the smallest name) with its budget of accesses.

    caps: path, name, cap, the frozen totals that later accesses can't dilute; without it the present total is used.
    """
    counts = receiver_counts(accesses)
    best = F.min(F.when(~F.col("receiver").isin(*OWN), F.struct((-F.col("access")).alias("m"), "receiver")))
    rows = counts.groupBy(*_FUNCTION).agg(best.alias("b"), F.sum("access").alias("total")).where("b is not null")
    rows = rows.select(*_FUNCTION, F.col("b.receiver").alias("receiver"), (-F.col("b.m")).alias("access"), "total")
    f = functions.select("path", "language", "owner", F.col("name").alias("function"), "begin_line", F.col("loc").cast("long").alias("loc"))
    rows = rows.join(f, _FUNCTION)
    rows = rows.join(caps.select("path", F.col("name").alias("function"), "cap"), ["path", "function"], "left") if caps is not None else rows.withColumn("cap", F.lit(None).cast("long"))
    return rows.withColumn("budget", rules.envy_budget(F.col("loc"), F.col("access"), F.col("total"), F.col("cap"))).withColumnRenamed("function", "name")


def field_envy(calls: DataFrame, fields: DataFrame) -> DataFrame:
    """Java methods that use one field's type more than their own: owner, method, field, difference, where it is above 1; the strongest field only.

    calls: owner, method, receiver, member; fields: owner, name, type. The difference is the receiver's members less
    the owner's other fields without members and its distinct calls to itself.
    """
    f = fields.select("owner", F.col("name").alias("receiver"), "type")
    used = calls.join(f, ["owner", "receiver"]).groupBy("owner", "method", F.col("receiver").alias("field"), "type").agg(F.count("*").alias("uses"))
    self = calls.where(F.col("receiver").isin(*OWN) | (F.col("receiver") == "")).groupBy("owner", "method").agg(F.countDistinct("member").alias("own"))
    diff = used.join(self, ["owner", "method"], "left").withColumn("difference", F.col("uses") - F.coalesce("own", F.lit(0))).where("difference > 1")
    best = diff.groupBy("owner", "method").agg(F.min(F.struct((-F.col("difference")).alias("d"), "field", "type")).alias("b"))
    return best.select("owner", "method", F.col("b.field").alias("field"), F.col("b.type").alias("type"), (-F.col("b.d")).alias("difference"))


def mysterious_names(identifiers: DataFrame, min_len: int = 2) -> DataFrame:
    """identifiers (path, language, kind, name, line, owner, function) with the reason why a name tells little.

    In Java only methods can be too short; a local counts once for each method.
    """
    java = F.col("language") == "java"
    reason = F.when(java & (F.col("kind") != "method"), rules.name_reason(F.col("name"), min_len, False)).otherwise(rules.name_reason(F.col("name"), min_len))
    once = Window.partitionBy("path", "language", "owner", "function", "kind", "name").orderBy("line")
    rows = identifiers.withColumn("reason", reason).where("reason is not null")
    return rows.withColumn("_n", F.row_number().over(once)).where(~java | (F.col("kind") != "local") | (F.col("_n") == 1)).drop("_n")


def clump_occurrences(functions: DataFrame, groups: DataFrame, members: str) -> DataFrame:
    """functions joined to the groups (members: `type:name|...`) whose members are all among their parameters.

    Parameters meet members one by one, so no function is held against a group with which it shares nothing. A member
    without a type fits a parameter by its name.
    """
    canon = lexical.normalize_qualified_group(F.col(members))
    g = groups.withColumn("_set", F.array_distinct(F.split(canon, r"\|"))).withColumn("_need", F.size("_set"))
    params = F.array_distinct(lexical.parameter_fingerprints(F.col("signature"), F.col("language")))
    f = functions.withColumn("_param", F.explode(F.array_distinct(F.concat(params, F.transform(params, lambda p: F.substring_index(p, ":", -1))))))
    wanted = g.select(*groups.columns, "_need", F.explode("_set").alias("_param"))
    hit = f.join(small_side(wanted, "groups"), "_param")
    keys = ["path", "language", "owner", "name", "begin_line", "signature", *groups.columns]
    return hit.groupBy(*keys, "_need").agg(F.countDistinct("_param").alias("_n")).where("_n = _need").drop("_n", "_need")


def dead_code(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """Private methods without annotations that no call reaches, where only owners, names and arities are known: those of methods (owner, name, arity, private, annotated).

    calls: owner (of the call), caller, caller_arity, name, arity. A call counts for a declaration if it is the only one of
    its owner, name and arity, and is not made by itself; ambiguous calls count for none, so doubt leaves more findings.
    operators.java resolves calls by their arguments' types.
    """
    key = ["owner", "name", "arity"]
    only = methods.groupBy(*key).agg(F.count("*").alias("n")).where("n = 1").select(*key)
    itself = (F.col("caller") == F.col("name")) & (F.col("caller_arity") == F.col("arity"))
    used = calls.where(~F.coalesce(itself, F.lit(False))).select(*key).distinct().join(only, key, "left_semi")
    candidates = methods.where(F.col("private") & ~F.col("annotated") & ~F.col("name").isin(*java.SERIAL) & ~F.col("name").rlike(java.LIFECYCLE))
    return candidates.join(used, key, "left_anti")


def refused_bequests(methods: DataFrame, ancestors: DataFrame) -> DataFrame:
    """methods (owner, name, arity, body) that override an ancestor's and refuse it: with parent (the nearest that declares it) and kind.

    ancestors: child, ancestor, depth. Of equally near parents the smallest name is taken.
    """
    refusing = methods.withColumn("kind", code.rejection_kind(F.col("body"))).where("kind is not null")
    declared = methods.select(F.col("owner").alias("ancestor"), "name", "arity").distinct()
    above = refusing.join(ancestors.withColumnRenamed("child", "owner"), "owner").join(declared, ["ancestor", "name", "arity"])
    return above.groupBy("owner", "name", "arity", "kind").agg(F.min(F.struct("depth", "ancestor")).alias("p")).select("owner", "name", "arity", "kind", F.col("p.ancestor").alias("parent"))


def target_status(targets: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """targets with match_count and status: missing, matched or ambiguous. Only a single match is a target."""
    n = found.groupBy(*on).agg(F.count("*").alias("match_count"))
    out = targets.join(n, list(on), "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))
    return out.withColumn("status", F.when(F.col("match_count") == 0, "TARGET_NOT_LOCATED").when(F.col("match_count") > 1, "TARGET_AMBIGUOUS").otherwise("MATCHED"))


def sort_findings(findings: DataFrame) -> DataFrame:
    """Findings in their fixed order: strongest first, then by place."""
    return findings.orderBy(F.desc("score"), "file", "begin_line", "class_name", "method", "rule_id")
