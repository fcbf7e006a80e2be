"""Finding rules as columns: names, god class profile, feature envy budget, gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, thresholds, ratios and cut-offs that results must agree on.
LOW_INFO_NAMES = ("tmp", "temp", "data", "foo", "bar", "aaa", "bbb", "ccc", "obj", "var", "misc", "util")
SHORT_NAMES_ALLOWED = ("i", "j", "k", "x", "y", "z", "id", "ok")
ENVY_RATIO = 0.6
ENVY_LOC = 5
ENVY_ACCESS = 4
#: (language, smell) -> threshold.
THRESHOLDS = {("python", "long_method"): 50, ("c", "long_method"): 60, ("cpp", "long_method"): 60, ("java", "long_method"): 60, ("python", "long_parameter_list"): 6, ("c", "long_parameter_list"): 5, ("cpp", "long_parameter_list"): 6, ("java", "long_parameter_list"): 6, ("python", "nested_complexity"): 5, ("c", "nested_complexity"): 5, ("cpp", "nested_complexity"): 5, ("java", "nested_complexity"): 20, ("python", "code_clone_type1"): 17, ("c", "code_clone_type1"): 18, ("cpp", "code_clone_type1"): 25, ("java", "code_clone_type1"): 30}


def threshold(language: Column, smell: Column, default: int) -> Column:
    out = F.lit(default)
    for (lang, name), value in THRESHOLDS.items():
        out = F.when((language == lang) & (smell == name), value).otherwise(out)
    return out


def name_reason(name: Column, min_len: int = 2, allow_too_short: bool = True) -> Column:
    """Why a name tells little: low_info_name, too_short, letter_digit or repeated_char, the first that holds; else null."""
    low = F.lower(name)
    short = (F.length(name) <= min_len) & ~low.isin(*SHORT_NAMES_ALLOWED) if allow_too_short else F.lit(False)
    return (
        F.when(low.isin(*LOW_INFO_NAMES), "low_info_name")
        .when(short, "too_short")
        .when(name.rlike(r"^[a-zA-Z][0-9]+$"), "letter_digit")
        .when(name.rlike(r"^([a-zA-Z])\1{2,}$"), "repeated_char")
    )


def god_class_signals(nom: Column, wmc: Column, loc: Column, atfd: Column | None = None) -> Column:
    """How many of the profile's signals hold."""
    parts = [nom >= 10, wmc >= 30, loc >= 100, (nom >= 15) & (wmc >= 50)] + ([atfd >= 3] if atfd is not None else [])
    return sum((F.coalesce(p, F.lit(False)).cast("int") for p in parts), F.lit(0))


def god_class(nom: Column, wmc: Column, loc: Column, atfd: Column | None = None) -> Column:
    return F.coalesce((nom >= 5) & (wmc >= 20), F.lit(False)) & (god_class_signals(nom, wmc, loc, atfd) >= 2)


def envy_reduction(access: Column, total: Column, cap: Column) -> Column:
    """The smallest number of accesses less for which accesses / max(accesses, min(total, cap)) is under 0.6."""
    def under(r: Column) -> Column:
        a, t = access - r, F.greatest(total - r, F.lit(0))
        d = F.greatest(a, F.least(t, cap))
        return F.when(d > 0, a / d).otherwise(0.0) < ENVY_RATIO

    return F.coalesce(F.get(F.filter(F.sequence(F.lit(0).cast("long"), access), under), 0), access)


def relative_reduction(before: Column, after: Column) -> Column:
    """(before - after) / before; 0 where before is 0."""
    return F.when(before == 0, 0.0).otherwise((before - after) / before)


def envy_budget(loc: Column, access: Column, total: Column, cap: Column) -> Column:
    """Whether a method envies a receiver, and by how much accesses must fall until it does not.

    denominator: accesses of all kinds, at most cap, at least the receiver's; ratio: the receiver's part of it (6 digits);
    the finding is gone with fewer than four accesses or a ratio under 0.6, whichever is nearer.
    """
    total = F.greatest(access, total)
    cap = F.coalesce(cap, total)
    denominator = F.greatest(access, F.least(total, cap))
    ratio = F.when(denominator > 0, access / denominator).otherwise(0.0)
    by_access = F.greatest(access - (ENVY_ACCESS - 1), F.lit(0))
    by_ratio = envy_reduction(access, total, cap)
    found = (loc >= ENVY_LOC) & (access >= ENVY_ACCESS) & (ratio >= ENVY_RATIO)
    need = F.when(loc < ENVY_LOC, 0).otherwise(F.least(by_access, by_ratio))
    return F.struct(found.alias("finding_present"), F.round(ratio, 6).alias("ratio"), denominator.alias("denominator"), by_access.cast("long").alias("access_reduction"), by_ratio.cast("long").alias("ratio_reduction"), need.cast("long").alias("required_reduction"))


def god_class_signal_names(nom: Column, wmc: Column, loc: Column, atfd: Column | None = None) -> Column:
    """The names of the profile's signals that hold, in fixed order."""
    parts = {"nom": nom >= 10, "wmc": wmc >= 30, "loc": loc >= 100, "nom_wmc": (nom >= 15) & (wmc >= 50)} | ({"atfd": atfd >= 3} if atfd is not None else {})
    return F.array_compact(F.array(*[F.when(v, k) for k, v in parts.items()]))


def god_class_reduction(nom0: Column, nom1: Column, wmc0: Column, wmc1: Column, loc0: Column, loc1: Column) -> Column:
    """The largest relative fall of methods, complexity and lines; 0 if none falls."""
    return F.greatest(F.lit(0.0), *[relative_reduction(a, b).cast("double") for a, b in ((nom0, nom1), (wmc0, wmc1), (loc0, loc1))])


def progress_rank(resolved: Column, reductions: Column) -> Column:
    """A change's rank among partial ones: resolution, summed relative reductions (6 digits), objectives that fell; null if none did."""
    total = F.aggregate(reductions, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    better = F.size(F.filter(reductions, lambda x: x > 0))
    return F.when(better > 0, F.struct(F.coalesce(resolved, F.lit(False)).cast("int").alias("resolution"), F.round(total, 6).alias("reduction"), better.alias("improved")))


def suspicious_context(json: Column) -> Column:
    """Why a target context can't be used: forbidden, unsupported or wrongly typed fields; null if it can. Blank: an empty one."""
    # fixed values: fields
    known = ("symbol_kind", "symbol_name", "declaration_lines", "container_method", "receiver_type", "group", "parent", "target_class", "target_parameter_count")
    verdicts = ("score", "threshold", "metric", "metrics", "finding_present", "structural_expectation", "refactor_path")
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    list_ = lambda names: F.array(*[F.lit(x) for x in names])
    bad, odd = F.array_sort(F.array_intersect(keys, list_(verdicts))), F.array_sort(F.array_except(keys, list_(known)))
    lines = F.from_json(F.get_json_object(json, "$.declaration_lines"), "array<int>")
    wrong_lines = F.array_contains(keys, "declaration_lines") & F.coalesce((F.size(lines) == 0) | F.exists(lines, lambda x: F.coalesce(x < 1, F.lit(True))) | (F.size(F.array_distinct(lines)) < F.size(lines)), F.lit(True))
    wrong_count = F.array_contains(keys, "target_parameter_count") & ~F.coalesce(F.get_json_object(json, "$.target_parameter_count").rlike(r"^\d+$"), F.lit(False))
    return (
        F.when(F.trim(F.coalesce(json, F.lit(""))) == "", F.lit(None).cast("string"))
        .when(F.json_object_keys(json).isNull(), "target context must be a JSON object")
        .when(F.size(bad) > 0, F.concat(F.lit("target context cannot contain detector verdict fields: "), F.array_join(bad, ", ")))
        .when(F.size(odd) > 0, F.concat(F.lit("unsupported target context fields: "), F.array_join(odd, ", ")))
        .when(wrong_lines, "declaration_lines must be unique positive integers")
        .when(wrong_count, "target_parameter_count must be a non-negative integer")
    )
