"""Before/after adjudication as columns: objectives, reasons, gates, deficits, statuses. Missing evidence never counts as success."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reasons and messages that results must agree on.
MESSAGES = {
    "EDIT_REQUIRED": "the unchanged production baseline is not an accepted repair",
    "BASELINE_CHECKPOINT_MISSING": "the immutable baseline checkpoint is missing; verification cannot fall back to an unfrozen threshold",
    "BASELINE_METRIC_UNAVAILABLE": "the immutable baseline has no comparable continuous metric",
    "CURRENT_DETECTOR_UNAVAILABLE": "the target Guard could not produce a valid current snapshot",
    "CURRENT_METRIC_UNAVAILABLE": "the current target Guard snapshot has no metric comparable with the immutable baseline",
    "CURRENT_DETECTOR_RESULT_INVALID": "the target Guard returned an invalid current match count",
    "TARGET_AMBIGUOUS": "the current source matches multiple candidates for the frozen finding",
    "DETECTOR_PROFILE_MISMATCH": "the Guard implementation or profile changed; recapture the immutable baseline",
    "CHECKPOINT_RECAPTURE_REQUIRED": "the checkpoint predates schema v4; recapture c000 before editing",
    "BASELINE_CONTROLLER_SEAL_MISSING": "the controller-owned c000 integrity seal is missing",
    "BASELINE_CONTROLLER_SEAL_MISMATCH": "c000 no longer matches the integrity seal retained by the controller",
    "VERIFICATION_CONTRACT_MISMATCH": "the live build/test execution identity differs from the contract frozen in c000",
    "CHECKPOINT_SELECTION_CONTEXT_MISMATCH": "the live target selector differs from the selection_context frozen in c000",
    "FINDING_REMAINS": "the same frozen target improved but its smell is still present; record this result as IMPROVED, not PASS",
    "NO_STRUCTURAL_PROGRESS": "production source changed, but no checkpoint objective decreased",
    "TARGET_NOT_LOCATED": "the target entity could not be located after the edits; re-anchor it or restore the target signature instead of making it unreachable",
    "SEMANTIC_CONTRACT_REGRESSION": "the refactoring violated a smell-specific structural contract",
    "DATA_CLUMPS_PROJECT_FULL_REQUIRED": "the controlled declaration migration requires verification_mode=project_full",
}
BUILD_REASONS = ("FINAL_VERIFY_INFRA_FAILED", "FINAL_DIFF_GENERATED_ARTIFACTS", "TEST_SOURCE_MODIFIED", "TEST_SOURCE_MIGRATION_REJECTED", "TEST_SOURCE_DELETED", "VERIFICATION_CONFIG_MODIFIED", "WORKTREE_CHANGE_AUDIT_FAILED")
NO_EVIDENCE = ("test_not_executed", "test_evidence_missing", "no_tests_collected")
ZERO_TARGET = ("refused_bequest", "switch_statements", "mysterious_name", "dead_code")
ROOT_CAUSES = ("FULL_PROJECT_DETECTOR_FORBIDDEN_IN_TARGET_GUARD_AUDIT", "BASELINE_FINDING_NOT_FOUND", "TARGET_AMBIGUOUS", "ANCESTOR_TYPE_AMBIGUOUS", "ANCESTOR_DECLARATION_AMBIGUOUS", "ANCESTOR_DECLARATION_NOT_FOUND", "TARGET_CONTEXT_INCOMPLETE", "TARGET_CLASS_NOT_FOUND", "GUARD_SCOPE_TOO_LARGE")
INFRA_STATUSES = ("audit_worker_failed", "baseline_runner_failed", "checkout_error", "commit_error", "timeout")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def objective_delta(before: Column, after: Column) -> Column:
    """Maps of objectives to a map of those that both have: before, after, absolute_reduction, relative_reduction (0 from 0)."""
    shared = F.map_filter(before, lambda k, v: v.isNotNull() & F.coalesce(F.map_contains_key(after, k), F.lit(False)) & F.element_at(after, k).isNotNull())

    def delta(k: Column, b: Column) -> Column:
        a = F.element_at(after, k)
        return F.struct(b.alias("before"), a.alias("after"), (b - a).alias("absolute_reduction"), F.when(b != 0, F.round((b - a) / b, 6)).otherwise(0.0).alias("relative_reduction"))

    return F.transform_values(shared, delta)


def numeric_objectives(json: Column) -> Column:
    """The numbers of a JSON object, as a map; booleans, texts and nested values are left out."""
    raw = F.from_json(json, "map<string,string>")
    return F.transform_values(F.map_filter(raw, lambda k, v: v.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$")), lambda k, v: v.cast("double"))


def detector_failure(ok: Column, match_count: Column, require_count: bool = False) -> Column:
    """Why a current snapshot can't be judged; empty if it can. match_count: a number as it was reported."""
    n = match_count.cast("double")
    return (
        F.when(~_yes(ok), "CURRENT_DETECTOR_UNAVAILABLE")
        .when(match_count.isNull(), F.lit("CURRENT_DETECTOR_RESULT_INVALID" if require_count else ""))
        .when((n != F.floor(n)) | (n < 0), "CURRENT_DETECTOR_RESULT_INVALID")
        .when(n > 1, "TARGET_AMBIGUOUS")
        .otherwise("")
    )


def contract(baseline_ok: Column, before: Column, after: Column, failure: Column, unlocated: Column, preserved: Column, has_diff: Column) -> Column:
    """available, progress and reason of a change: some shared objective must fall, and nothing else may be wrong.

    failure: detector_failure; unlocated: the target is missing without leave; preserved: no structural regression.
    """
    positive = F.size(F.filter(F.map_values(before), lambda v: v > 0)) > 0
    base = _yes(baseline_ok) & _yes(positive)
    deltas = objective_delta(before, after)
    comparable = _yes(F.size(deltas) > 0)
    falls = F.size(F.filter(F.map_values(deltas), lambda d: d["absolute_reduction"] > 0)) > 0
    available = base & comparable
    progress = _yes(has_diff) & available & (failure == "") & ~_yes(unlocated) & _yes(preserved) & _yes(falls)
    reason = (
        F.when(~_yes(has_diff), "EDIT_REQUIRED")
        .when(~base, "BASELINE_METRIC_UNAVAILABLE")
        .when(failure != "", failure)
        .when(_yes(unlocated), "TARGET_NOT_LOCATED")
        .when(~comparable, "CURRENT_METRIC_UNAVAILABLE")
        .when(~_yes(preserved), "SEMANTIC_CONTRACT_REGRESSION")
        .when(~progress, "NO_STRUCTURAL_PROGRESS")
        .otherwise("METRIC_PROGRESS")
    )
    return F.struct(available.alias("available"), progress.alias("progress"), reason.alias("reason"))


def gate(smell: Column, required: Column, failure: Column, progress: Column, finding: Column, checkpoint_reason: Column, delta_reason: Column, full_required: Column, mode: Column) -> Column:
    """Null if the change is accepted, else reason and message. required: a checkpoint was asked for (null: not known).

    failure: detector_failure with the count required; finding: the smell is still there; full_required: the clump's
    migration asks for a run of all tests, and mode is what ran.
    """
    failure = F.when(_yes(required), failure).otherwise("")
    stays, moves = _yes(finding), _yes(progress)
    full = (smell == "data_clumps") & _yes(full_required) & (F.trim(F.coalesce(mode, F.lit(""))) != "project_full")
    given = F.trim(F.coalesce(checkpoint_reason, F.lit("")))
    reason = (
        F.when(_yes(~required) & (given != ""), F.upper(given))
        .when(failure != "", failure)
        .when(stays & moves, "FINDING_REMAINS")
        .when(full & moves, "DATA_CLUMPS_PROJECT_FULL_REQUIRED")
        .otherwise(F.coalesce(F.nullif(delta_reason, F.lit("")), F.lit("NO_STRUCTURAL_PROGRESS")))
    )
    text = F.lit(MESSAGES["NO_STRUCTURAL_PROGRESS"])
    for code, message in MESSAGES.items():
        text = F.when(reason == code, message).otherwise(text)
    passed = (failure == "") & moves & ~stays & ~full
    return F.when(~passed, F.struct(reason.alias("reason"), F.concat(smell, F.lit(" checkpoint contract: "), text, F.lit(".")).alias("message")))


def passing_max(smell: Column, name: Column, finding_min: Column, min_occurrences: Column, min_tokens: Column, min_exclusive: Column) -> Column:
    """The largest value of an objective with which the finding is gone; null where only the whole profile can tell."""
    below = lambda x: F.when(x.isNotNull(), F.greatest(x - 1, F.lit(0.0)))
    return (
        F.when((smell == "data_clumps") & (name == "occurrence_count"), below(min_occurrences))
        .when((smell == "feature_envy") & (name == "envy_access_diff"), min_exclusive)
        .when((smell == "code_clone_type1") & (name == "clone_token_count"), below(min_tokens))
        .when(smell.isin(*ZERO_TARGET), 0.0)
        .otherwise(below(finding_min))
    ).cast("double")


def deficit(value: Column, most: Column) -> Column:
    """How far a value is above its passing maximum; null without one."""
    return F.when(most.isNotNull(), F.greatest(value - most, F.lit(0.0)))


def verify_status(success: Column, build_success: Column, reason: Column, mode: Column, build: Column, test: Column, test_status: Column, test_code: Column, sample: Column, sample_status: Column, improved: Column, smell_success: Column) -> Column:
    """The terminal status of a verification; build and test outrank the smell. build, test, sample: success flags of the steps."""
    failed = lambda c: _yes(~c)
    missing = lambda s: _yes(s == "test_not_executed")
    only = mode == "sample_optimized"
    broken = (
        F.when(reason.isin(*BUILD_REASONS), reason)
        .when(_yes(only & (test_status == "missing")), "SAMPLE_TEST_SPEC_MISSING")
        .when(_yes(only) & missing(test_status) & _yes(test_code == 0), "SAMPLE_TEST_EVIDENCE_MISSING")
        .when(_yes(only) & failed(test), "SAMPLE_TEST_FAILED")
        .when(failed(build), "BUILD_FAILED")
        .when(failed(test), F.when(missing(test_status), "TEST_EVIDENCE_MISSING").otherwise("TEST_FAILED"))
        .when(failed(sample), F.when(missing(sample_status), "SAMPLE_TEST_EVIDENCE_MISSING").otherwise("TEST_FAILED"))
        .otherwise("BUILD_TEST_FAILED")
    )
    return F.when(_yes(success), "PASS").when(failed(build_success), broken).when(_yes(improved), "IMPROVED").when(failed(smell_success), "SMELL_GUARD_FAILED").otherwise("VERIFY_FAILED")


def verified_improvement(metric: Column, behaviour: Column) -> Column:
    return _yes(metric) & _yes(behaviour)


def failure_category(build_kind: Column, test_step: Column, test_status: Column, test_kind: Column, status: Column, reason: Column) -> Column:
    """Category by the failed step: the build first, then the tests, then what the status says; empty if nothing failed.

    build_kind, test_kind: infra_kind of the failed step (null: it did not fail); test_step: its name.
    """
    gone = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*NO_EVIDENCE)
    named = lambda kind, what, rest: F.when(kind == "timeout", f"{what}_TIMEOUT").when(kind == "oom", f"{what}_OOM").when(kind == "resource", f"{what}_RESOURCE_EXHAUSTED").otherwise(rest)
    untested = _yes(status == "TEST_EVIDENCE_MISSING") | gone(test_status) | gone(reason)
    return (
        F.when(build_kind.isNotNull(), named(build_kind, "BUILD", "BUILD_COMPILE_ERROR"))
        .when(test_kind.isNotNull() & untested, F.when(test_step == "sample_test", "SAMPLE_TEST_EVIDENCE_MISSING").otherwise("TEST_EVIDENCE_MISSING"))
        .when(test_kind.isNotNull(), named(test_kind, "TEST", "TEST_BEHAVIOR_REGRESSION"))
        .when(_yes(status == "BUILD_FAILED"), "BUILD_COMPILE_ERROR")
        .when(_yes(status == "TEST_EVIDENCE_MISSING") | (_yes(status == "TEST_FAILED") & gone(reason)), "TEST_EVIDENCE_MISSING")
        .when(_yes(status == "TEST_FAILED"), "TEST_BEHAVIOR_REGRESSION")
        .otherwise("")
    )


def terminal_status(execution_failure: Column, status: Column, verify_code: Column, resolution: Column, success: Column, accepted: Column) -> Column:
    """One status of a run: a broken execution outranks its verification, and PASS needs every witness of it."""
    proven = _yes((verify_code == 0) & (resolution == "resolved") & success & accepted)
    return F.coalesce(F.nullif(execution_failure, F.lit("")), F.when(status == "PASS", F.when(proven, "PASS").otherwise("VERIFY_FAILED")), F.nullif(status, F.lit("")), F.lit("VERIFY_FAILED"))


def reconcile(status: Column, infra: Column, same_diff_pass: Column, same_diff_failure: Column, signatures: Column) -> Column:
    """A final status held against earlier attempts on the same change: drifting failures, or a pass after a failure, are flaky.

    signatures: different signatures of failed tests on this change, the final ones among them.
    """
    flaky = _yes(signatures >= 2) | (_yes(status == "PASS") & _yes(same_diff_failure))
    lost = status.isin("BUILD_FAILED", "TEST_FAILED", "VERIFY_FAILED") & (F.coalesce(infra, F.lit("")) != "") & _yes(same_diff_pass)
    return F.when(flaky, "FLAKY_TEST_INCONCLUSIVE").when(_yes(lost), "FINAL_VERIFY_INFRA_FAILED").otherwise(status)


def termination_reasons(loop: Column, verify: Column, runtime: Column, trace: Column) -> Column:
    """control, verification and final reason; the controller's own ending is not the diagnosis."""
    first = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b, F.lit(""))
    verification, control = first(loop, verify), first(runtime, trace)
    return F.struct(control.alias("control"), verification.alias("verification"), first(verification, control).alias("final"))


def timing(now: Column, started: Column, budget_started: Column) -> Column:
    """Total, setup and budget seconds with one decimal, never below 0; without a budget's start all of it is setup."""
    text = lambda x: F.format_string("%.1f", F.bround(F.greatest(x, F.lit(0.0)).cast("double"), 1))
    return F.struct(text(now - started).alias("duration_seconds"), F.when(budget_started.isNull(), text(now - started)).otherwise(text(budget_started - started)).alias("setup_duration_seconds"), F.when(budget_started.isNull(), "").otherwise(text(now - budget_started)).alias("sample_budget_elapsed_seconds"))


def root_cause(message: Column) -> Column:
    """The first known code that a message has, else its last colon-parted word if that is a code."""
    out = F.lit(None).cast("string")
    for code in reversed(ROOT_CAUSES):
        out = F.when(message.contains(code), code).otherwise(out)
    tail = F.regexp_extract(F.substring_index(message, ":", -1), r"^\s*(\S+)", 1)
    coded = message.contains(":") & F.replace(tail, F.lit("_"), F.lit("")).rlike(r"^[\p{L}\p{N}]+$") & (F.upper(tail) == tail)
    return F.coalesce(out, F.when(coded, tail), F.lit("BASELINE_CAPTURE_FAILED"))


def dependency_category(first_pass: Column, status: Column, offline: Column, toolchain: Column, resolution: Column) -> Column:
    """category and confidence of a plan's failure; offline, toolchain, resolution: whether its log shows such evidence."""
    infra = _yes(status.isin(*INFRA_STATUSES))
    category = F.when(_yes(first_pass), "PASS").when(infra, "INFRA_FAILED").when(_yes(offline), "OFFLINE_DEPENDENCY_MISSING").when(_yes(toolchain), "BUILD_TOOLCHAIN_MISSING").when(_yes(resolution), "DEPENDENCY_RESOLUTION_FAILED").when(_yes(status == "build_failed"), "BUILD_FAILED").when(_yes(status == "test_failed"), "TEST_FAILED").otherwise("INFRA_FAILED")
    sure = (category != "DEPENDENCY_RESOLUTION_FAILED") & ((category != "INFRA_FAILED") | infra)
    return F.struct(category.alias("category"), F.when(sure, "high").otherwise("medium").alias("confidence"))


def write_heavy(reads: Column, writes: Column, control_flow: Column, ratio: float = 0.9, least_reads: int = 3) -> Column:
    """Whether accesses to a receiver only fill it: nearly all are writes, hardly any reads, and nothing is decided."""
    total = reads + writes
    return (F.when(total > 0, writes / total).otherwise(0.0) > ratio) & ~_yes(control_flow) & (reads < least_reads)


def sink_heavy(sink_calls: Column, reads: Column, total: Column, control_flow: Column, ratio: float = 0.85, least_reads: int = 3) -> Column:
    """The same of calls that only hand something on."""
    return (F.when(total > 0, sink_calls / total).otherwise(0.0) > ratio) & (reads < least_reads) & ~_yes(control_flow)


def test_change_violations(before: Column, after: Column) -> Column:
    """Which of methods, assertions (must not fall), disabled and skips (must not rise) got weaker. Maps name -> count."""
    value = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0))
    falls = [F.when(value(after, k) < value(before, k), F.lit(f"{k}_reduced")) for k in ("methods", "assertions")]
    rises = [F.when(value(after, k) > value(before, k), F.lit(f"{k}_increased")) for k in ("disabled", "skips")]
    return F.array_compact(F.array(*falls, *rises))


def binary_kind(content: Column) -> Column:
    """What kind of compiled output bytes are, by their first ones; empty for others."""
    head = F.hex(F.substring(content, 1, 4))
    magic = ("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE", "BEBAFECA", "CAFEBABF", "BFBAFECA")
    offset = F.conv(F.concat(*[F.hex(F.substring(content, 61 + i, 1)) for i in (3, 2, 1, 0)]), 16, 10).cast("long")
    portable = (F.substring(F.hex(F.substring(content, 1, 2)), 1, 4) == "4D5A") & (F.octet_length(content) >= 64)
    mark = F.hex(F.substring(content, (offset + 1).cast("int"), F.lit(4)))
    return (
        F.when(head == "7F454C46", "elf")
        .when(F.hex(F.substring(content, 1, 8)) == "213C617263683E0A", "archive")
        .when(head.isin(*magic), "mach-o-or-class")
        .when(head == "4243C0DE", "llvm-bitcode")
        .when(portable & (offset < 65532) & (mark == "50450000"), "portable-executable")
        .otherwise("")
    )


def policy_problem(cycles: Column, no_progress: Column, deadline: Column, groups: Column, mode: Column) -> Column:
    """Why a loop's limits can't be used: cycles 0 to 10, no-progress limit 1 to 5, deadline 60 to 7200 seconds, known failure groups; null if they can."""
    # fixed values: limits and groups
    odd = F.array_sort(F.array_except(groups, F.array(F.lit("smell"), F.lit("compile"), F.lit("test"))))
    return (
        F.when(~cycles.between(0, 10), "INVALID_LOOP_POLICY: --max-smell-verify-cycles must be between 0 and 10")
        .when(~no_progress.between(1, 5), "INVALID_LOOP_POLICY: --loop-no-progress-limit must be between 1 and 5")
        .when(~deadline.between(60, 7200), "INVALID_LOOP_POLICY: --sample-deadline must be between 60 and 7200 seconds")
        .when(F.size(odd) > 0, F.concat(F.lit("INVALID_LOOP_POLICY: unsupported --loop-on groups: "), F.array_join(odd, ", ")))
        .when((F.size(groups) == 0) & (mode != "off") & (cycles > 0), "INVALID_LOOP_POLICY: --loop-on must contain at least one failure group")
    )


def loop_ending(passed: Column, repairable: Column, cycles: Column, max_cycles: Column, idle: Column, no_progress: Column) -> Column:
    """Why a repair loop ends after a verification; null if it goes on. idle: verifications since the last change of diff, blocker or deficit."""
    return F.when(_yes(passed), "PASS").when(~_yes(repairable), "NON_REPAIRABLE_FAILURE").when(cycles >= max_cycles, "MAX_SMELL_VERIFY_CYCLES_REACHED").when(idle >= no_progress, "NO_PROGRESS_LIMIT_REACHED")


def change_category(path: Column, declared_tests: Column) -> Column:
    """test, build_metadata, production or other, by a changed path; declared_tests: paths that are tests whatever their name."""
    # fixed values: folders, build files and suffixes
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    test = low.rlike(r"(?:^|/)(?:tests?|src/(?:test|it))/|(?:^|/)test_[^/]*\.py$|_test\.[a-z]+$|tests?\.java$")
    build = low.rlike(r"(?:^|/)(?:pom\.xml|build\.gradle(?:\.kts)?|settings\.gradle(?:\.kts)?|gradle\.properties|cmakelists\.txt|makefile|meson\.build|setup\.(?:py|cfg)|pyproject\.toml|build\.xml|build(?:\.bazel)?)$")
    source = low.rlike(r"\.(?:java|py|c|cc|cpp|cxx|h|hh|hpp|hxx)$")
    return F.when(F.array_contains(declared_tests, path) | test, "test").when(build, "build_metadata").when(source, "production").otherwise("other")
