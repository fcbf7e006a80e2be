"""Failing tests of build and test steps: named cases cut out of logs, and signatures that tell one state of failure from another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logs import failure_fingerprint
from ..sources.batches import spread
from ..storage import settled

# The marker before a case's JSON, the line that heads a case's log, names of cases, steps that run tests, and states that mean failure.
MARKER = "TMUX_FAIL_CASE "
HEADER = r"\bFAIL ([A-Za-z0-9_.+/-]+): exit (-?[0-9]+)\b"
CASE_NAME = r"^[A-Za-z0-9_.+/-]+\z"
TEST_STEPS = ("test", "sample_test")
FAILED = ("fail", "failed", "error", "timeout", "timed_out")
MOST = 600


def step_failed(success: Column, status: Column, returncode: Column) -> Column:
    """Whether a step failed: by its flag, its status or its return code; nulls say nothing."""
    said = F.lower(F.trim(F.coalesce(status, F.lit("")))).isin(*FAILED)
    return F.coalesce(~success, F.lit(False)) | said | F.coalesce(returncode != 0, F.lit(False))


def failing_tests(steps: DataFrame, by: str = "run") -> DataFrame:
    """(`by`, test, exit_code, fingerprint) of the cases that failed; steps: `by`, step, success, status, returncode, text.

    Only failed steps of TEST_STEPS count. A case is told by its marker and JSON, else by its head line and the log up to
    the next head line, else the step itself is the case. Of these three kinds a run has the first that any of its steps
    shows. A case that comes several times with one exit code keeps its longest fingerprint (ties: the smallest). A log is
    cut by its own marks, so a step is one row until its cases are; null texts are empty.
    """
    text = F.coalesce("text", F.lit(""))
    rows = steps.where(F.col("step").isin(*TEST_STEPS) & step_failed(F.col("success"), F.col("status"), F.col("returncode"))).select(by, "step", F.coalesce("returncode", F.lit(1)).cast("long").alias("code"), text.alias("text"))
    kind = "struct<test:string,exit_code:bigint,diagnostic_fingerprint:string>"
    case = lambda rank, test, code, print_: F.named_struct(F.lit("rank"), F.lit(rank), F.lit("test"), test, F.lit("exit_code"), code, F.lit("fingerprint"), F.substring(print_, 1, MOST))
    after = F.slice(F.split("text", r"\Q" + MARKER + r"\E", -1), 2, 1 << 30)
    read = F.transform(after, lambda x: F.from_json(x, kind, {"mode": "PERMISSIVE"}))
    valid = F.filter(read, lambda x: F.coalesce(x["test"].rlike(CASE_NAME) & x["exit_code"].isNotNull() & (F.coalesce(x["diagnostic_fingerprint"], F.lit("")) != ""), F.lit(False)))
    marked = F.transform(valid, lambda x: case(1, x["test"], x["exit_code"], x["diagnostic_fingerprint"]))
    blocks = F.slice(F.split(F.regexp_replace("text", HEADER, "\x1e$0"), "\x1e(?=FAIL )", -1), 2, 1 << 30)
    code = lambda x: F.regexp_extract(x, HEADER, 2)
    headed = F.transform(blocks, lambda x: case(2, F.regexp_extract(x, HEADER, 1), code(x).cast("long"), failure_fingerprint(code(x).cast("long"), F.regexp_replace(x, "^" + HEADER.removeprefix(r"\b"), ""))))
    bare = (F.size(blocks) == 0) & ~F.col("text").contains(MARKER)
    whole = F.when(bare, F.array(case(3, F.col("step"), F.col("code"), failure_fingerprint(F.col("code"), F.col("text"))))).otherwise(F.slice(headed, 1, 0))
    # cutting a log is dear and its rows are few to a task's liking: over many tasks, and once, though the cases are read twice
    found = settled(spread(rows).select(by, F.explode(F.concat(marked, headed, whole)).alias("c")).select(by, "c.*"), "cases")
    first = found.groupBy(by).agg(F.min("rank").alias("rank"))
    best = F.min_by("fingerprint", F.struct(-F.length("fingerprint"), "fingerprint"))
    return found.join(first, [by, "rank"]).groupBy(by, "test", "exit_code").agg(best.alias("fingerprint"))


def failure_signatures(cases: DataFrame, by: str = "run", limit: int = 128, shown: int = 8) -> DataFrame:
    """(`by`, n_tests, signature, compact): all cases of a run in order, and a text of at most `limit` characters in which the first `shown` have equal room.

    cases: failing_tests. Two runs whose signatures differ failed differently.
    """
    ordered = F.array_sort(F.collect_list(F.struct("test", "exit_code", "fingerprint")))
    g = cases.groupBy(by).agg(ordered.alias("c")).withColumn("n_tests", F.size("c").cast("long"))
    one = lambda x, sep, end: F.concat(x["test"], F.lit(sep), x["exit_code"].cast("string"), F.lit(end), x["fingerprint"])
    prefix = F.concat(F.lit("tests="), F.col("n_tests").cast("string"), F.lit(":"))
    n = F.least(F.size("c"), F.lit(shown))
    room = F.greatest(F.lit(8), F.floor((F.lit(limit) - F.length(prefix) - n + 1) / n).cast("int"))
    items = F.transform(F.slice("c", 1, shown), lambda x: F.substring(one(x, "@", ":"), F.lit(1), room))
    return g.select(by, "n_tests", F.transform("c", lambda x: one(x, "|", "|")).alias("signature"), F.substring(F.concat(prefix, F.array_join(items, ";")), 1, limit).alias("compact"))


def signature_drift(signatures: DataFrame, by: str, order: str) -> DataFrame:
    """signatures (`by`, `order`, signature) with appeared and cleared: the cases that the run before did not have, and those that are gone since."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    before = F.coalesce(F.lag("signature").over(w), F.array().cast("array<string>"))
    return signatures.withColumns({"appeared": F.array_except("signature", before), "cleared": F.array_except(before, "signature")})
