"""The repair loop as a stream against a plain loop over the same events; failing tests and signatures."""

import datetime as dt
import random

from codeprism.operators import failures
from codeprism.streaming import loop

EVENTS = "session string, seq long, ts timestamp, tool string, status string, verdict string, child string, running boolean"
START = dt.datetime(2024, 1, 1)


def by_hand(events, gap, deadline, end):
    out = []
    for name in sorted({e[0] for e in events}):
        s, children = None, set()

        def over(now):
            """The end of the open session before a moment, if it has ended."""
            quiet = s["last"] + gap
            if children:
                quiet = None
            ends = [(t, r) for t, r in ((quiet, loop.INACTIVE), (s["first"] + deadline if deadline else None, loop.DEADLINE)) if t is not None]
            ends = [x for x in ends if x[0] <= now]
            return min(ends, key=lambda x: (x[0], x[1] != loop.DEADLINE)) if ends else None

        for _, seq, ts, tool, status, verdict, child, running in sorted((e for e in events if e[0] == name), key=lambda e: (e[2], e[1])):
            if s and (x := over(ts)):
                out.append((name, x[1], s["first"], s["last"], x[0], s["n"], s["a"], s["c"], s["t"], s["v"]))
                s, children = None, set()
            s = s or {"first": ts, "n": 0, "a": 0, "c": 0, "t": 0, "v": None}
            s["last"], s["n"] = ts, s["n"] + 1
            if child:
                (children.add if running else children.discard)(child)
            if tool == "verify":
                s["a"], s["v"] = s["a"] + 1, None
                if status == "completed":
                    s["c"], s["t"], s["v"] = s["c"] + 1, 0, verdict
            elif s["c"] and status == "completed":
                s["t"] += 1
        if s and (x := over(end)):
            out.append((name, x[1], s["first"], s["last"], x[0], s["n"], s["a"], s["c"], s["t"], s["v"]))
    return sorted(out, key=repr)


def test_loops_end_by_gap_and_deadline(spark):
    rng = random.Random(2)
    events, now = [], 0.0
    for i in range(400):
        now += rng.expovariate(1 / 9) + 0.001
        tool = rng.choice(["verify", "edit", "read"])
        child = rng.choice([None, None, None, "c1", "c2"])
        events.append((f"s{rng.randrange(5)}", i, START + dt.timedelta(microseconds=int(now * 1e6)), tool, rng.choice(["completed", "error"]), rng.choice(["PASS", "FAIL", None]), child, rng.random() < 0.45))
    rows = spark.createDataFrame(events, EVENTS)
    last = max(e[2] for e in events)
    for deadline in (None, 300.0):
        stream = loop.ended_loops(loop.replayed(rows, "ts", 4), 60.0, deadline, "5 seconds")
        got = sorted((tuple(r) for r in loop.run_to_end(spark, stream, "loops").collect()), key=repr)
        want = by_hand(events, dt.timedelta(seconds=60), deadline and dt.timedelta(seconds=deadline), last - dt.timedelta(seconds=5))
        assert got == want
        assert {r[1] for r in want} == ({loop.INACTIVE, loop.DEADLINE} if deadline else {loop.INACTIVE})
    empty = loop.ended_loops(loop.replayed(rows.limit(0), "ts", 4), 60.0, None, "5 seconds")
    assert loop.run_to_end(spark, empty, "loops").collect() == []


def test_failing_tests(spark):
    log = 'TMUX_FAIL_CASE {"test": "a", "exit_code": 1, "diagnostic_fingerprint": "x"} and TMUX_FAIL_CASE {"test": "a", "exit_code": 1, "diagnostic_fingerprint": "longer"}\nTMUX_FAIL_CASE {"test": "", "exit_code": 1, "diagnostic_fingerprint": "x"}'
    steps = [
        (1, "test", None, "failed", None, log), (1, "sample_test", False, "", 2, "FAIL b: exit 2\nerror: q"), (2, "test", None, None, 3, "FAIL b/c: exit 3\nline\nxFAIL no: exit 1\nFAIL d: exit -2\nunexpected x"), (3, "test", None, "Timeout", None, None),
        (4, "build", False, "failed", 1, "FAIL z: exit 1"), (5, "test", True, "passed", 0, "FAIL z: exit 1"), (6, "test", None, "error", None, "TMUX_FAIL_CASE {broken"),
    ]
    rows = spark.createDataFrame(steps, "run int, step string, success boolean, status string, returncode int, text string")
    cases = failures.failing_tests(rows)
    assert {tuple(r) for r in cases.collect()} == {(1, "a", 1, "longer"), (2, "b/c", 3, "exit=3 | line | xFAIL no: exit 1"), (2, "d", -2, "exit=-2 | unexpected x"), (3, "test", 1, "exit=1")}
    got = {r.run: (r.n_tests, r.signature, r.compact) for r in failures.failure_signatures(cases, limit=30).collect()}
    assert got[1] == (1, ["a|1|longer"], "tests=1:a@1:longer") and got[2][0] == 2 and got[2][2] == "tests=2:b/c@3:exit;d@-2:exit="
    drift = spark.createDataFrame([("r", 1, ["a"]), ("r", 2, ["a", "b"]), ("r", 3, ["b"])], "run string, n int, signature array<string>")
    assert [(r.appeared, r.cleared) for r in failures.signature_drift(drift, "run", "n").orderBy("n").collect()] == [(["a"], []), (["b"], []), ([], ["a"])]


def test_logs_are_cut_once_over_many_tasks(spark):
    rows = spark.createDataFrame([(i, "test", False, "", 1, f"FAIL t{i % 3}: exit 1\nerror: e{i}") for i in range(64)], "run int, step string, success boolean, status string, returncode int, text string").coalesce(1)
    cases = failures.failing_tests(rows)
    assert "regexp" not in cases._jdf.queryExecution().optimizedPlan().toString().lower() and cases.count() == 64
    files = {f for f in cases.inputFiles()}
    assert len(files) >= 4


def test_replayed_rows_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = spark.createDataFrame([(i, START + dt.timedelta(seconds=i)) for i in range(50)], "seq long, ts timestamp").mapInPandas(seen, "seq long, ts timestamp")
    stream = loop.replayed(rows, "ts", 5)
    assert made.value == 50
    assert sorted(r.seq for r in loop.run_to_end(spark, stream, "again").collect()) == list(range(50))
