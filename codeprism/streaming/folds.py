"""Streaming twins of the event queries. Event time and watermarks are additions of this engine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def inactivity_sessions(events: DataFrame, by: str = "user_id", at: str = "ts", gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions closed by `gap` without events; state goes once the watermark has passed a session's end."""
    at_ = F.col(at).cast("timestamp").alias(at)
    w = events.select(by, at_).withWatermark(at, late).groupBy(by, F.session_window(at, gap).alias("w"))
    return w.agg(F.count("*").alias("n_events"), F.min(at).alias("first_ts"), F.max(at).alias("last_ts")).select(by, "first_ts", "last_ts", "n_events")


def status_counts(events: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return e.groupBy(F.window(at, window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


TRACE = "session string, attempts long, completed long, tools_after long, last_status string, events long"
_STATE = "attempts long, completed long, tools_after long, last_status string, events long"


def _trace(events: list[tuple[str, str, str | None]], state: tuple | None) -> tuple:
    """The state after events (tool, status, verdict) in order: a newer verification takes the older one's verdict back, even if it fails."""
    attempts, completed, after, last, n = state or (0, 0, 0, None, 0)
    for tool, status, verdict in events:
        n += 1
        if tool == "verify":
            attempts, last = attempts + 1, None
            if status == "completed":
                completed, after, last = completed + 1, 0, verdict
        elif completed and status == "completed":
            after += 1
    return attempts, completed, after, last, n


def tool_trace(events: DataFrame) -> DataFrame:
    """TRACE of each session of a stream or table of tool events (session, seq, tool, status, verdict).

    As a stream, a session's counts and last verdict are kept between micro-batches; each batch gives the sessions that it
    changed. Events of a session are folded by seq within a batch; batches must come in the order of seq.
    """
    if not events.isStreaming:
        def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("seq")
            return pd.DataFrame([(key[0], *_trace(list(zip(rows.tool, rows.status, rows.verdict.where(rows.verdict.notna(), None))), None))], columns=[f.split()[0] for f in TRACE.split(", ")])

        return events.groupBy("session").applyInPandas(whole, TRACE)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("seq")
        now = _trace(list(zip(rows.tool, rows.status, rows.verdict.where(rows.verdict.notna(), None))), state.get if state.exists else None)
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=[f.split()[0] for f in TRACE.split(", ")])

    return events.groupBy("session").applyInPandasWithState(step, TRACE, _STATE, "update", GroupStateTimeout.NoTimeout)
