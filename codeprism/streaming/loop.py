"""The repair loop as a stream: each session's tool events folded in typed state, ended by timers in event time that wait while children run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..storage import fresh_path, settled

#: Settings that stateful processing needs; a query's session has them while it runs.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
ENDED = "session string, reason string, first_ts timestamp, last_ts timestamp, ended_ts timestamp, events long, attempts long, completed long, tools_after long, last_status string"
_LOOP = "first_us long, last_us long, timer_ms long, events long, attempts long, completed long, after long, last_status string, quiet_us long"
INACTIVE, DEADLINE = "MODEL_EVENT_INACTIVITY_TIMEOUT", "SAMPLE_DEADLINE_REACHED"
_COLUMNS = [f.split()[0] for f in ENDED.split(", ")]


class RepairLoop(StatefulProcessor):
    """State of one session: counts and verdict of its loop, its running children, and one timer, at the next moment at which it may end.

    A session ends `gap` after its last event, unless a child runs then: each time the gap passes it is granted anew. It
    ends `deadline` after its first event in any case. What comes later begins a new session. A newer verification takes
    the older one's verdict back, even if it fails; tools count after the last completed one.
    """

    def __init__(self, gap_us: int, deadline_us: int | None):
        self.gap, self.deadline = gap_us, deadline_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.loop = handle.getValueState("loop", _LOOP)
        self.children = handle.getMapState("children", "child string", "since long")

    def _load(self) -> list | None:
        """The session's state; its running children are read once, and kept here until `_keep` writes what has changed: state lies behind a socket, and an event is short."""
        s = list(self.loop.get()) if self.loop.exists() else None
        self.had = {k[0] for k in self.children.keys()} if s else set()
        self.live: dict[str, int | None] = dict.fromkeys(self.had)
        return s

    def _end(self, s: list, busy: bool) -> tuple[int, str]:
        """When the session of this state may end next, and why."""
        at, why = s[8] + self.gap, INACTIVE
        if self.deadline is not None and (busy or s[0] + self.deadline <= at):
            quiet = at
            at, why = s[0] + self.deadline, DEADLINE
            if busy and quiet < at:
                return quiet, ""
        elif busy:
            return at, ""
        return at, why

    def _closed(self, key: str, s: list, at: int, why: str) -> tuple:
        self.live.clear()
        return (key, why, *(pd.Timestamp(x, unit="us") for x in (s[0], s[1], at)), s[3], s[4], s[5], s[6], s[7])

    def _passed(self, key: str, s: list | None, now: int) -> tuple[list | None, tuple | None]:
        """The state at a later moment, and the row of the session if it has ended before."""
        while s is not None:
            at, why = self._end(s, bool(self.live))
            if at > now:
                break
            if why:
                return None, self._closed(key, s, at, why)
            s[8] += self.gap * max(1, (now - s[8]) // self.gap if self.deadline is None else 1)  # a fresh window while children run
        return s, None

    def _keep(self, s: list | None, had: int | None) -> None:
        for child in self.had - self.live.keys():
            self.children.removeKey((child,))
        for child, since in self.live.items():
            if since is not None:
                self.children.updateValue((child,), (since,))
        if had is not None:
            self.handle.deleteTimer(had)
        if s is None:
            self.loop.clear()
            return
        at, _ = self._end(s, bool(self.live))
        s[2] = -(-at // 1000)
        self.loop.update(tuple(s))
        self.handle.registerTimer(s[2])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        had, out = (s[2] if s else None), []
        events = pd.concat(rows).sort_values(["ts", "seq"], kind="stable")
        stamps = (events["ts"].astype("datetime64[us]").astype("int64")).tolist()
        for now, tool, status, verdict, child, running in zip(stamps, events.tool, events.status, events.verdict, events.child, events.running, strict=True):
            s, ended = self._passed(key[0], s, now)
            if ended:
                out.append(ended)
            s = s or [now, now, 0, 0, 0, 0, 0, None, now]
            s[1], s[3], s[8] = now, s[3] + 1, now
            if isinstance(child, str):
                if running:
                    self.live[child] = now
                else:
                    self.live.pop(child, None)
            if tool == "verify":
                s[4], s[7] = s[4] + 1, None
                if status == "completed":
                    s[5], s[6], s[7] = s[5] + 1, 0, verdict if isinstance(verdict, str) else None
            elif s[5] and status == "completed":
                s[6] += 1
        self._keep(s, had)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        if s is None:
            return
        s, ended = self._passed(key[0], s, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._keep(s, None)
        if ended:
            yield pd.DataFrame([ended], columns=_COLUMNS)

    def close(self) -> None:
        pass


def ended_loops(events: DataFrame, gap_seconds: float = 300, deadline_seconds: float | None = None, late: str = "10 minutes") -> DataFrame:
    """ENDED rows of a stream of events: session, seq, ts, tool, status, verdict, child (or null) and running (it starts, or has finished).

    Events of a session must come in the order of ts up to `late`; later ones are dropped by the watermark, and within a
    micro-batch they are put in order. A session's state goes when it ends; one whose end the watermark has not reached
    stays open. State is kept by RocksDB beside the checkpoint, so a restarted query goes on where it was.
    """
    us = lambda x: None if x is None else int(x * 1_000_000)
    rows = events.select("session", "seq", F.col("ts").cast("timestamp").alias("ts"), "tool", "status", "verdict", "child", "running").withWatermark("ts", late)
    return rows.groupBy("session").transformWithStateInPandas(RepairLoop(us(gap_seconds), us(deadline_seconds)), ENDED, "Append", "EventTime")


def run_to_end(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that is there now: written as a table below the shared folder, and read from it."""
    at = fresh_path(spark, name)
    had = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def replayed(rows: DataFrame, at: str, steps: int, name: str = "replay") -> DataFrame:
    """A table as a stream in the order of `at`: a file-based source that gives one of `steps` equal spans of time after the other."""
    spark = rows.sparkSession
    rows = settled(rows, name + "-rows")  # read again for each span: made once
    path = fresh_path(spark, name)
    low, high = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).head()
    if low is None:
        rows.limit(0).write.parquet(path)
        return spark.readStream.schema(rows.schema).parquet(path)
    width = (high - low) // steps + 1
    for k in range(steps):
        span = F.unix_micros(at)
        rows.where((span >= low + k * width) & (span < low + (k + 1) * width)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
