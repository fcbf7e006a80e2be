"""Registered queries that run as streams, each with SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import loop
from .catalog import query, table


@query("""WITH e AS (SELECT user_id::VARCHAR AS session, event_id AS seq, ts, CASE WHEN event_type IN ('purchase', 'error') THEN 'verify' ELSE event_type END AS tool, CASE WHEN event_type = 'error' THEN 'error' ELSE 'completed' END AS status, json_extract(props, '$.k')::INT AS k FROM events),
c AS (SELECT *, CASE WHEN k % 9 < 2 THEN k % 9 = 0 END AS starts, k % 2 AS child FROM e),
r AS (SELECT *, coalesce(last_value(CASE WHEN child = 0 THEN starts END IGNORE NULLS) OVER w, false) OR coalesce(last_value(CASE WHEN child = 1 THEN starts END IGNORE NULLS) OVER w, false) AS busy FROM c WINDOW w AS (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, coalesce(NOT lag(busy) OVER w AND lag(ts) OVER w + INTERVAL 6 HOUR <= ts, true)::INT AS fresh FROM r WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS g FROM b),
h AS (SELECT *, max(CASE WHEN tool = 'verify' THEN seq END) OVER w AS last_try, max(CASE WHEN tool = 'verify' AND status = 'completed' THEN seq END) OVER w AS last_done, max(g) OVER (PARTITION BY session) AS last_g FROM g WINDOW w AS (PARTITION BY session, g))
SELECT session, 'MODEL_EVENT_INACTIVITY_TIMEOUT' AS reason, min(ts) AS first_ts, max(ts) AS last_ts, max(ts) + INTERVAL 6 HOUR AS ended_ts, count(*) AS events, count_if(tool = 'verify') AS attempts, count_if(tool = 'verify' AND status = 'completed') AS completed,
count(*) FILTER (tool <> 'verify' AND seq > last_done) AS tools_after, max(CASE WHEN seq = last_done AND last_try = last_done THEN 'k' || k END) AS last_status
FROM h GROUP BY session, g, last_g HAVING g < last_g OR NOT arg_max(busy, seq) AND max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def repair_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five micro-batches in the order of time; timers of sessions end them when the watermark passes, or the next event shows it."""
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.when(kind.isin("purchase", "error"), "verify").otherwise(kind).alias("tool"), F.when(kind == "error", "error").otherwise("completed").alias("status"),
        F.concat(F.lit("k"), k.cast("string")).alias("verdict"), F.when(k % 9 < 2, F.concat(F.lit("c"), (k % 2).cast("string"))).alias("child"), (k % 9 == 0).alias("running"),
    )
    ended = loop.ended_loops(loop.replayed(e, "ts", 5), gap_seconds=6 * 3600, late="1 hour")
    return loop.run_to_end(spark, ended, "loops").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts", "ended_ts")})
