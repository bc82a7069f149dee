"""Streaming forms of sessions and counts, fed with the events table."""
from __future__ import annotations

from pyspark.sql import functions as F

from saddle.plans.registry import query
from saddle.plans.tables import scratch, table
from saddle.streaming import sessions as st


def _events(spark, sf):
    return st.read_events(spark, sf, table(spark, sf, "events").schema, "events.parquet")


_LATE = 600_000_000
_HOUR = 3_600_000_000


@query("stream_sessionize", f"""WITH gaps AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL
   OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > {_HOUR} THEN 1 ELSE 0 END AS opens
   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 sess AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM gaps),
 done AS (SELECT user_id, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, count(*) AS n FROM sess GROUP BY user_id, s)
 SELECT user_id, first_us, last_us, n FROM done WHERE last_us + {_HOUR} <= (SELECT (epoch_us(max(ts)) // 1000) * 1000 - {_LATE} FROM events)""")
def _sessions(spark, sf):
    path = scratch(spark, "stream-sessions")
    st.run_available(st.stream_sessionize(_events(spark, sf), "user_id", "ts"), path, path + "-state")
    out = spark.read.schema("user_id bigint, first timestamp, last timestamp, n bigint").parquet(path)
    return out.select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n")


@query("stream_unigrams", f"""WITH days AS (SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type AS token, count(*) AS n
   FROM events GROUP BY 1, 2)
 SELECT start_us, token, n FROM days WHERE start_us + {24 * _HOUR} <= (SELECT (epoch_us(max(ts)) // 1000) * 1000 - {_LATE} FROM events)""")
def _unigrams(spark, sf):
    path = scratch(spark, "stream-unigrams")
    st.run_available(st.stream_unigrams(_events(spark, sf), "event_type", "ts"), path, path + "-state")
    out = spark.read.schema("start timestamp, token string, n bigint").parquet(path)
    return out.select(F.unix_micros("start").alias("start_us"), "token", "n")
