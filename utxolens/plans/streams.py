"""Batch queries that the streaming forms must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events
from .domain import Domain
from .registry import query


@query("SELECT epoch_us(ts) - epoch_us(ts) % 86400000000 AS start_us, user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, user_id", plain=True)
def tumbling_activity(d: Domain):
    return events.tumbling(d.star("events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
    SELECT epoch_us(min(ts)) AS start_us, user_id, count(*) AS n FROM s GROUP BY user_id, no""", plain=True)
def session_activity(d: Domain):
    return events.sessions(d.star("events").withColumn("ts", F.col("ts").cast("timestamp")))
