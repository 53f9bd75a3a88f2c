"""Queries that run as streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dashboards import first_of
from ..streaming import access as a
from ._register import query


def _events(v, key):
    return a.stream_of(v.spark, f"{v.sf_dir}/events.parquet").select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))


def _last(keys):
    return lambda told: first_of(told, [F.col(k) for k in keys], [F.desc("batch")])


@query("stream_over_limit_users", "SELECT CAST(key AS VARCHAR) AS key, time_bucket(INTERVAL '15 minutes', ts) AS start, count(*) AS n FROM fx_access GROUP BY 1, 2 HAVING count(*) > 1", "fx_access")
def stream_over_limit_users(v):
    return a.drained(a.over_limit(_events(v, "user_id"), "15 minutes", 1), "update", "limits", _last(["key", "start"]))


@query("stream_over_limit_actions", "SELECT action AS key, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM fx_access GROUP BY 1, 2 HAVING count(*) > 5", "fx_access")
def stream_over_limit_actions(v):
    return a.drained(a.over_limit(_events(v, "event_type"), "1 hour", 5), "update", "limits", _last(["key", "start"]))


@query("batch_over_limit_users", "SELECT CAST(key AS VARCHAR) AS key, time_bucket(INTERVAL '15 minutes', ts) AS start, count(*) AS n FROM fx_access GROUP BY 1, 2 HAVING count(*) > 1", "fx_access")
def batch_over_limit_users(v):
    events = v.access.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return a.over_limit(events, "15 minutes", 1, None)


_FOLD = """SELECT key, make_timestamp(unnest(list_reduce(t, lambda s, x: CASE WHEN x[1] - s[-1] >= {gap} THEN list_concat(s, x) ELSE s END))) AS ts FROM (
SELECT {key} AS key, list([epoch_us(ts)] ORDER BY ts) AS t FROM fx_access GROUP BY 1)"""


@query("stream_repeats_suppressed", _FOLD.format(gap=60_000_000, key="action"), "fx_access")
def stream_repeats_suppressed(v):
    return a.drained(a.suppress_repeats(_events(v, "event_type"), 60), "append", "repeats")


@query("batch_repeats_suppressed", _FOLD.format(gap=3_600_000_000, key="CAST(key AS VARCHAR)"), "fx_access")
def batch_repeats_suppressed(v):
    return a.accepted_in_batch(v.access.select("key", F.col("ts").cast("timestamp").alias("ts")), 3600)


@query("stream_latest_scores", "SELECT resume_id, created_at, report_id, total_score FROM fx_score_now", "fx_score_now")
def stream_latest_scores(v):
    rows = a.stream_of(v.spark, f"{v.sf_dir}/orders.parquet")
    reports = rows.select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("resume_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), (F.floor("o_totalprice") % 101).alias("total_score"))
    return a.drained(a.latest_scores(reports), "update", "scores", _last(["resume_id"]))


@query("stream_activity", "SELECT 'event' AS kind, event_id AS item_id, ts AS happened FROM fx_access WHERE action = 'purchase' UNION ALL SELECT 'report', o_orderkey, o_orderdate FROM orders WHERE o_orderpriority LIKE '1%'", "fx_access")
def stream_activity(v):
    """The feed's branches as one stream in append mode."""
    events = a.stream_of(v.spark, f"{v.sf_dir}/events.parquet").where("event_type = 'purchase'").select(F.lit("event").alias("kind"), F.col("event_id").alias("item_id"), F.col("ts").cast("timestamp").alias("happened"))
    orders = a.stream_of(v.spark, f"{v.sf_dir}/orders.parquet").where("o_orderpriority LIKE '1%'").select(F.lit("report").alias("kind"), F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").cast("timestamp").alias("happened"))
    return a.drained(events.unionByName(orders), "append", "activity")
