"""Streams drained over the whole tables; each must agree with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.streaming import windows as W


def stream_tumbling(spark, sf):
    # what the watermark has not passed at the end stays in the state: complete mode writes all windows
    return W.drained(W.tumbling(W.read(spark, f"{sf}/events.parquet"), "event_type"), "complete")


def stream_sessions(spark, sf):
    return W.drained(W.user_sessions(W.read(spark, f"{sf}/events.parquet"), "user_id"), "complete")


def stream_memory(spark, sf):
    told = W.drained(W.conversation_memory(W.read(spark, f"{sf}/conversations.parquet"), 3), "update")
    return told.groupBy("conv_id").agg(F.max_by(F.struct("turns", "last_turn", "chars"), "turns").alias("m")).select("conv_id", "m.*")


def stream_rate_limit(spark, sf):
    e = W.read(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return W.drained(W.admitted(e, 3, 86_400))


ORACLES = {
    "stream_tumbling": "select (floor(epoch(ts) / 3600) * 3600)::bigint as start_s, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "stream_sessions": "with a as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) is null or ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minutes then 1 else 0 end as s from events), b as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from a) select user_id, floor(epoch(min(ts)))::bigint as start_s, count(*) as n from b group by user_id, k",
    "stream_memory": "with r as (select *, row_number() over (partition by conv_id order by turn desc) as k, count(*) over (partition by conv_id) as c from conversations) select conv_id, any_value(c) as turns, max(turn) as last_turn, sum(length(text))::bigint as chars from r where k <= 3 group by conv_id",
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "stream_rate_limit")}
