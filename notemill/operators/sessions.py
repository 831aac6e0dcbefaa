"""Conversation sessions in batch; the streaming form is in notemill.streaming.sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_turns(turns: DataFrame, session: str, order: str, n: int) -> DataFrame:
    """The last n turns of each session; none for n of 0 or less."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return turns.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def context(turns: DataFrame, session: str, order: str, text: str, n: int = 5) -> DataFrame:
    """session, turns, last_order, speakers (sorted, distinct) and the length of what the last n turns say."""
    kept = last_turns(turns, session, order, n)
    return kept.groupBy(session).agg(F.count("*").alias("turns"), F.max(order).alias("last_turn"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("speakers"), F.sum(F.length(text)).alias("chars"))


def stats(turns: DataFrame, session: str) -> DataFrame:
    return turns.agg(F.countDistinct(session).alias("sessions"), F.count("*").alias("turns"))


def gap_sessions(events: DataFrame, user: str, ts: str, gap_minutes: int = 30) -> DataFrame:
    """user, started, ended, n: events of a user with less than the gap between them."""
    w = Window.partitionBy(user).orderBy(ts)
    t = F.col(ts)
    new = F.when(F.lag(ts).over(w).isNull() | (t >= F.lag(ts).over(w) + F.expr(f"interval {gap_minutes} minutes")), 1).otherwise(0)
    numbered = events.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(user, "_s").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n")).drop("_s")


def replay(actions: DataFrame, ttl: int = 3600, keep: int = 20) -> DataFrame:
    """The answers of streaming/sessions.session_store to a whole table of actions: session, seq, started, turn, held, chars, cleared."""
    w = Window.partitionBy("session").orderBy("at_s", "seq")
    a = actions.select("session", F.unix_seconds(F.col("at").cast("timestamp")).alias("at_s"), "seq", "action", F.coalesce("chars", F.lit(0)).cast("bigint").alias("chars"))
    alive = F.coalesce((F.lag("action").over(w) == "turn") & (F.col("at_s") - F.lag("at_s").over(w) <= ttl), F.lit(False))
    turn = F.col("action") == "turn"
    runs = a.withColumn("alive", alive).withColumn("run", F.sum((turn & ~F.col("alive")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy("session", "run").orderBy("at_s", "seq")
    near = r.rowsBetween(-keep + 1, 0)
    of_turn = lambda c: F.when(turn, c).otherwise(0)
    return runs.select(
        "session", "seq", F.when(turn, F.first("at_s").over(r)).alias("started"), of_turn(F.row_number().over(r).cast("bigint")).alias("turn"),
        of_turn(F.count("*").over(near)).alias("held"), of_turn(F.sum("chars").over(near)).alias("chars"), (~turn & F.col("alive")).alias("cleared"),
    )


def still_open(actions: DataFrame, now: int, ttl: int = 3600, capacity: int = 1000) -> DataFrame:
    """session, last_access: sessions that are neither cleared nor idle for over ttl seconds at `now`, and of these the `capacity` most recently used."""
    at = F.unix_seconds(F.col("at").cast("timestamp"))
    last = actions.select("session", at.alias("at_s"), "seq", "action").where(F.col("at_s") <= now).groupBy("session").agg(F.max(F.struct("at_s", "seq", "action")).alias("last"))
    return last.where((F.col("last.action") == "turn") & (now - F.col("last.at_s") <= ttl)).orderBy(F.desc("last.at_s"), F.desc("last.seq")).limit(capacity).select("session", F.col("last.at_s").alias("last_access"))
