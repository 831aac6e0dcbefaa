"""Structured Streaming over tables of events: windows with watermarks, conversation memory and rate limits as keyed state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of a table's files. The path is given as a pattern, as a table may be a single file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir; a local one only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.gettempdir() + "/notemill-shared"
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there and returns what it wrote (for update: a row for each change)."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)

    def out(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(out).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


def tumbling(events: DataFrame, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start_s, by, n, total: a window's sums, final once the watermark has passed it."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = e.groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select(F.unix_timestamp("w.start").alias("start_s"), by, "n", "total")


def user_sessions(events: DataFrame, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user, start_s, n: events with less than the gap between them."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.unix_timestamp("w.start").alias("start_s"), "n")


MEMORY = "conv_id bigint, turns bigint, last_turn bigint, chars bigint"


def conversation_memory(turns: DataFrame, keep: int = 3) -> DataFrame:
    """Per conversation, as its turns come: the turns seen, the last one, and the characters of the last `keep` turns, which the state holds."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held = state.get if state.exists else (0, [])
        held = [tuple(x) for x in held]
        for batch in batches:
            seen += len(batch)
            held = sorted(held + list(zip(batch["turn"].tolist(), batch["chars"].tolist())))[-keep:]
        state.update((seen, held))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [seen], "last_turn": [held[-1][0]], "chars": [sum(c for _, c in held)]})

    small = turns.select("conv_id", "turn", F.length("text").cast("bigint").alias("chars"))
    return small.groupBy("conv_id").applyInPandasWithState(step, MEMORY, "seen bigint, held array<struct<turn:bigint,chars:bigint>>", "update", GroupStateTimeout.NoTimeout)


def admitted(requests: DataFrame, limit: int = 3, window: int = 86_400) -> DataFrame:
    """client, request_id, allowed: a sliding window that counts admitted requests only, so that each answer depends on those before.

    requests: client, request_id, at (seconds). The state is the times of at most `limit` admitted requests; within a batch a client's requests are
    taken in order of time. Only a late batch could see them otherwise.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"])
        answers = []
        for t in rows["at"].tolist():
            times = [x for x in times if x > t - window]
            answers.append(len(times) < limit)
            if answers[-1]:
                times.append(t)
        state.update((times,))
        yield pd.DataFrame({"client": key[0], "request_id": rows["request_id"], "allowed": answers})

    return requests.groupBy("client").applyInPandasWithState(step, "client bigint, request_id bigint, allowed boolean", "times array<bigint>", "append", GroupStateTimeout.NoTimeout)
