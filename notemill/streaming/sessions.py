"""Sessions as keyed state that expires, is cleared and holds a bounded number of turns. The batch form is operators/sessions.replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "session bigint, seq bigint, started bigint, turn bigint, held bigint, chars bigint, cleared boolean"


class _Sessions(StatefulProcessor):
    def __init__(self, ttl: int, keep: int):
        self.ttl, self.keep = ttl, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started bigint, last bigint, turns bigint, held array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.open.get() if self.open.exists() else None
        started, last, turns, held = (state[0], state[1], state[2], list(state[3])) if state else (None, None, 0, [])
        batch = pd.concat(list(rows)).sort_values(["at_s", "seq"])
        out = []
        for at, seq, action, chars in zip(batch["at_s"].tolist(), batch["seq"].tolist(), batch["action"].tolist(), batch["chars"].tolist()):
            alive = last is not None and at - last <= self.ttl
            if action == "clear":
                started, last, turns, held = None, None, 0, []
                out.append((key[0], seq, None, 0, 0, 0, alive))
                continue
            if not alive:
                started, turns, held = at, 0, []
            last, turns, held = at, turns + 1, [*held, chars][-self.keep :]
            out.append((key[0], seq, started, turns, len(held), sum(held), False))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is None:
            self.open.clear()
        else:
            self.open.update((started, last, turns, held))
            self.handle.registerTimer((last + self.ttl + 1) * 1000)
        told = pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])
        yield told.astype({"started": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        yield pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in ANSWER.split(", ")})

    def close(self) -> None:
        pass


def session_store(actions: DataFrame, ttl: int = 3600, keep: int = 20, late: str = "1 hour") -> DataFrame:
    """actions (session, at as timestamp, seq, action "turn" or "clear", chars) as a stream: an answer for each, in the session's order of (at, seq).

    started is the second in which the session that the turn belongs to began, turn its number there, held and chars what is kept of it (the last
    `keep` turns), cleared whether a clear met an open session. A session is over once more than ttl seconds pass between its actions, whether a
    timer has removed its state or not, so the answers don't depend on how the rows are cut into batches, as long as batches come in order
    (rows later than the watermark are dropped). State: `keep` numbers for each open session. A session's rows of one batch are sorted in one
    task; the source's maxFilesPerTrigger bounds them. Needs the RocksDB state store (ROCKS).
    """
    rows = actions.withWatermark("at", late).select("session", "at", F.unix_seconds("at").alias("at_s"), "seq", "action", F.coalesce("chars", F.lit(0)).cast("bigint").alias("chars"))
    return rows.groupBy("session").transformWithStateInPandas(_Sessions(ttl, keep), ANSWER, "Append", "EventTime")
