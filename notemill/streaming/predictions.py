"""The frozen reference and the sliding window of predictions as keyed state."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from notemill.operators import prediction_drift as D

_SIDE = "array<struct<at:bigint,confidence:double,label:string>>"
#: Parts of a model's predictions that keep state of their own, so that a model with many rows is not one task's.
PARTS = 8


def tracked(predictions: DataFrame, reference: int = D.REFERENCE, window: int = D.WINDOW, parts: int = PARTS) -> DataFrame:
    """Stream of predictions (model, at, confidence, label) to: model, part, n seen, first and last of the part.

    The state of a part is its `reference` smallest and `window` largest by `at`: both can be merged in any order, so the answer depends neither on
    how rows are cut into batches nor on the order in which they come. A batch is read frame by frame; only the state is held.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last = state.get if state.exists else (0, [], [])
        first, last = [tuple(x) for x in first], [tuple(x) for x in last]
        at = lambda x: x[0]
        for batch in batches:
            rows = [(a, None if pd.isna(c) else c, x) for a, c, x in zip(batch["at"].tolist(), batch["confidence"].tolist(), batch["label"].tolist())]
            n += len(rows)
            first, last = heapq.nsmallest(reference, first + rows, key=at), heapq.nlargest(window, last + rows, key=at)
        state.update((n, first, last))
        yield pd.DataFrame({"model": [key[0]], "part": [key[1]], "n": [n], "first": [first], "last": [last]})

    p = predictions.select("model", F.pmod("at", F.lit(parts)).cast("bigint").alias("part"), F.col("at").cast("bigint").alias("at"), F.col("confidence").cast("double").alias("confidence"), "label")
    schema = f"n bigint, first {_SIDE}, last {_SIDE}"
    return p.groupBy("model", "part").applyInPandasWithState(step, f"model string, part bigint, {schema}", schema, "update", GroupStateTimeout.NoTimeout)


def merged(told: DataFrame, reference: int = D.REFERENCE, window: int = D.WINDOW) -> DataFrame:
    """The sides (as prediction_drift.ends) from what `tracked` told: of each part what was told last, of a model's parts the first and last again."""
    now = told.groupBy("model", "part").agg(F.max_by(F.struct("first", "last"), "n").alias("s"))
    first, last = (now.select("model", F.inline(f"s.{x}")) for x in ("first", "last"))
    return D.ends(first, reference, 0).where("side = 'r'").unionByName(D.ends(last, 0, window).where("side = 'c'"))
