"""Spans of several models put together where they overlap, even if their offsets differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping(spans: DataFrame, voting: str = "union", models: int = 3, key: str = "doc_id") -> DataFrame:
    """key, type, start, end, n_models, n_spans, best_start, best_end, best_model, confidence: a row for each group of overlapping spans.

    spans: key, type, start, end (exclusive), model, confidence. Spans of one key and type that overlap are one group, chains too; those that only
    touch are not. A sweep by start: a group begins where no earlier span reaches. The best span stands for the group: the most confident (null
    least), then the longest, the first, the smallest model. voting keeps groups of any model ("union"), of more than half of `models` ("majority") or of all
    ("intersection"). A null key or type is a value like any other; spans without offsets, or with no length, take no part.
    """
    least = {"union": 1, "majority": models // 2 + 1, "intersection": models}[voting]
    w = Window.partitionBy(key, "type").orderBy("start", "end", "model")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    grouped = spans.where("start < end").withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    worth = F.struct(F.coalesce(F.col("confidence").cast("double"), F.lit(-1.0)), F.col("end") - F.col("start"), -F.col("start"))
    best = F.min_by(F.struct("start", "end", "model", "confidence"), F.struct(-worth["col1"], -worth["col2"], -worth["col3"], F.col("model")))
    out = grouped.groupBy(key, "type", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.countDistinct("model").alias("n_models"), F.count("*").alias("n_spans"), best.alias("b"))
    return out.where(F.col("n_models") >= least).select(key, "type", "start", "end", "n_models", "n_spans", F.col("b.start").alias("best_start"), F.col("b.end").alias("best_end"), F.col("b.model").alias("best_model"), F.col("b.confidence").alias("confidence"))
