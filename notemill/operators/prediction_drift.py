"""Drift of predictions by model: the first `reference` ones stay frozen, the last `window` ones slide."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.operators.monitoring import EPSILON, severity

REFERENCE, WINDOW, THRESHOLD = 500, 100, 0.1


def ends(predictions: DataFrame, reference: int = REFERENCE, window: int = WINDOW) -> DataFrame:
    """model, side ("r" or "c"), at, confidence, label: a model's first and last predictions by `at` (unique within a model; a row may be both).

    Each task passes on at most `reference` and `window` rows of a model before anything is shuffled, so a model with a third of all rows costs no more.
    """
    p = predictions.select("model", "at", F.col("confidence").cast("double").alias("confidence"), "label")
    part = lambda side, order, n: p.withColumn("_k", F.row_number().over(Window.partitionBy("model").orderBy(order))).where(F.col("_k") <= n).select("model", F.lit(side).alias("side"), "at", "confidence", "label")
    return part("r", F.col("at"), reference).unionByName(part("c", F.col("at").desc(), window))


def _sum_of(side: str):
    return F.sum((F.col("side") == side).cast("int"))


def _psi(counts: DataFrame, name: str) -> DataFrame:
    """model and psi over counts (model, r, c, nr, nc). A bin that both sides leave empty adds nothing, so none is made up."""
    r, c = F.col("r") / (F.col("nr") + EPSILON) + EPSILON, F.col("c") / (F.col("nc") + EPSILON) + EPSILON
    return counts.groupBy("model").agg(F.greatest(F.sum((c - r) * F.log(c / r)), F.lit(0.0)).alias(name))


def psi_by_model(sides: DataFrame, bins: int = 10) -> DataFrame:
    """model, confidence_psi over equal-width bins of both sides' range; 0 for a side of under two values or a constant. Null confidences don't count."""
    w = Window.partitionBy("model")
    x = sides.where("confidence is not null").select("model", "side", "confidence", F.min("confidence").over(w).alias("lo"), F.max("confidence").over(w).alias("hi"), _sum_of("r").over(w).alias("nr"), _sum_of("c").over(w).alias("nc"))
    at = F.least(F.floor((F.col("confidence") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    counts = x.where("hi > lo and nr > 1 and nc > 1").groupBy("model", at.alias("bin"), "nr", "nc").agg(_sum_of("r").alias("r"), _sum_of("c").alias("c"))
    return sides.select("model").distinct().join(_psi(counts, "confidence_psi"), "model", "left").na.fill(0.0, ["confidence_psi"])


def label_psi_by_model(sides: DataFrame) -> DataFrame:
    """model, label_psi; a null label is a label of its own."""
    n = sides.groupBy("model").agg(_sum_of("r").alias("nr"), _sum_of("c").alias("nc"))
    return _psi(sides.groupBy("model", "label").agg(_sum_of("r").alias("r"), _sum_of("c").alias("c")).join(n, "model"), "label_psi")


def report(sides: DataFrame) -> DataFrame:
    """Per model: n_reference, n_current, confidence_psi, confidence_severity, label_psi, label_severity, the sides' means and deviations, drifted (by confidence)."""
    of = lambda f, side, c: F.round(f(F.when(F.col("side") == side, F.col(c))), 4)
    stats = [of(f, s, "confidence").alias(f"{n}_{w}") for s, n in (("r", "reference"), ("c", "current")) for f, w in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    sums = sides.groupBy("model").agg(_sum_of("r").alias("n_reference"), _sum_of("c").alias("n_current"), *stats)
    psi = lambda c: F.round(c, 6).alias(c)
    told = sums.join(psi_by_model(sides), "model").join(label_psi_by_model(sides), "model")
    told = told.select(*sums.columns, psi("confidence_psi"), psi("label_psi"))
    return told.withColumns({"confidence_severity": severity(F.col("confidence_psi")), "label_severity": severity(F.col("label_psi")), "drifted": F.col("confidence_psi") >= THRESHOLD})


def status(text_psi: DataFrame, models: DataFrame) -> DataFrame:
    """One row: text_score (mean of text_psi.psi), models_drifted, overall: "stable", "warning" for drift of texts or of a model, "drifted" for both."""
    t = text_psi.agg(F.round(F.avg("psi"), 6).alias("text_score"))
    m = models.agg(F.coalesce(F.sum(F.col("drifted").cast("int")), F.lit(0)).alias("models_drifted"))
    text, model = F.coalesce(F.col("text_score") >= THRESHOLD, F.lit(False)), F.col("models_drifted") > 0
    return t.crossJoin(F.broadcast(m)).withColumn("overall", F.when(text & model, "drifted").when(text | model, "warning").otherwise("stable"))
