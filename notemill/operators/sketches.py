"""Quantile sketches (KLL) and counts by window, stored once and merged over any span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch: ranks are off by about 1.33 % of n at most, with a chance of 99 %.
K = 200
ERROR = 0.0133
QUANTILES = (0.5, 0.95, 0.99)


def sketched(df: DataFrame, by: list[str], ts: str, value: str, failed: Column, width: str = "5 minutes", k: int = K) -> DataFrame:
    """by, start_s, n, failures, total, sketch (null where no value is): a row for each window. Partial sketches are built by tasks before the shuffle."""
    d = df.select(*by, F.window(F.col(ts).cast("timestamp"), width).alias("w"), F.col(value).cast("double").alias("v"), failed.alias("f"))
    sums = d.groupBy(*by, "w").agg(F.count("*").alias("n"), F.count(F.when(F.col("f"), 1)).alias("failures"), F.sum("v").alias("total"), F.count("v").alias("n_values"), F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"))
    return sums.select(*by, F.unix_timestamp("w.start").alias("start_s"), "n", "failures", "total", F.when(F.col("n_values") > 0, F.col("sketch")).alias("sketch"))


def over(windows: DataFrame, by: list[str], span_s: int | None = None, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """by, start_s (of spans of span_s seconds; without, one row over all), n, failures, error_share, a_minute (only for spans), mean, p50, p95, ... of merged windows."""
    start = [] if span_s is None else [(F.floor(F.col("start_s") / span_s) * span_s).cast("bigint").alias("start_s")]
    sums = windows.groupBy(*by, *start).agg(F.sum("n").alias("n"), F.sum("failures").alias("failures"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch").alias("sketch"))
    rate = [] if span_s is None else [(F.col("n") * 60 / span_s).alias("a_minute")]
    empty = F.kll_sketch_get_n_double("sketch") == 0
    q = [F.when(~empty, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(f"p{round(p * 100)}") for p in quantiles]
    return sums.select(*by, *(["start_s"] if start else []), "n", "failures", (F.col("failures") / F.col("n")).alias("error_share"), *rate, F.when(~empty, F.col("total") / F.kll_sketch_get_n_double("sketch")).alias("mean"), *q)
