"""Drift and service monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.text import words

EPSILON = 1e-6
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def severity(psi: Column) -> Column:
    return F.when(psi < 0.1, "stable").when(psi < 0.2, "warning").otherwise("critical")


def first_and_last(df: DataFrame, order: str, reference: int, window: int) -> DataFrame:
    """df's first `reference` and last `window` rows by `order`, as side "r" and "c" (a row may be both). Two bounded top-k's, no global sort."""
    first = df.orderBy(order).limit(reference).withColumn("side", F.lit("r"))
    return first.unionByName(df.orderBy(F.desc(order)).limit(window).withColumn("side", F.lit("c")))


def psi_numeric(sides: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """psi of column value between side "r" and side "c": equal-width bins over both sides' range; 0 for under 2 values or a constant."""
    x = sides.select("side", F.col(value).cast("double").alias("x"))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.when(F.col("side") == "r", 1).otherwise(0)).alias("nr"), F.sum(F.when(F.col("side") == "c", 1).otherwise(0)).alias("nc"))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    counts = x.crossJoin(F.broadcast(ends)).where("hi > lo").groupBy(at.alias("bin")).agg(F.sum(F.when(F.col("side") == "r", 1).otherwise(0)).alias("r"), F.sum(F.when(F.col("side") == "c", 1).otherwise(0)).alias("c"))
    all_bins = sides.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").na.fill(0)
    r, c = F.col("r") / F.col("nr") + EPSILON, F.col("c") / F.col("nc") + EPSILON
    total = all_bins.crossJoin(F.broadcast(ends)).agg(F.sum((c - r) * F.log(c / r)).alias("psi"), F.min("nr").alias("nr"), F.min("nc").alias("nc"), F.min(F.col("hi") > F.col("lo")).alias("varies"))
    return total.select(F.when((F.col("nr") < 2) | (F.col("nc") < 2) | ~F.col("varies"), 0.0).otherwise(F.greatest("psi", F.lit(0.0))).alias("psi"))


def psi_categorical(sides: DataFrame, label: str) -> DataFrame:
    """psi of a label between the sides."""
    one = lambda s: F.sum(F.when(F.col("side") == s, 1).otherwise(0))
    n = sides.agg(one("r").alias("nr"), one("c").alias("nc"))
    counts = sides.groupBy(label).agg(one("r").alias("r"), one("c").alias("c")).crossJoin(F.broadcast(n))
    r, c = F.col("r") / (F.col("nr") + EPSILON) + EPSILON, F.col("c") / (F.col("nc") + EPSILON) + EPSILON
    return counts.agg(F.greatest(F.sum((c - r) * F.log(c / r)), F.lit(0.0)).alias("psi"))


def text_record(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, doc_length, word_count, vocab_diversity."""
    t = docs.select(F.col(key), F.col(text).alias("t"), words(F.col(text)).alias("w"))
    n = F.size("w")
    return t.select(key, F.length("t").cast("double").alias("doc_length"), n.cast("double").alias("word_count"), F.when(n > 0, F.round(F.size(F.array_distinct(F.transform("w", F.lower))) / n, 6)).otherwise(0.0).alias("vocab_diversity"))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, std (of the population), min, max, n, to 4 places."""
    stats = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
    return stats.groupBy("feature").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_pop("v"), 4).alias("std"), F.round(F.min("v"), 4).alias("min"), F.round(F.max("v"), 4).alias("max"), F.count("*").alias("n"))


def histogram(df: DataFrame, by: str, value: str, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """by, le, n: non-cumulative counts; the last bucket, +Inf, has all."""
    v = F.col(value)
    bucket = F.coalesce(*[F.when(v <= b, F.lit(str(b))) for b in buckets])
    per = df.groupBy(F.col(by), bucket.alias("le")).agg(F.count("*").alias("n"))
    total = per.groupBy(by).agg(F.sum("n").alias("n")).select(by, F.lit("+Inf").alias("le"), "n")
    return per.where("le is not null").unionByName(total)


def percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(*[F.percentile(value, p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)], F.count("*").alias("n"))


def rate_limited(df: DataFrame, client: str, ts: str, limit: int = 100, window: int = 86_400) -> DataFrame:
    """df with seen (requests of the client in the window up to now, rejected ones too), allowed, remaining."""
    w = Window.partitionBy(client).orderBy(F.unix_timestamp(F.col(ts).cast("timestamp"))).rangeBetween(-window + 1, 0)
    seen = F.count("*").over(w)
    return df.withColumn("seen", seen).withColumns({"allowed": F.col("seen") <= limit, "remaining": F.greatest(F.lit(limit) - F.col("seen"), F.lit(0))})
