"""Evaluation metrics as aggregates: each takes rows and returns a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.text import ratio


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("y"), F.col(guess).alias("p")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1; a zero denominator gives 0."""
    cells = confusion(df, truth, guess)
    marks = cells.select(F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("fn")),
    )).alias("m")).select("m.*")
    sums = marks.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumns({"support": F.col("tp") + F.col("fn"), "precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)})


def classification(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """accuracy and the macro, micro and weighted averages, one row."""
    each = per_class(df, truth, guess)
    total = F.sum("support")
    averages = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")] + [ratio(F.sum(F.col(c) * F.col("support")), total).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return each.agg(ratio(F.sum("tp"), total).alias("accuracy"), *averages, ratio(F.sum("tp"), F.sum("tp") + F.sum("fp")).alias("micro_f1"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """observed, expected, kappa, n of two raters; 1 where chance alone agrees."""
    cells = confusion(df, a, b)
    n = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "c").agg(F.sum(F.col("na") * F.col("nb")).alias("both"))
    both = n.crossJoin(F.broadcast(chance))
    po, pe = F.col("same") / F.col("total"), F.coalesce("both", F.lit(0)) / F.col("total") / F.col("total")
    return both.select(po.alias("observed"), pe.alias("expected"), F.when(F.abs(1 - pe) < 1e-12, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"), F.col("total").alias("n"))


def _binary(df: DataFrame, truth: str, guess: str) -> DataFrame:
    y, p = F.col(truth), F.col(guess)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.agg(one((y == 1) & (p == 1)).alias("tp"), one((y == 0) & (p == 1)).alias("fp"), one((y == 1) & (p == 0)).alias("fn"), one(~(((y == 1) & (p == 1)) | ((y == 0) & (p == 1)) | ((y == 1) & (p == 0)))).alias("tn"))


def mcc(df: DataFrame, truth: str, guess: str) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    scale = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return _binary(df, truth, guess).select("tp", "fp", "fn", "tn", ratio(tp * tn - fp * fn, scale).alias("mcc"))


def confusion_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return _binary(df, truth, guess).select(p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(tn, tn + fp).alias("specificity"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def calibration(df: DataFrame, truth: str, prob: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_prob, mean_true for all bins of equal width, the last closed; empty ones are 0."""
    spark = df.sparkSession
    at = F.least(F.greatest(F.floor(F.col(prob) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    seen = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("mean_prob"), F.avg(truth).alias("mean_true"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(seen, "bin", "left").na.fill(0)


def calibration_error(df: DataFrame, truth: str, prob: str, bins: int = 10) -> DataFrame:
    """ece, mce, brier, n."""
    per = calibration(df, truth, prob, bins)
    gap = F.abs(F.col("mean_prob") - F.col("mean_true"))
    errors = per.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(F.when(F.col("n") > 0, gap)).alias("mce"))
    brier = df.agg(F.avg((F.col(prob) - F.col(truth)) * (F.col(prob) - F.col(truth))).alias("brier"), F.count("*").alias("n"))
    return errors.crossJoin(F.broadcast(brier))


def auprc(df: DataFrame, truth: str, score: str, ranges: int = 1000) -> DataFrame:
    """Area under precision and recall by trapezoids from (0, 1), a point for each distinct score.

    Scores are counted first and cut into ranges of about equal numbers; running sums are taken over the ranges' totals, of which there are at most `ranges`,
    and then within each range, so that no task orders all scores. Null scores and labels are left out.
    """
    per = df.dropna(subset=[truth, score]).groupBy(F.col(score).alias("s")).agg(F.sum(truth).alias("pos"), F.count("*").alias("n"))
    cuts = per.agg(F.coalesce(F.percentile_approx("s", [i / ranges for i in range(1, ranges)], 10 * ranges), F.expr("array()")).alias("cuts"))
    # a range's number falls as its scores grow
    per = per.crossJoin(F.broadcast(cuts)).select("s", "pos", "n", (-F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col("s")))).alias("range"))
    totals = per.groupBy("range").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    start = totals.select("range", F.coalesce(F.sum("pos").over(earlier), F.lit(0)).alias("pos0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.sum("pos").over(everything).alias("all"))
    order = Window.partitionBy("range").orderBy(F.desc("s"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    points = per.join(F.broadcast(start), "range").select("range", "s", "pos0", "n0", "all", (F.sum("pos").over(upto) + F.col("pos0")).alias("tp"), (F.sum("n").over(upto) + F.col("n0")).alias("seen"))
    points = points.select("tp", "seen", "all", F.lag("tp").over(order).alias("tp0"), F.lag("seen").over(order).alias("seen0"), "pos0", "n0")
    tp0, seen0 = F.coalesce("tp0", "pos0"), F.coalesce("seen0", "n0")
    step = (F.col("tp") / F.col("all") - tp0 / F.col("all")) * (F.col("tp") / F.col("seen") + F.when(seen0 > 0, tp0 / seen0).otherwise(1.0)) / 2
    return points.agg(F.sum(step).alias("auprc"), F.count("*").alias("points"))


def precision_at_k(df: DataFrame, truth: str, score: str, key: str, k: int) -> DataFrame:
    top = df.orderBy(F.col(score).desc(), key).limit(k)
    return top.agg((F.sum(truth) / k).alias("precision_at_k"))


SPAN = ("doc_id", "type", "start", "end")


def span_scores(gold: DataFrame, guess: DataFrame) -> DataFrame:
    """By type: true positives of distinct spans, counts of all, precision, recall, f1."""
    same = gold.select(*SPAN).intersect(guess.select(*SPAN)).groupBy("type").agg(F.count("*").alias("tp"))
    g = gold.groupBy("type").agg(F.count("*").alias("n_gold"))
    p = guess.groupBy("type").agg(F.count("*").alias("n_guess"))
    out = g.join(p, "type", "full_outer").join(same, "type", "left").na.fill(0)
    pr, re = ratio(F.col("tp"), F.col("n_guess")), ratio(F.col("tp"), F.col("n_gold"))
    return out.withColumns({"precision": pr, "recall": re, "f1": ratio(2 * pr * re, pr + re)})


def span_jaccard(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    common = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    return ratio(common, (a1 - a0) + (b1 - b0) - common)


def hierarchical(df: DataFrame, gold: str, guess: str) -> DataFrame:
    """Share of codes that agree in full, in the first three characters, in the first letter."""
    part = lambda n: F.avg((F.left(F.col(gold), F.lit(n)) == F.left(F.col(guess), F.lit(n))).cast("double"))
    return df.agg(F.avg((F.col(gold) == F.col(guess)).cast("double")).alias("full_code"), part(3).alias("category"), part(1).alias("chapter"), F.count("*").alias("n"))


def rouge_n(pairs: DataFrame, n: int, key: str = "pair_id", ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """key, precision, recall, f1 over n-grams, each counted as often as both texts have it. Pairs are scored in their own row, without a shuffle; those without n-grams are left out."""
    from notemill.operators.summaries import common_runs

    sums = common_runs(pairs, [n], key, ref, hyp).select(key, F.col(f"common{n}").alias("m"), *[F.greatest(F.col(c) - (n - 1), F.lit(0)).alias(c) for c in ("na", "nb")]).where("na + nb > 0")
    p, r = ratio(F.col("m"), F.col("nb")), ratio(F.col("m"), F.col("na"))
    return sums.select(key, p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def votes(spans: DataFrame, rule: str, models: int) -> DataFrame:
    """Spans (doc_id, type, start, end) found by any ("union"), all ("intersection") or more than half ("majority") of the models."""
    counted = spans.groupBy(*SPAN).agg(F.countDistinct("model").alias("n_models"))
    least = {"union": 1, "intersection": models, "majority": models // 2 + 1}[rule]
    return counted.where(F.col("n_models") >= least)


def multilabel(df: DataFrame, key: str, label: str, truth: str, guess: str) -> DataFrame:
    """One row: macro, micro and weighted precision, recall and f1 over labels, Hamming loss and the share of keys with every label right. df: a row for each key and label, with 0 or 1."""
    per = df.groupBy(label).agg(F.sum(F.col(truth) * F.col(guess)).alias("tp"), F.sum(guess).alias("g"), F.sum(truth).alias("t"))
    p, r = ratio(F.col("tp"), F.col("g")), ratio(F.col("tp"), F.col("t"))
    per = per.select("tp", "g", "t", p.alias("p"), r.alias("r"), ratio(2 * p * r, p + r).alias("f"))
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("t")), F.sum("t"))
    sums = per.agg(
        F.avg("p").alias("precision_macro"), F.avg("r").alias("recall_macro"), F.avg("f").alias("f1_macro"), ratio(F.sum("tp"), F.sum("g")).alias("precision_micro"), ratio(F.sum("tp"), F.sum("t")).alias("recall_micro"),
        weighted("p").alias("precision_weighted"), weighted("r").alias("recall_weighted"), weighted("f").alias("f1_weighted"),
    )
    pm, rm = F.col("precision_micro"), F.col("recall_micro")
    sums = sums.withColumn("f1_micro", ratio(2 * pm * rm, pm + rm))
    exact = df.groupBy(key).agg(F.min((F.col(truth) == F.col(guess)).cast("int")).alias("same"), F.sum((F.col(truth) != F.col(guess)).cast("int")).alias("wrong"), F.count("*").alias("n"))
    losses = exact.agg((F.sum("wrong") / F.sum("n")).alias("hamming_loss"), F.avg(F.col("same").cast("double")).alias("subset_accuracy"))
    both = sums.crossJoin(F.broadcast(losses))
    return both.select(*[F.round(c, 6).alias(c) for c in both.columns])
