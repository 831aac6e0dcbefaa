"""A fitted space of word features: the vocabulary with its columns and weights is a table that is stored and used on other documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions import text as T


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", min_df: int = 2, max_df: float = 0.95, max_features: int | None = None) -> DataFrame:
    """tok, df, idf, column: the words that min_df documents or more and a share of at most max_df have, in order of tok.

    idf: ln((1 + n) / (1 + df)) + 1. max_features keeps those with the most occurrences (ties by word): a vocabulary's size is the feature here. Null and empty texts count as documents without words. No rows give no words.
    """
    toks = docs.select(T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    # a one for the document and a one for each occurrence, summed up before anything is shuffled
    one = lambda d, n: lambda w: F.struct(w.alias("tok"), F.lit(d).cast("bigint").alias("df"), F.lit(n).cast("bigint").alias("total"))
    told = toks.select(F.inline(F.concat(F.transform(F.array_distinct("t"), one(1, 0)), F.transform("t", one(0, 1)))))
    counted = told.groupBy("tok").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    n = docs.agg(F.count("*").alias("n"))
    kept = counted.crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= F.col("n") * max_df))
    if max_features is not None:
        kept = kept.orderBy(F.desc("total"), "tok").limit(max_features)
    kept = kept.select("tok", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return numbered(kept)


def numbered(words: DataFrame) -> DataFrame:
    """words with `column`, their place in order of tok: numbered within ranges by the first two characters, so no task holds all."""
    ranged = words.withColumn("_r", F.substring("tok", 1, 2))
    sizes = ranged.groupBy("_r").agg(F.count("*").alias("_n"))
    # at most as many rows as there are pairs of token characters (1,296)
    before = sizes.select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_r").orderBy("tok"))
    return ranged.withColumn("_i", place).join(F.broadcast(before), "_r").select("tok", "df", "idf", (F.col("_before") + F.col("_i") - 1).cast("bigint").alias("column"))


def transform(docs: DataFrame, space: DataFrame, key: str = "doc_id", text: str = "text", sublinear: bool = True) -> DataFrame:
    """key and vector (column -> weight) of each document: (1 + ln tf) or tf, times idf, of length 1.

    Words that the space lacks are dropped; a document without any has an empty vector. Rows with equal keys, null ones too, count as one document. An empty table gives no rows.
    """
    toks = docs.select(F.col(key).alias("_key"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    counted = toks.select("_key", F.explode_outer(F.when(F.size("_t") > 0, F.col("_t"))).alias("tok")).groupBy("_key", "tok").agg(F.count("*").alias("tf"))
    weighed = counted.join(space.select("tok", "idf", "column"), "tok", "left").withColumn("w", (1 + F.log("tf") if sublinear else F.col("tf").cast("double")) * F.col("idf"))
    vector = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("column", "w")))))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")))
    out = weighed.groupBy("_key").agg(vector.alias("v"), length.alias("l"))
    return out.select(F.col("_key").alias(key), F.transform_values("v", lambda _, w: w / F.col("l")).alias("vector"))


def contributions(vectors: DataFrame, weights: DataFrame, key: str = "doc_id", k: int = 5) -> DataFrame:
    """key, score, for_it, against_it: a linear score (weights: column, weight) and the k features that add most to it and take most from it, as (column, part).

    The parts of all of a document's features sum up to its score. Keys tell documents apart. Features without a weight add nothing; a document without features has score 0.
    """
    each = vectors.select(F.col(key).alias("_key"), F.explode_outer(F.when(F.size("vector") > 0, F.col("vector"))).alias("column", "x"))
    parts = each.join(weights.select("column", "weight"), "column", "left").withColumn("part", F.coalesce(F.col("x") * F.col("weight"), F.lit(0.0)))
    top = parts.groupBy("_key").agg(F.sum("part").alias("score"), F.array_sort(F.collect_list(F.when(F.col("part") != 0, F.struct((-F.col("part")).alias("o"), "column", "part")))).alias("p"))
    best = F.slice(F.filter("p", lambda x: x["part"] > 0), 1, k)
    worst = F.slice(F.reverse(F.filter("p", lambda x: x["part"] < 0)), 1, k)
    bare = lambda a: F.transform(a, lambda x: F.struct(x["column"], x["part"]))
    return top.select(F.col("_key").alias(key), "score", bare(best).alias("for_it"), bare(worst).alias("against_it"))
