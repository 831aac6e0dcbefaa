"""Corpus search: BM25, TF-IDF cosine, both blended, snippets, re-ranking. Only counts for the query's words leave a document's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions import text as T

K1, B = 1.5, 0.75


def _query_tokens(query: str) -> list[str]:
    """The tokens of a query as those of a text are taken; duplicates stay."""
    import re

    return [t for t in re.findall("[a-z0-9]+", query.lower()) if len(t) > 1 and t not in T.STOPWORDS]


def _is(word: str):
    return lambda t: t == word


def _counted(docs: DataFrame, query: str, key: str, text: str) -> tuple[DataFrame, list[str]]:
    wanted = list(dict.fromkeys(_query_tokens(query)))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("toks"))
    tf = [F.size(F.filter("toks", _is(w))).alias(f"tf{i}") for i, w in enumerate(wanted)]
    return rows.select("doc_id", "text", F.size("toks").alias("dl"), *tf), wanted


def bm25(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, bm25 of every document. One pass for the corpus counts (a row), one for the scores; nothing is shuffled by word."""
    rows, wanted = _counted(docs, query, key, text)
    counts = [F.sum((F.col(f"tf{i}") > 0).cast("bigint")).alias(f"df{i}") for i in range(len(wanted))]
    corpus = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *counts)
    out = rows.crossJoin(F.broadcast(corpus))
    score: Column = F.lit(0.0)
    for t in _query_tokens(query):
        i = wanted.index(t)
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.when(df > 0, F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)).otherwise(0.0)
        score = score + idf * tf * (K1 + 1) / F.greatest(tf + K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1e-6))), F.lit(1e-9))
    return out.select("doc_id", "text", score.alias("bm25"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tok, tf: a row for each word of each document."""
    toks = docs.select(F.col(key).alias("doc_id"), F.explode(T.tokens(F.col(text))).alias("tok"))
    return toks.groupBy("doc_id", "tok").agg(F.count("*").alias("tf"))


def _weighed(post: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, tok, w of postings: (1 + ln tf)(ln((N + 1) / (df + 1)) + 1)."""
    df = post.groupBy("tok").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return post.join(df, "tok").crossJoin(F.broadcast(n)).select("doc_id", "tok", ((1 + F.log("tf")) * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("w"))


def tfidf(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tok, w: (1 + ln tf)(ln((N + 1) / (df + 1)) + 1), each document's of length 1."""
    raw = _weighed(postings(docs, key, text), docs)
    norm = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc_id").select("doc_id", "tok", (F.col("w") / F.col("norm")).alias("w"))


def cosine(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, cosine of the documents that share a word with the query; the query's vector has plain counts.

    A document's length and its product with the query come from one sum over its words.
    """
    toks = _query_tokens(query)
    counts = {t: toks.count(t) for t in toks}
    if not counts:
        return docs.select(F.col(key).alias("doc_id"), F.lit(0.0).alias("cosine")).where(F.lit(False))
    rows = _weighed(postings(docs, key, text), docs)
    asked = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])[F.col("tok")]
    per = rows.where("doc_id is not null").groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.col("w") * asked).alias("dot"))
    # of the query's words only those count that a document has
    held = F.array_intersect(T.tokens(F.coalesce(F.col(text), F.lit(""))), F.array(*map(F.lit, counts)))
    known = docs.where(F.col(key).isNotNull()).select(F.explode(held).alias("tok")).distinct()
    length = known.agg(F.sqrt(F.sum(asked * asked)).alias("len"))
    return per.where("dot is not null").crossJoin(F.broadcast(length)).select("doc_id", (F.col("dot") / F.col("norm") / F.col("len")).alias("cosine"))


def hybrid(docs: DataFrame, query: str, alpha: float = 0.5, top_k: int = 10, min_score: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The top_k by alpha * BM25 / max + (1 - alpha) * cosine; of equal scores the smaller doc_id."""
    scored = bm25(docs, query, key, text).select("doc_id", "bm25")
    best = scored.agg(F.max("bm25").alias("best"))
    both = scored.join(cosine(docs, query, key, text), "doc_id", "left").crossJoin(F.broadcast(best))
    b, c = T.ratio(F.col("bm25"), F.col("best")), F.coalesce("cosine", F.lit(0.0))
    out = both.select("doc_id", (alpha * b + (1 - alpha) * c).alias("raw"), F.round(b, 4).alias("bm25_score"), F.round(c, 4).alias("tfidf_score"))
    out = out.orderBy(F.round("raw", 9).desc(), "doc_id").limit(2 * top_k).where(F.col("raw") >= min_score)
    return out.orderBy(F.round("raw", 9).desc(), "doc_id").limit(top_k).select("doc_id", F.round("raw", 4).alias("score"), "bm25_score", "tfidf_score")


def snippet(text: Column, query: str, max_len: int = 200) -> Column:
    """What stands around the first query word, or the text's start."""
    low = F.lower(text)
    at = F.array_min(F.array(*[F.when(F.locate(t, low) > 0, F.locate(t, low) - 1) for t in _query_tokens(query)]))
    half = max_len // 2
    start = F.greatest(at - half, F.lit(0))
    end = F.least(at + half, F.length(text))
    more = F.lit("…")
    around = F.concat(F.when(start > 0, more).otherwise(""), T.strip(F.substring(text, start + 1, end - start)), F.when(end < F.length(text), more).otherwise(""))
    head = F.concat(F.regexp_replace(F.left(text, F.lit(max_len)), rf"{T.SPACE}+$", ""), F.when(F.length(text) > max_len, more).otherwise(""))
    return F.when(at.isNull(), head).otherwise(around)


def ngrams(docs: DataFrame, low: int, high: int, text: str = "text", *keep: str) -> DataFrame:
    """The kept columns and ngram: a row for each run of low to high words of the lower-cased text."""
    split = docs.select(*keep, T.words(F.lower(text)).alias("w"))
    w = F.col("w")

    def runs(n: int) -> Column:
        of = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, of).otherwise(F.array().cast("array<string>"))

    return split.select(*keep, F.explode(F.flatten(F.array(*map(runs, range(low, high + 1))))).alias("ngram"))


def bag_of_words(docs: DataFrame, low: int = 1, high: int = 1, max_features: int = 1000, text: str = "text") -> DataFrame:
    """The most frequent n-grams with their counts; of equal counts the smaller n-gram."""
    grams = ngrams(docs, low, high, text)
    return grams.groupBy("ngram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ngram").limit(max_features)


def bag_counts(docs: DataFrame, vocabulary: DataFrame, low: int = 1, high: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ngram, n for the n-grams of a vocabulary."""
    grams = ngrams(docs, low, high, text, key)
    return grams.join(vocabulary.select("ngram"), "ngram").groupBy(key, "ngram").agg(F.count("*").alias("n"))
