"""Per-text algorithms that are inherently sequential: extractive summaries by TextRank, longest common subsequences, greedy span matching.

Spark deals out the rows; a task works on one text at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.functions import spans as S
from notemill.functions.text import preprocess, ratio, sentences, words

#: What makes a sentence important; share and largest number of sentences by detail.
IMPORTANT = [re.compile(p, re.IGNORECASE) for p in (
    r"\b(?:diagnosis|diagnosed|impression)\b", r"\b(?:treatment|therapy|plan|prescrib|recommend)\b", r"\b(?:significant|critical|urgent|emergent|stat|acute)\b", r"\b(?:increased|elevated|decreased|abnormal|positive)\b",
    r"\b(?:medication|drug|dose|dosage|mg|mcg)\b", r"\b(?:follow.?up|refer(?:ral)?|consult)\b", r"\b(?:procedure|surgery|operation|biopsy)\b", r"\b(?:allerg(?:y|ic)|reaction|contraindic)\b",
)]
DETAIL = {"brief": (0.15, 5), "standard": (0.30, 12), "detailed": (0.50, 25)}
DAMPING, ROUNDS, ENOUGH = 0.85, 100, 1e-4
#: Pairs of texts whose words are held at a time.
PAIRS = 64


def rank_sentences(found: list[str]) -> np.ndarray:
    """Biased PageRank over the cosines of the sentences' words, tf and idf log-scaled.

    The matrix of cosines is never made: it is the product of the sparse matrix of weights with its transpose, without the diagonal, so a round is two
    sparse products and memory follows the words. Scores are rounded so that equal sentences tie.
    """
    n, vocabulary = len(found), {}
    row, column, value = [], [], []
    for i, s in enumerate(found):
        for w, c in Counter(re.findall(r"\w\w+", s.lower())).items():
            row.append(i)
            column.append(vocabulary.setdefault(w, len(vocabulary)))
            value.append(1 + math.log(c))
    row, column, m = np.array(row, np.int64), np.array(column, np.int64), max(1, len(vocabulary))
    weight = np.array(value) * (np.log((1 + n) / (1 + np.bincount(column, minlength=m))) + 1)[column]
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=n))
    weight = weight / norm[row]
    own = (norm > 0).astype(float)
    near = lambda x: np.bincount(row, weight * np.bincount(column, weight * x[row], minlength=m)[column], minlength=n) - own * x
    sums = near(np.ones(n))
    sums = np.where(np.abs(sums) < 1e-12, 1, sums)
    bias = np.array([1 + 0.2 * sum(bool(p.search(s)) for p in IMPORTANT) for s in found])
    bias /= bias.sum()
    score = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        new = (1 - DAMPING) * bias + DAMPING * near(score / sums)
        change, score = np.abs(new - score).sum(), new
        if change < ENOUGH:
            break
    return np.round(score, 10)


def summary_of(found: list[str], share: float, most: int) -> list[str]:
    """The best sentences in order of place: a share of them, one at least and `most` at most."""
    target = min(max(1, math.ceil(len(found) * share)), most)
    order = sorted(range(len(found)), key=rank_sentences(found).__getitem__, reverse=True)[:target] if len(found) > 1 else range(len(found))
    return [found[i] for i in sorted(order)]


def summarise(docs: DataFrame, detail: str = "standard", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sentences (in the text, of over 15 characters), kept, summary. All sentences of a text are ranked together."""
    share, most = DETAIL[detail]
    kind = docs.schema[key].dataType.simpleString()
    cut = docs.select(F.col(key).alias("key"), F.filter(sentences(preprocess(F.coalesce(F.col(text), F.lit("")))), lambda s: F.length(s) > 15).alias("s"))

    def run(batches):
        for batch in batches:
            found = batch.column(1).to_pylist()
            chosen = [summary_of(s, share, most) for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, found), pa.int64()), pa.array(map(len, chosen), pa.int64()), pa.array(map(" ".join, chosen), pa.string())], ["key", "sentences", "kept", "summary"])

    return cut.mapInArrow(run, f"key {kind}, sentences bigint, kept bigint, summary string").withColumnRenamed("key", key)


def key_findings(docs: DataFrame, most: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, rank, score, sentence: the sentences of over 15 characters that the most of IMPORTANT are found in, first ones first; at most `most`, and none without any. Null texts have none. Rows are read one by one, in the JVM."""
    cut = F.filter(sentences(preprocess(F.coalesce(F.col(text), F.lit("")))), lambda s: F.length(s) > 15)
    # a pattern is tried only on sentences that hold one of its pieces
    hit = lambda s, low, p: F.when(S.may(low, p) & s.rlike(p), 1).otherwise(0).cast("bigint")
    score = lambda s: S.let(F.lower(s), lambda low: sum((hit(s, low, "(?i)" + p.pattern) for p in IMPORTANT), F.lit(0).cast("bigint")))
    scored = F.filter(F.transform(cut, lambda s, i: F.struct((-score(s)).alias("o"), i.alias("i"), s.alias("s"))), lambda x: x["o"] < 0)
    rows = docs.select(F.col(key), F.posexplode(F.slice(F.sort_array(scored), 1, most)).alias("rank", "x"))
    return rows.select(key, (F.col("rank") + 1).alias("rank"), (-F.col("x.o")).alias("score"), F.col("x.s").alias("sentence"))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence. A row of the table is one number with a bit for each word of a: a bit that is off marks where the length grows, so
    a word of b costs a few operations on len(a) bits.
    """
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        here = row & places.get(w, 0)
        row = ((row + here) | (row - here)) & full
    return len(a) - row.bit_count()


def common_runs(pairs: DataFrame, sizes: list[int], key: str = "pair_id", ref: str = "ref", hyp: str = "hyp", lcs: bool = False) -> DataFrame:
    """key, common<n> (runs of n words that both texts have, each as often as both) for each of sizes, lcs (the longest common subsequence, where asked for), na, nb (words of each).

    Null texts have no words. A few pairs are made into Python's words at a time, so memory doesn't follow the batch.
    """
    kind = pairs.schema[key].dataType.simpleString()
    of = lambda c: words(F.lower(F.coalesce(F.col(c), F.lit(""))))
    cut = pairs.select(F.col(key).alias("key"), of(ref).alias("a"), of(hyp).alias("b"))
    runs = lambda a, n: Counter(a if n == 1 else zip(*(a[i:] for i in range(n))))
    common = lambda a, b, n: sum((runs(a, n) & runs(b, n)).values())
    names = ["key", *[f"common{n}" for n in sizes], *["lcs"] * lcs, "na", "nb"]

    def run(batches):
        for batch in batches:
            told = []
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                for a, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    told.append([*[common(a, b, n) for n in sizes], *([common_subsequence(a, b)] if lcs else []), len(a), len(b)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(t, pa.int64()) for t in (zip(*told) if told else [[]] * (len(names) - 1))]], names)

    return cut.mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} bigint" for n in names[1:])).withColumnRenamed("key", key)


def rouge_l(pairs: DataFrame, key: str = "pair_id", ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """key, precision, recall, f1 of the longest common subsequence of words."""
    kind = pairs.schema[key].dataType.simpleString()
    cut = pairs.select(F.col(key).alias("key"), words(F.lower(ref)).alias("a"), words(F.lower(hyp)).alias("b"))

    def run(batches):
        for batch in batches:
            a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([common_subsequence(x, y) for x, y in zip(a, b)], pa.int64()), pa.array(map(len, a), pa.int64()), pa.array(map(len, b), pa.int64())], ["key", "lcs", "na", "nb"])

    got = cut.mapInArrow(run, f"key {kind}, lcs bigint, na bigint, nb bigint")
    p, r = ratio(F.col("lcs"), F.col("nb")), ratio(F.col("lcs"), F.col("na"))
    return got.select(F.col("key").alias(key), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def rouge(pairs: DataFrame, key: str = "pair_id", ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """key, rouge1, rouge2 and rougeL (structs of precision, recall and f1), reference_length, hypothesis_length, length_ratio: all of them from one reading of a pair, without a shuffle.

    Null texts have no words; what would be divided by 0 is 0. Pairs with equal or null keys are scored one by one.
    """
    got = common_runs(pairs, [1, 2], key, ref, hyp, True)

    def scores(hits: str, less: int, name: str):
        p, r = (ratio(F.col(hits), F.greatest(F.col(c) - less, F.lit(0))) for c in ("nb", "na"))
        return F.struct(p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")).alias(name)

    return got.select(key, scores("common1", 0, "rouge1"), scores("common2", 1, "rouge2"), scores("lcs", 0, "rougeL"), F.col("na").alias("reference_length"), F.col("nb").alias("hypothesis_length"), ratio(F.col("nb"), F.col("na")).alias("length_ratio"))


def partial_matches(gold: DataFrame, guess: DataFrame, key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """By key: credit, n_gold, n_guess. In order of start, a guessed span takes the unused gold span with the largest Jaccard share of characters, if
    it is `least` or more; a different type halves the credit.
    """
    pack = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "type"))).alias(name))
    both = pack(gold, "g").join(pack(guess, "p"), key, "full_outer")
    kind = gold.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, g, p = (batch.column(i).to_pylist() for i in range(3))
            credit = []
            for have, want in zip(g, p):
                free, total = [tuple(x.values()) for x in have or []], 0.0
                for s, e, t in (tuple(x.values()) for x in want or []):
                    shares = [max(0, min(e, b) - max(s, a)) / max(1, max(e, b) - min(s, a) if min(e, b) > max(s, a) else (e - s) + (b - a)) for a, b, _ in free]
                    if shares and max(shares) >= least:
                        i = shares.index(max(shares))
                        total += shares[i] * (1.0 if free[i][2] == t else 0.5)
                        free.pop(i)
                credit.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(credit), pa.array([len(x or []) for x in g], pa.int64()), pa.array([len(x or []) for x in p], pa.int64())], ["key", "credit", "n_gold", "n_guess"])

    return both.select(F.col(key).alias("key"), "g", "p").mapInArrow(run, f"key {kind}, credit double, n_gold bigint, n_guess bigint").withColumnRenamed("key", key)
