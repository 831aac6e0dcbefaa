"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 poor, 2 good. P(grade <= k) = logistic(threshold_k - score), with ordered thresholds and one score for all grades:
the sum of weights of a text's hashed features. Features are the distinct words (each in two of 2^20 buckets, so that a word seldom shares both
with another) and coarse shapes: the shares of symbols, capitals and distinct words and the mean word length, in steps.

It is fitted on a bounded sample of the labelled rows (TRAIN_ROWS); scoring covers whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from notemill.llm import common as C

BUCKET_BITS, STEPS, GRADES = 20, 12, 3
#: Rows to fit on at most, and of these how many must have a feature for it to get a weight.
TRAIN_ROWS, LEAST_ROWS = 10_000, 8
ROUNDS, BATCH, RATE, DECAY = 1_200, 256, 0.1, 3e-4

_SYMBOL = np.ones(256, bool)
_SYMBOL[[32, *range(9, 14), *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit feature) of a run of texts, each pair once; the two halves of a feature choose its buckets."""
    words = C.Words(data, offsets)
    n, counts = len(offsets) - 1, words.counts
    owner = np.repeat(np.arange(n), counts)
    hashes = words.hashes()
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    owner, hashes = owner[new], hashes[new]
    size = np.maximum(np.diff(offsets), 1)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    shares = [per(_SYMBOL[data]) / size * 3, per(_CAPITAL[data]) / size * 2, np.bincount(owner, minlength=n) / np.maximum(counts, 1), np.bincount(np.repeat(np.arange(n), counts), words.end - words.start, minlength=n) / np.maximum(counts, 1) / 20]
    shapes = [C.mix(np.uint64(1 + i * 64) + np.minimum(s * STEPS, STEPS - 1).astype(np.uint64)) for i, s in enumerate(shares)]
    return np.concatenate([owner, *[np.arange(n)] * len(shapes)]), np.concatenate([hashes, *shapes])


def buckets(feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << BUCKET_BITS) - 1)
    return (feature & low).astype(np.int32), ((feature >> np.uint64(32)) & low).astype(np.int32)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(owner: np.ndarray, feature: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the buckets, thresholds) by gradient steps scaled by their history, over batches of rows in order."""
    n, size = len(grade), 1 << BUCKET_BITS
    first, second = buckets(feature)
    often = np.minimum(np.bincount(first, minlength=size)[first], np.bincount(second, minlength=size)[second]) >= LEAST_ROWS
    owner, first, second = owner[often], first[often], second[often]
    used = np.flatnonzero(np.bincount(first, minlength=size) + np.bincount(second, minlength=size))
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used))
    first, second = place[first], place[second]
    everything, size = np.zeros(size, np.float32), len(used)
    order = np.argsort(owner, kind="stable")
    first, second, ends = first[order], second[order], np.searchsorted(owner[order], np.arange(n + 1))
    owner = owner[order]
    weights, history = np.zeros(size), np.full(size, 1e-6)
    share = np.cumsum(np.bincount(grade, minlength=GRADES) + 1)[:-1] / (n + GRADES)
    cuts = np.log(share / (1 - share))
    cut_history = np.full(len(cuts), 1e-6)
    for step in range(ROUNDS if n else 0):
        low = step * BATCH % n
        high = min(low + BATCH, n)
        at, y, m = slice(ends[low], ends[high]), grade[low:high], high - low
        score = np.bincount(owner[at] - low, weights[first[at]] + weights[second[at]], minlength=m)
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        above, below = _logistic(edge[y + 1] - score), _logistic(edge[y] - score)
        p = np.maximum(above - below, 1e-9)
        up, down = above * (1 - above) / p, below * (1 - below) / p
        each = ((up - down) / m)[owner[at] - low]  # of the loss, in the score
        g = np.bincount(first[at], each, minlength=size) + np.bincount(second[at], each, minlength=size) + DECAY * weights
        history += g * g
        weights -= RATE * g / np.sqrt(history)
        gc = np.array([(down[y == k + 1].sum() - up[y == k].sum()) / m for k in range(len(cuts))])
        cut_history += gc * gc
        cuts = np.maximum.accumulate(cuts - RATE * gc / np.sqrt(cut_history) + np.arange(len(cuts)) * 1e-9)
    everything[used] = weights
    return everything, cuts


def judge(owner, feature, n, weights, cuts) -> tuple[np.ndarray, np.ndarray]:
    """(expected grade, probability of the highest grade)."""
    first, second = buckets(feature)
    score = np.bincount(owner, weights[first] + weights[second], minlength=n)
    over = 1 - _logistic(cuts[:, None] - score[None, :])
    return over.sum(axis=0), over[-1]


def _featured(batches):
    for batch in batches:
        for low, high, data, offsets in C.text_chunks(batch.column(1)):
            owner, feature = features(data, offsets)
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(high - low + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(ends), pa.array(feature[order].view(np.int64)))], ["grade", "features"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Fits on the `rows` labelled rows whose keys have the smallest hashes: at most that many lists of features come to the driver."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).otherwise(2)
    some = labels.dropna(subset=[key, "quality", "toxic"]).groupBy(F.col(key).alias("key")).agg(F.min(grade).alias("grade")).orderBy(F.xxhash64("key"), "key").limit(rows)
    some = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(some), "key").select("grade", "text")
    got = some.mapInArrow(_featured, "grade int, features array<bigint>").toArrow()
    lists = got.column("features").combine_chunks()
    grades = got.column("grade").to_numpy()
    ends = lists.offsets.to_numpy()
    feature = lists.values.to_numpy().view(np.uint64)[ends[0] : ends[-1]] if len(grades) else np.zeros(0, np.uint64)
    return fit(np.repeat(np.arange(len(grades), dtype=np.int32), np.diff(ends)), feature, grades.astype(np.int64))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs with expected_grade (0 to 2), good_prob (probability of grade 2) and keep (good_prob >= least).

    labels: key, quality and toxic (0 or 1); rows with a null are left out, of several for a key the worst counts. Null and
    empty texts are judged by their shapes alone. Repeated rows and keys are judged one by one; columns of docs stay, but
    those of the three names are replaced. Without labelled rows every text has the same grade.
    """
    spark = docs.sparkSession
    weights, cuts = train(docs, labels, key, text, rows)
    model = spark.sparkContext.broadcast((weights, cuts))
    names = [c for c in docs.columns if c not in ("expected_grade", "good_prob", "keep")]
    place = names.index(text)

    def run(batches):
        w, c = model.value
        for batch in batches:
            for low, high, data, offsets in C.text_chunks(batch.column(place)):
                owner, feature = features(data, offsets)
                grade, good = judge(owner, feature, high - low, w, c)
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(grade), pa.array(good), pa.array(good >= least)], [*names, "expected_grade", "good_prob", "keep"])

    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = StructType(list(kept.schema.fields)).add("expected_grade", "double").add("good_prob", "double").add("keep", "boolean")
    return kept.mapInArrow(run, schema)
