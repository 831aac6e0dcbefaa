"""Benchmark decontamination by winnowing.

Every window of 10 words holds six 5-word grams; the smallest of their hashes (the rightmost of ties) is the window's
fingerprint, and its place. Equal windows choose the same gram at the same place, so a passage of 10 words or more that a
document shares with an item always shares a fingerprint. Fingerprints are joined and each hit is extended word by word to
both sides; what comes to 10 words or more is a hit, whatever the hashes said.

Items shorter than a window are windows of their own length: for each such length (1 to 9), grams of that length are
looked up as they are.

A bitmap of fixed size, made of the items' fingerprints, tells a document's task which of its fingerprints can be in the
join at all; it only saves shuffling and its size doesn't depend on the items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm import common as C

WINDOW, GRAM = 10, 5
SIDE = WINDOW - GRAM
BITMAP_BITS = 24
CANDIDATE = "struct<fp:bigint,pos:int,n:int,gram:string,before:array<string>,after:array<string>>"


def _winnowed(words: C.Words, grams: np.ndarray) -> np.ndarray:
    """Positions of the grams that the windows choose."""
    per = WINDOW - GRAM + 1
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    last = len(words.start) - WINDOW
    if last < 0:
        return np.zeros(0, np.int64)
    begin = np.flatnonzero(owner[: last + 1] == owner[WINDOW - 1 :])
    best, place = grams[begin], begin.copy()
    for j in range(1, per):
        g = grams[begin + j]
        better = g <= best
        best[better] = g[better]
        place[better] = begin[better] + j
    return np.unique(place)


def _candidates(words: C.Words, lengths: list[int], bitmap: np.ndarray | None):
    """(text, fingerprint, place in its text, gram length) of each fingerprint that may be in the join; lengths: of short windows, 0 for winnowing."""
    hashes = words.hashes()
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    for n in lengths:
        grams = C.gram_hashes(hashes, n or GRAM)
        if n:
            at = np.flatnonzero(owner[: len(grams)] == owner[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
        else:
            at = _winnowed(words, grams)
        fp = grams[at] ^ np.uint64(n)
        if bitmap is not None:
            bit = fp & np.uint64((1 << BITMAP_BITS) - 1)
            at_all = (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
            keep = at_all.astype(bool)
            at, fp = at[keep], fp[keep]
        for w, f in zip(at.tolist(), fp.view(np.int64).tolist()):
            yield int(owner[w]), f, w, n or GRAM, n == 0


def _scan(key_types: list[str], lengths, bitmap, items: bool):
    """For mapInArrow over (keys..., text): keys, n_words, candidates. An item has windows of its own length only."""

    def run(batches):
        bits = bitmap.value if bitmap is not None else None
        for batch in batches:
            for low, high, data, offsets in C.text_chunks(batch.column(batch.num_columns - 1)):
                words = C.Words(data, offsets)
                first, found = words.first, [[] for _ in range(high - low)]
                for text, fp, w, n, sides in _candidates(words, lengths, bits):
                    a, b = int(first[text]), int(first[text + 1])
                    if items and (b - a != n if not sides else b - a < WINDOW):
                        continue
                    side = SIDE if sides else 0
                    found[text].append({
                        "fp": fp, "pos": w - a, "n": n,
                        "gram": " ".join(words.word(i) for i in range(w, w + n)),
                        "before": [words.word(i) for i in range(w - 1, max(a, w - side) - 1, -1)],
                        "after": [words.word(i) for i in range(w + n, min(b, w + n + side))],
                    })
                kept = [batch.column(i).slice(low, high - low) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(words.counts, pa.int64()), pa.array(found, _CANDIDATES)], [*key_types, "n_words", "found"])

    return run


_STRINGS = pa.list_(pa.string())
_CANDIDATES = pa.list_(pa.struct([("fp", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("gram", pa.string()), ("before", _STRINGS), ("after", _STRINGS)]))


def _bitmap(fps: DataFrame) -> np.ndarray:
    """2^BITMAP_BITS bits, set where a fingerprint has its low bits; at most that many bits come to the driver."""
    bit = F.col("fp").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    rows = fps.select((bit / 32).cast("int").alias("w"), bit.bitwiseAND(F.lit(31)).alias("b")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, cast(b as int)))").alias("v")).collect()
    out = np.zeros(1 << (BITMAP_BITS - 5), "<u4")
    for w, v in rows:
        out[w] = v
    return out.view(np.uint8)


def _same(a: str, b: str) -> Column:
    """How many words of two context lists agree from their start on."""
    out = F.lit(SIDE)
    for i in reversed(range(SIDE)):
        x, y = F.get(a, F.lit(i)), F.get(b, F.lit(i))
        out = F.when(x.isNull() | y.isNull() | (x != y), F.lit(i)).otherwise(out)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Per row of docs: key, n_words, n_hit (words inside a window of an item), spans (merged [start, end) in words), item_ids (sorted as strings).

    Words: A-Z lower-cased, runs of digits, letters and non-ASCII. Null and empty texts have no words and hit nothing;
    items without words are never found; an empty items table finds nothing. Repeated rows, repeated keys and null keys
    are judged row by row. Equal items are all reported; an item without an id hits words but has no id to report. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    own = items.select(F.col(item).alias("item"), F.col(text).alias("text"))
    lengths = [0, *range(1, WINDOW)]
    scanned = own.mapInArrow(_scan(["item"], lengths, None, True), f"item {own.schema['item'].dataType.simpleString()}, n_words bigint, found array<{CANDIDATE}>")
    index = C.written(scanned.select("item", F.inline("found")), "items")
    # an item's window that comes again, in it or in another, is one row with all its items
    index = index.groupBy("fp", "n", "gram", "before", "after").agg(F.collect_set("item").alias("items"))
    index = C.written(index, "windows")
    present = sorted({0 if r.sided else r.n for r in index.select("n", ((F.size("before") > 0) | (F.size("after") > 0)).alias("sided")).distinct().collect()})
    bits = spark.sparkContext.broadcast(_bitmap(index))
    rows = C.with_row(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("_row", "key", "text")
    rows = C.written(rows.mapInArrow(_scan(["_row", "key"], present, bits, False), f"_row bigint, key {kind}, n_words bigint, found array<{CANDIDATE}>"), "fingerprints")
    hits = rows.where(F.size("found") > 0).select("_row", F.inline("found")).alias("d")
    theirs = index.select("fp", "gram", F.col("before").alias("before_i"), F.col("after").alias("after_i"), "items", F.col("n").alias("n_i"))
    hits = hits.join(theirs, ["fp", "gram"])
    hits = hits.withColumns({"l": _same("before", "before_i"), "r": _same("after", "after_i"), "short": (F.size("before_i") == 0) & (F.size("after_i") == 0)})
    hits = hits.where("if(short, n = n_i, l + n + r >= " + str(WINDOW) + ")")
    spans = hits.select("_row", F.when(F.col("short"), F.col("pos")).otherwise(F.col("pos") - F.col("l")).alias("start"), F.when(F.col("short"), F.col("pos") + F.col("n")).otherwise(F.col("pos") + F.col("n") + F.col("r")).alias("end"), "items")
    # a document's own lists: no longer than its words and the items
    per = spans.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.flatten(F.collect_set("items")).alias("ids"))
    merged = F.expr("""aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (acc, s) ->
        if(size(acc) > 0 and s.start <= acc[size(acc) - 1].end,
           concat(slice(acc, 1, size(acc) - 1), array(struct(acc[size(acc) - 1].start as start, greatest(acc[size(acc) - 1].end, s.end) as end))),
           concat(acc, array(s))))""")
    per = per.select("_row", merged.alias("spans"), F.array_sort(F.transform(F.array_distinct("ids"), lambda x: x.cast("string"))).alias("item_ids"))
    out = rows.select("_row", "key", "n_words").join(per, "_row", "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return out.select(
        F.col("key").alias(key), "n_words",
        F.coalesce(F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)"), F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"),
    )
