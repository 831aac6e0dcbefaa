"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last WINDOW lines with words chooses where a chunk ends, so boundaries depend on the lines
around them alone and move with them. A chunk reaches from one boundary's line to the next one's, both included: neighbouring
chunks share a line, and every two lines that follow each other (with what blank lines stand between) lie in exactly one chunk.
A chunk that comes again anywhere is a duplicate of its first occurrence (smallest key, then place) once their bytes are found equal.

A repeated passage need not begin or end at a boundary. So each distinct chunk, in its first occurrence only, is opened to its
pairs of neighbouring lines, and pairs that come again extend what is repeated line by line, again after their bytes. A passage is
a run of repeated chunks and pairs: it goes as a whole from every later place, whatever stands around it and however short it is.
Copies of a chunk are settled by one hash each; only first occurrences cost a hash for each pair. Single lines and runs under a number of
words stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm import common as C

#: A run is removed only if it has MIN_LINES lines with words and MIN_WORDS words.
MIN_LINES, MIN_WORDS = 2, 10
#: Lines that the rolling hash covers, its base, and one in how many of its values is a boundary.
WINDOW, BASE, SPACING = 2, 0x9E3779B97F4A7C15, 8


_PAIRS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("h", pa.int64())]))
_CHUNKS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("h", pa.int64()), ("pairs", _PAIRS)]))
CHUNKS = "array<struct<low:int,high:int,h:bigint,pairs:array<struct<low:int,high:int,h:bigint>>>>"


def boundaries(hashes: list[int]) -> list[int]:
    """Places in a row's line hashes at which chunks meet: its first and last line, and those where the rolling hash says so."""
    rolled, out, gone = 0, [0], pow(BASE, WINDOW, 1 << 64)
    for i, h in enumerate(hashes):
        rolled = (rolled * BASE + h - (hashes[i - WINDOW] * gone if i >= WINDOW else 0)) % (1 << 64)
        if 0 < i < len(hashes) - 1 and i >= WINDOW - 1 and (rolled >> 32) % SPACING == 0:
            out.append(i)
    return [*out, len(hashes) - 1]


def _chunked(bits: int):
    def digest(lines: list[bytes]) -> int:
        return (xxhash.xxh64_intdigest(b"\n".join(lines)) >> (64 - bits)) - (1 << 63)

    def chunked(batches):
        for batch in batches:
            found, counts = [], []
            for t in batch.column(2).cast(pa.binary()).to_pylist():
                lines = t.split(b"\n") if t else []
                solid = [i for i, line in enumerate(lines) if line.strip()]
                out = []
                if len(solid) > 1:
                    ends = boundaries([xxhash.xxh64_intdigest(lines[i]) for i in solid])
                    for a, b in zip(ends, ends[1:]):
                        pairs = [{"low": i, "high": j + 1, "h": digest(lines[i : j + 1])} for i, j in zip(solid[a:b], solid[a + 1 : b + 1])]
                        low, high = solid[a], solid[b] + 1
                        out.append({"low": low, "high": high, "h": digest(lines[low:high]), "pairs": pairs})
                found.append(out)
                counts.append(len(lines))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(found, _CHUNKS)], ["_row", "key", "text", "n_lines", "chunks"])

    return chunked


def _runs(batches):
    """Merges a row's repeated chunks and pairs to runs of lines [low, high) and takes these out; lines of a first occurrence stay."""
    for batch in batches:
        removed, kept = [], []
        for t, marks in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
            lines, out = t.split(b"\n"), []
            gone = np.zeros(len(lines) + 1, bool)
            for stays in (False, True):
                for m in marks or []:
                    if m["stays"] == stays and not (stays and m["chunk"]):
                        gone[m["low"] : m["high"]] = not stays
            edges = np.flatnonzero(gone[:-1] != np.concatenate([[False], gone[:-1]])[:-1]).tolist() if marks else []
            for low, high in zip(edges[::2], [*edges[1::2], len(lines)]):
                solid = [n for line in lines[low:high] if (n := len(line.split()))]
                if len(solid) >= MIN_LINES and sum(solid) >= MIN_WORDS:
                    out.append({"place": low, "low": low, "high": high})
            for r in reversed(out):
                del lines[r["low"] : r["high"]]
            removed.append(out)
            kept.append(b"\n".join(lines))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, _REMOVED), pa.array(kept, pa.binary()).cast(pa.string())], ["key", "n_lines", "removed", "text"])


_REMOVED = pa.list_(pa.struct([("place", pa.int32()), ("low", pa.int32()), ("high", pa.int32())]))


def _marks(chunks: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """_row, low, high, h, chunk, stays: chunks, and pairs of first occurrences of chunks, whose hash comes again; stays is its first occurrence."""

    def again(df: DataFrame, weight, chunk: bool) -> DataFrame:
        first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "_row", "low")).alias("first")
        out = df.groupBy("h").agg(first, F.sum(weight).alias("n")).where("n > 1").select("h", F.col("first._row").alias("first_row"), F.col("first.low").alias("first_low"), "n")
        return out if clashes is None else out.join(clashes.where(F.col("chunk") == chunk).select("h"), "h", "left_anti")

    first_here = (F.col("first_row") == F.col("_row")) & (F.col("first_low") == F.col("low"))
    repeats = C.written(again(chunks, F.lit(1), True), "repeats")
    settled = C.written(chunks.join(repeats, "h", "left").select("_row", "key", "low", "high", "h", "n", first_here.alias("stays"), F.when(first_here | F.col("n").isNull(), F.col("pairs")).alias("pairs")), "settled")
    pairs = settled.where("pairs is not null").select("_row", "key", F.coalesce("n", F.lit(1)).alias("w"), F.inline("pairs"))
    met = C.written(again(pairs, F.col("w"), False), "met")
    marks = lambda df, chunk: df.select("_row", "low", "high", "h", F.lit(chunk).alias("chunk"), "stays")
    return marks(settled.where("n is not null"), True).unionByName(marks(pairs.join(met, "h").withColumn("stays", first_here), False))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """Per row of docs: key, n_lines, removed (runs as place, low, high: lines [low, high) go), text (what stays).

    Lines are what stands between newlines. Chunks and pairs of lines are equal if their bytes are. The first occurrence stays: that of the smallest
    key (null keys last), of repeated rows the first read, in a row the first. Null and empty texts have no lines and stay empty. A text that is
    wholly repeated becomes empty. Other columns are ignored. bits: how much of a hash is used.
    """
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = C.with_row(source).select("_row", "key", "text")
    rows = C.written(rows.mapInArrow(_chunked(bits), f"_row bigint, key {kind}, text string, n_lines bigint, chunks {CHUNKS}"), "chunks")
    chunks = rows.select("_row", "key", F.inline("chunks"))
    body = F.expr("transform(marks, m -> struct(m.chunk as chunk, m.h as h, array_join(slice(split(text, '\\n', -1), m.low + 1, m.high - m.low), '\\n') as body))")
    clashes = None
    while True:
        per = C.written(_marks(chunks, clashes), "marks").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("low", "high", "h", "chunk", "stays"))).alias("marks"))
        texts = rows.select("_row", "key", "text", "n_lines").join(per, "_row", "left")
        # the bytes of all whose hash came again: of each hash the smallest and largest, worked out by tasks first
        ends = texts.where("marks is not null").select(F.inline(body)).groupBy("chunk", "h").agg(F.min("body").alias("a"), F.max("body").alias("b"))
        new = C.written(ends.where("a <> b").select("chunk", "h"), "clashes")
        if new.isEmpty():
            break
        # equal hashes of different lines: no such are known for 64 bits; a chunk is then opened to its pairs, a pair stays: nothing is removed unread
        clashes = new if clashes is None else clashes.unionByName(new)
    out = texts.select("key", "n_lines", "text", "marks").mapInArrow(_runs, f"key {kind}, n_lines bigint, removed array<struct<place:int,low:int,high:int>>, text string")
    return out.withColumnRenamed("key", key)
