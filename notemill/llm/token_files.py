"""Token ids as Parquet list columns.

Texts are dealt to ranges of the key, sorted, encoded and written by Spark's Parquet writer: one file a range, a list column of
32-bit ids, dictionary- or delta-encoded, with chosen row-group and page sizes; the writer adds page indexes. A reader that wants
metadata reads no ids, and one that wants a key range skips row groups and pages.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemill.llm import common as C
from notemill.llm.bpe import byte_alphabet

#: Words that a worker remembers at most, and the longest such word.
CACHE_WORDS, CACHE_CHARS = 800_000, 48
#: White space that the tokenizer knows; str.split also cuts at 1C to 1F.
_CONTROL = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Marks that the tokenizer always cuts off from letters.
_MARKS = ".,;:!?%$&*#|"


class WordCache(dict):
    """A word's ids as little-endian 32-bit numbers, for a tokenizer whose normalizer (NFC, white space, lower case) and
    pre-tokenizer never look past white space: each word is encoded when it first comes up.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.alphabet = {b: ord(c) for c, b in byte_alphabet().items()}

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(_MARKS)
        if letters.isalpha() and letters == letters.lower() and is_normalized("NFC", letters):
            # lower-case letters pass the normalizer and the pre-tokenizer as they are
            if len(letters) < len(word):
                ids = self[letters] + self[word[len(letters) :]]
            else:
                ids = np.array([t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))], "<i4").tobytes()
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<i4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "<|" not in text and "Σ" not in text and (text.isascii() or is_normalized("NFC", text)):
            low = text.lower()
            text = low if low.isascii() or is_normalized("NFC", low) else text
        words = _SPACE.split(text) if _CONTROL.search(text) else text.split()
        return b"".join(map(self.__getitem__, words))


@lru_cache(2)
def load(path: str) -> WordCache:
    return WordCache(path)


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text", encoding: str = "dictionary", row_group_mb: int = 32, page_rows: int = 1_000) -> None:
    """Writes key, n_tokens, ids to `folder`, in ascending order of key (nulls first) over all files in order of their names.

    path: a tokenizers file, present on every executor, whose words end at white space. encoding: "dictionary" or "delta". Each row ends with
    end_id; null and empty texts have that id only. Rows that share a key are in order of their texts; repeated rows are all written.
    """
    kind, end = docs.schema[key].dataType.simpleString(), np.array([end_id], "<i4").tobytes()

    def run(batches):
        words = load(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids = [words.encode(t) + end if t else end for t in part.column(1).to_pylist()]
                n = np.array([len(x) >> 2 for x in ids], np.int64)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))], ["key", "n_tokens", "ids"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    out = ordered.mapInArrow(run, f"key {kind}, n_tokens bigint, ids array<int>").withColumnRenamed("key", key)
    writer = out.write.option("parquet.block.size", row_group_mb << 20).option("parquet.page.row.count.limit", page_rows).option("compression", "zstd")
    writer = writer.option("parquet.enable.dictionary", str(encoding == "dictionary").lower()).option("parquet.writer.version", "v2" if encoding == "delta" else "v1")
    writer.mode("overwrite").parquet(folder)


def _sums(batches):
    for batch in batches:
        ids = batch.column(3)
        flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["file", "at", "key", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """From the files: key, start (ids of all rows before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers)."""
    rows = spark.read.parquet(folder)
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), F.col(key).alias("key"), "ids")
    rows = C.written(rows.mapInArrow(_sums, f"file string, at bigint, key {kind}, n_tokens bigint, ids_crc32 bigint"), "sums")
    # one row a file, then rows within their file
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("bigint")
    files = files.select("file", (F.sum("n").over(Window.orderBy(number, "file")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("at")) - F.col("n_tokens")
    return rows.withColumn("within", within).join(files, "file").select(F.col("key").alias(key), (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
