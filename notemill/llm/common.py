"""What the operators share: tables in the shared folder, row keys, and Arrow text buffers as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors must see; where that is unset, as in tests, and all runs on this machine, below a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.gettempdir() + "/notemill-shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """What written() writes inside is removed at the end, but for what the function that it gives (as written()) writes."""
    paths: list[str] = []
    _scratch.append(paths)

    def keep(df: DataFrame, tag: str) -> DataFrame:
        out = written(df, tag)
        paths.pop()
        return out

    try:
        yield keep
    finally:
        _scratch.remove(paths)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage is cut, and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that goes to a Python worker. Spark holds and Python reads a batch whole, for each running task.
BATCH_BYTES, BATCH_CONF = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of about BATCH_BYTES, not of 10,000 rows of any length. It stays set, as a stage's result is computed by whoever writes it."""
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """df with a number for each row. It holds only within one reading of df, so write what carries it before it is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: Bits of a sieve (as a power of two), and of each of its pieces: 4 KB of Spark's bitmaps.
SIEVE_BITS, PIECE_BITS = 25, 15


def sieved(df: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """df with _maybe: false for rows whose `on` is not in chosen for sure, true for all whose is and for few others.

    A bitmap of fixed size is broadcast, 2^SIEVE_BITS bits whatever the tables' sizes; with it, a join with chosen needs only shuffle the rows that may meet one.
    """
    bit = F.pmod(F.xxhash64(*on), F.lit(1 << SIEVE_BITS))
    piece, place = F.shiftright("_bit", PIECE_BITS), F.col("_bit").bitwiseAND(F.lit((1 << PIECE_BITS) - 1))
    bits = chosen.select(bit.alias("_bit")).select(piece.alias("_piece"), place.alias("_place")).repartition("_piece")
    bits = written(bits.groupBy("_piece").agg(F.bitmap_construct_agg("_place").alias("_bits")), "sieve")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.expr("shiftright(_byte, cast(_bit & 7 as int)) & 1") == 1, F.lit(False))
    met = df.withColumn("_bit", bit).withColumn("_piece", piece).join(F.broadcast(bits), "_piece", "left")
    return met.withColumn("_byte", byte).withColumn("_maybe", maybe).select(*df.columns, "_maybe")


class Keyed:
    """docs with names and keys of its own: `rows` has _key, key, text and every column of docs as c0, c1, ... (so no name of docs is in the way).

    _key orders rows by key, nulls last, and tells repeated rows apart by file and place. Rows that don't come straight
    from files are written first, so that the places are the same each time.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text"):
        self.columns = docs.columns
        plain = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(self.columns)]
        # the path as 16 bytes: equal names in different folders stay apart
        place = [F.unhex(F.md5(F.col("_metadata.file_path"))).alias("file"), F.col("_metadata.row_index").alias("at")]
        try:
            rows = docs.select(*plain, F.struct(*place).alias("place"))
        except AnalysisException:
            rows = written(docs.select(*plain), "rows").select("*", F.struct(*place).alias("place"))
        k, t = (F.col(f"c{self.columns.index(c)}") for c in (key, text))
        self.rows = rows.select(F.struct(k.isNull().alias("none"), k.alias("key"), "place.file", "place.at").alias("_key"), k.alias("key"), t.alias("text"), *[f"c{i}" for i in range(len(self.columns))])

    def place(self, name: str) -> str:
        """What a column of docs is called in rows."""
        return f"c{self.columns.index(name)}"

    def chosen(self, kept: DataFrame, how: str = "left_semi") -> DataFrame:
        """The rows of docs whose _key is in kept (or, for left_anti, is not: see without())."""
        if how == "left_anti":
            return self.without(kept)
        at = lambda df: df.withColumns({"_file": F.col("_key.file"), "_at": F.col("_key.at")})
        return self.plain(at(self.rows).join(at(kept.select("_key")).select("_file", "_at"), ["_file", "_at"], how))

    def without(self, gone: DataFrame) -> DataFrame:
        """The rows of docs whose _key is not in gone. Only rows that may be in it are shuffled."""
        at = lambda df: df.withColumns({"_file": F.col("_key.file"), "_at": F.col("_key.at")})
        gone = written(at(gone.select("_key")).select("_file", "_at"), "gone")
        rows = sieved(at(self.rows), gone, ["_file", "_at"])
        return self.plain(rows.where("not _maybe")).union(self.plain(rows.where("_maybe").join(gone, ["_file", "_at"], "left_anti")))

    def plain(self, rows: DataFrame) -> DataFrame:
        """rows with the columns of docs, under their names."""
        return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(self.columns)])


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, last row + 1, bytes, offsets) for runs of rows with about `limit` bytes of text, a longer text alone.

    Null counts as empty. offsets has one entry more than rows and starts at 0.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True
_SOLID = np.ones(256, bool)
_SOLID[9:14] = _SOLID[32] = False


class Words:
    """The words of a run of texts, A-Z lower-cased: start, end (bytes of .data), and .first (the first word of each text, and one more entry)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, solid: bool = False):
        self.data = _LOWER[data]
        inside = (_SOLID if solid else _ALNUM)[self.data]
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        before[edges] = False
        after[edges - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its bytes from prefix sums, then mixed."""
        power, inverse = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start])

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


_BASE = 0x9E3779B97F4A7C15
_tables: list = []


def _powers(n: int):
    if not _tables or len(_tables[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        _tables[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _tables


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n word hashes; runs over the end of a text are the caller's to leave out."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        total = total * np.uint64(_BASE) + words[j : len(words) - n + 1 + j]
    return mix(total)
