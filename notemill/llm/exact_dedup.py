"""Exact dedup with stateful streaming.

The digests of all rows are written to a table in the shared folder. A stream reads the files of that table that it has
not seen and keeps, by digest and without expiry, the smallest identifier, its content locator (the file the row came from) and
the count; the state lives in RocksDB on the executors' disks, with its change log in the checkpoint. A later batch of
rows written to the same folder finds the earlier state there.

Each digest that came up twice is a hit and its rows' full bytes are compared: as the smallest and the largest text of the digest,
which every task works out for its own rows first, so that no group of copies meets in one task. A digest whose texts
differ is taken apart by the texts themselves. Rows whose digest can't be among the hits, by a bitmap of fixed size, are not shuffled.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm import common as C

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # small states of many partitions: don't reserve megabytes of disk for each one's logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keep_state(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Runs the stream over what is new in folder/rows; returns the state: digest, best (identifier, locator, row), n."""
    schema = f"_row bigint, key {kind}, digest string, locator string"
    seen = spark.readStream.schema(schema).parquet(f"{folder}/rows")
    best = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "_row", "locator")).alias("best")
    state = seen.groupBy("digest").agg(best, F.count("*").alias("n"))

    shape = f"digest string, best struct<none:boolean,key:{kind},_row:bigint,locator:string>, n bigint"
    spark.createDataFrame([], shape).coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/batch=-1")

    def out(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    with _settings(spark, STATE):
        query = state.writeStream.outputMode("update").foreachBatch(out).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    # a digest is written again whenever its state changes: its identifier only gets smaller and its count larger
    told = spark.read.schema(shape).parquet(f"{folder}/state")
    return told.groupBy("digest").agg(F.min("best").alias("best"), F.max("n").alias("n"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """Per row of docs, dropped rows too: key, keep_id, group_size, kept, text_sha256, locator (of the row that stays).

    Texts are equal when they are after normalised(); null counts as empty. Of equal texts the row with the smallest key
    stays, null keys last, and of repeated rows with that key exactly one. An empty table gives no rows. digest: for
    tests; whatever it is, the result is that of comparing full texts.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    folder = C.shared_dir(spark, "dedup")
    rows = C.with_row(docs.select(F.col(key).alias("key"), normalised(F.col(text)).alias("_text")))
    rows.select("_row", "key", digest(F.col("_text")).alias("digest"), F.input_file_name().alias("locator")).write.parquet(f"{folder}/rows")
    table = spark.read.schema(f"_row bigint, key {kind}, digest string, locator string").parquet(f"{folder}/rows").select("_row", "key", "digest")
    state = C.written(keep_state(spark, folder, kind), "dedup-state")
    # full bytes on hits; a row that can't be one is not shuffled
    texts = docs.select(F.col(key).alias("key"), normalised(F.col(text)).alias("_text")).withColumn("digest", digest(F.col("_text")))
    again = state.where("n > 1").select("digest")
    texts = C.sieved(texts, again, ["digest"]).where("_maybe")
    ends = texts.join(again, "digest", "left_semi").groupBy("digest").agg(F.min("_text").alias("low"), F.max("_text").alias("high"))
    clash = C.written(ends.where("low <> high").select("digest"), "dedup-clash")
    out = table.join(state, "digest").select("_row", "key", F.col("best.key").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_row") == F.col("best._row")).alias("kept"), "digest", F.col("best.locator").alias("locator"))
    if not clash.isEmpty() or digest is not sha256:
        out = _apart(docs, key, text, digest, clash)
    return out.select(F.col("key").alias(key), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"), "locator")


def _apart(docs: DataFrame, key: str, text: str, digest, clash: DataFrame) -> DataFrame:
    """All rows with clashing digests told apart by their texts, and every digest the real one; rows are numbered and written anew, so that no two readings are mixed."""
    rows = C.with_row(docs.select(F.col(key).alias("key"), normalised(F.col(text)).alias("_text"), F.input_file_name().alias("locator"))).withColumn("_d", digest(F.col("_text")))
    rows = C.written(rows, "dedup-texts").join(clash.select(F.col("digest").alias("_d"), F.lit(True).alias("_odd")), "_d", "left")
    rows = rows.select("_row", "key", "locator", sha256(F.col("_text")).alias("digest"), "_d", F.when(F.col("_odd"), F.col("_text")).otherwise("").alias("_part"))
    group = rows.groupBy("_d", "_part").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "_row", "locator")).alias("best"), F.count("*").alias("n"))
    return rows.drop("locator").join(group, ["_d", "_part"]).select("key", F.col("best.key").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_row") == F.col("best._row")).alias("kept"), "digest", F.col("best.locator").alias("locator"))
