"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns
the columns of documents; the last adds the tokens. run() writes each stage's result to the shared folder and reads it again. Stages share
executors and their Python workers, so each bounds the bytes of the batches that these get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notemill.llm import bpe, common, decontaminate, exact_dedup, quality, queries, simhash


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier doesn't take for good. The labels are those of the whole table.

    Null and empty texts are judged by their shapes alone; repeated rows and keys and null keys one by one; columns of any name stay
    as they are; an empty table stays empty.
    """
    common.small_batches(spark)
    keys = common.Keyed(docs)
    key, text = keys.place("doc_id"), keys.place("text")
    labels = common.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", key)
    return keys.plain(quality.classify(keys.rows.drop("_key", "key", "text"), labels, key, text).where("keep"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the smallest doc_id, null last, of repeated rows one; null counts as empty. Columns of any name stay."""
    common.small_batches(spark)
    keys = common.Keyed(docs)
    return keys.without(exact_dedup.exact_dedup(keys.rows, key="_key").where("not kept"))


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (0.8 of their 5-word shingles): the one with the smallest doc_id, null last.

    Texts without words, null and empty ones too, are copies of each other. Of repeated rows one stays. Columns of any name stay.
    """
    common.small_batches(spark)
    keys = common.Keyed(docs)
    return keys.without(simhash.near_copies(keys))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item. Null and empty texts stay, repeated rows are judged one by one, columns of any name stay."""
    common.small_batches(spark)
    keys = common.Keyed(docs)
    found = decontaminate.decontaminate(keys.rows, common.table(spark, sf_dir, "benchmark"), key="_key")
    return keys.without(found.where("n_hit > 0"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Null and empty texts have no ids; every row is encoded. Workers that earlier stages used as well remember fewer pieces."""
    common.small_batches(spark)
    return bpe.bpe_encode(docs, queries.tokenizer("byte_bpe_50k.json"), digests=True, remember=125_000)


STAGES = [("quality_classifier", classified), ("exact_dedup", deduplicated), ("simhash_near_dedup", near_deduplicated), ("decontamination", decontaminated), ("bpe", tokenised)]

#: The stages are not expressible in SQL (fitted weights, connected components, BPE); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
