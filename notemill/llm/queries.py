"""The operators' queries over the whole tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm import bpe, common, decontaminate, exact_dedup, hilbert, lines, merkle, neighbours, quality, repair, secrets, simhash, token_files, urls


def tokenizer(name: str) -> str:
    """The file's place: below NOTEMILL_TOKENIZERS, else where the public tokenizers are installed."""
    if root := os.environ.get("NOTEMILL_TOKENIZERS"):
        return f"{root}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(common.table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), digests=True)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(common.table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(common.table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")
    joined: Column = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s.kind.isin(*secrets.KINDS[: secrets.BASE])), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(common.table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed (runs), n_removed_lines, text_sha256 of what stays."""
    done = lines.dedup_lines(common.table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), F.expr("aggregate(removed, 0L, (a, r) -> a + r.high - r.low)").alias("n_removed_lines"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op7_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.hilbert_shards(common.table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "place")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(common.table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark, "tokens")
    token_files.write_tokens(common.table(spark, sf_dir, "documents"), folder, tokenizer("word_bpe_49k.json"), 2)
    return token_files.read_tokens(spark, folder)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, good_prob, keep."""
    judged = quality.classify(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return judged.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("good_prob", 6).alias("good_prob"), "keep")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search (factor 1): on vectors without clusters a larger one saves little before it loses neighbours."""
    return neighbours.nearest(common.table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(common.table(spark, sf_dir, "documents"), tampered=lower, changed=changed).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(common.table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_decontaminate, op3_exact_dedup, op4_secrets, op5_urls, op6_line_dedup, op7_hilbert, op8_simhash, op9_token_files, op10_quality, op11_neighbours, op12_merkle, op13_repair)}
