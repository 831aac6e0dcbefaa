"""URL filters with sorted digest arrays.

Rules are (host, path, verdict). Their strings host + path are hashed to 64 bits and dealt to shards by hash; a shard is an
array of sorted hashes with the strings behind it. URLs give the strings that could be a rule (each suffix of the host at
a dot, with each prefix of the path as long as some rule's path); the distinct ones are dealt to the same shards, where the
array is mapped from a file of the task's own (every task that has some of the shard's candidates gets a copy of it), probed by vectorised binary search, and each hit is confirmed by its full
string, so that equal hashes cannot mislead.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm import common as C

#: Rules in a shard, and candidates that one task probes it with, on average.
SHARD_RULES, SHARD_PROBES = 500_000, 1_000_000


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _probe(keys, rules: pa.Table, probes: pa.Table) -> pa.Table:
    """The candidates that are rules."""
    none = pa.table({"cand": pa.array([], pa.string()), "verdict": pa.array([], pa.string()), "host_chars": pa.array([], pa.int32())})
    if not rules.num_rows or not probes.num_rows:
        return none
    rules = rules.take(pc.sort_indices(rules, sort_keys=[("h", "ascending"), ("rule", "ascending")]))
    fd, name = tempfile.mkstemp(suffix=".digests")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(rules.column("h").to_numpy().astype("<i8").tobytes())
        digests = np.memmap(name, "<i8", "r")
        want = probes.column("h").to_numpy()
        low, high = np.searchsorted(digests, want, "left"), np.searchsorted(digests, want, "right")
        # the strings of equal hashes stand side by side; nearly always there is one
        found_p, found_r = [], []
        while (live := np.flatnonzero(low < high)).size:
            found_p.append(live)
            found_r.append(low[live])
            low[live] += 1
        del digests
    finally:
        os.unlink(name)
    if not found_p:
        return none
    p, r = probes.take(np.concatenate(found_p)), rules.take(np.concatenate(found_r))
    same = pc.and_(pc.equal(p.column("cand"), r.column("rule")), pc.equal(p.column("host_chars"), r.column("host_chars")))
    return pa.table({"cand": p.column("cand"), "verdict": r.column("verdict"), "host_chars": p.column("host_chars")}).filter(same)


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Per row of pages: key, host, path, rule (host + path of the longest rule that fits, else null), verdict.

    rules: host, path, verdict ("allow" or "block"). A rule fits its host and all subdomains where the path starts with the
    rule's. Longest: by the length of host and path together, then of the host; a rule given twice blocks if either does. No rule:
    `default`. Null URLs and those without :// have empty host and path. Repeated rows and null keys are judged row by row, URLs of any length whole;
    either table may be empty. Rules with a null part never fit. Other columns of either table are ignored, whatever their names.
    """
    spark = pages.sparkSession
    kind = pages.schema[key].dataType.simpleString()
    rules = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    n = rules.count()
    shards = n // SHARD_RULES + 1
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # a few dozen numbers at most
    hashed = lambda c: F.xxhash64(c)
    shard = F.pmod(F.col("h"), F.lit(shards)).cast("int").alias("shard")
    index = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), "verdict").withColumn("h", hashed(F.col("rule"))).withColumn("shard", shard)
    rows = pages.select(F.col(key).alias("key"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    cut = F.lit(lengths).cast("array<int>") if lengths else F.expr("cast(array() as array<int>)")
    # host suffixes that start at the host's beginning or after a dot, with path prefixes of the lengths that rules have
    rows = rows.withColumn("prefixes", F.transform(F.filter(cut, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)))
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    distinct = rows.select("host", F.explode("prefixes").alias("prefix")).distinct()
    pairs = distinct.select("host", "prefix", F.explode(suffixes).alias("suffix"))
    probes = pairs.select(F.concat("suffix", "prefix").alias("cand"), F.length("suffix").alias("host_chars")).distinct().withColumn("h", hashed(F.col("cand"))).withColumn("shard", shard)
    probes = C.written(probes, "probes")
    # a shard's candidates are dealt to tasks of bounded size
    parts = probes.count() // (shards * SHARD_PROBES) + 1
    probes = probes.withColumn("part", F.pmod(F.xxhash64("cand", "host_chars"), F.lit(parts)))
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    hits = probes.groupBy("shard", "part").cogroup(index.groupBy("shard", "part")).applyInArrow(lambda k, p, r: _probe(k, r, p), "cand string, verdict string, host_chars int")
    best = F.max(F.struct(F.length("cand").alias("n"), F.col("host_chars"), F.col("cand"), F.col("verdict"))).alias("best")
    judged = pairs.select("host", "prefix", F.concat("suffix", "prefix").alias("cand"), F.length("suffix").alias("host_chars")).join(hits, ["cand", "host_chars"]).groupBy("host", "prefix").agg(best)
    # a row's prefixes are few: the longest rule over them
    per = rows.select("host", "path", "prefixes").distinct().select("host", "path", F.explode("prefixes").alias("prefix")).join(judged, ["host", "prefix"]).groupBy("host", "path").agg(F.max("best").alias("best"))
    out = rows.join(per, ["host", "path"], "left")
    return out.select(F.col("key").cast(kind).alias(key), "host", "path", F.col("best.cand").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
