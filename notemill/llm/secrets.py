"""Secret scans with an incremental blob ledger.

A text's blob is its SHA-256. The ledger holds, for each blob and rule version, the spans found; only pairs that it does
not hold are scanned, each blob once however many rows or versions have it, and the findings are joined back to all rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm import common as C

#: The base kinds in their order, then those that this operator adds.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
KINDS = ("assign", "access", "hex", "pem", "jwt")
BASE = 3
RULES = "1"

SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) in order of start, then kind; code points, end exclusive."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        out += [(m.start(), 3, m.end()) for m in PEM.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), 4, m.end()) for m in JWT.finditer(text)]
    return sorted(out)


def _scan(batches):
    for batch in batches:
        spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW)], ["blob", "spans"])


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", ledger: str | None = None, rules: str = RULES) -> DataFrame:
    """Per row of docs: key, blob, spans (kind, start, end; by start, then kind).

    ledger: a folder that outlives the call; by default a new one in the shared folder. Calling again with the same folder and rules
    scans only blobs that are new; with other rules everything once more. Null counts as empty and has no spans; rows
    with null or repeated keys are reported one by one; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ledger = ledger or C.shared_dir(spark, "ledger")
    shape = f"blob string, rules string, spans {SPANS}"
    spark.createDataFrame([], shape).coalesce(1).write.mode("append").parquet(ledger)
    known = spark.read.schema(shape).parquet(ledger)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.sha2(whole.cast("binary"), 256).alias("blob"), whole.alias("text"))
    # one text of each blob; tasks drop their own copies first
    fresh = rows.groupBy("blob").agg(F.first("text").alias("text")).join(known.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    fresh.mapInArrow(_scan, f"blob string, spans {SPANS}").select("blob", F.lit(rules).alias("rules"), "spans").write.mode("append").parquet(ledger)
    found = spark.read.schema(shape).parquet(ledger).where((F.col("rules") == rules) & (F.size("spans") > 0)).dropDuplicates(["blob"])
    out = rows.select("key", "blob").join(found.select("blob", "spans"), "blob", "left")
    return out.select(F.col("key").alias(key), "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"))
