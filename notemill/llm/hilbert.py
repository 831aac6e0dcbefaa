"""Shards along a Hilbert curve, with DataFrame operations only.

Several metadata columns are quantised to a few bits each; a cell of that grid has a place on the Hilbert curve, and cells that
are near on the curve are near in every dimension. Rows are ranked by it and cut into runs of equal length, so that each file covers a
small box and a filter on any of the dimensions skips most files.

The rank needs no global sort: counts of (curve place, slice of a hash) are summed up first, and rows are then numbered
within a slice only, so that a place with a third of all rows is numbered by as many tasks as there are slices.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemill.llm import common as C

BITS = 4
#: Rows that one slice of a place should have at most.
SLICE_ROWS = 100_000


def curve(spark: SparkSession, dims: int, bits: int = BITS) -> DataFrame:
    """(cell, place) for each of the 2^(dims * bits) cells; a cell packs its coordinates, the first in the lowest bits."""
    if dims * bits > 16:
        raise ValueError("the grid is limited to 2^16 cells")
    side = F.lit((1 << bits) - 1)
    cells = spark.range(1 << (dims * bits)).withColumnRenamed("id", "cell")
    axes = F.array(*[F.shiftright("cell", bits * d).cast("int").bitwiseAND(side) for d in range(dims)])
    zero = F.lit(0)

    def turn(x: Column, step: Column) -> Column:
        # undo, from the coarsest bit on, the reflections and exchanges of axes that the curve makes in each quadrant
        q, i = F.element_at(step, 1), F.element_at(step, 2)
        xi = F.get(x, i)
        hit = xi.bitwiseAND(q) != 0
        t = F.when(hit, q - 1).otherwise(F.get(x, zero).bitwiseXOR(xi).bitwiseAND(q - 1))
        return F.transform(x, lambda v, k: v.bitwiseXOR(F.when(k == 0, t).otherwise(zero)).bitwiseXOR(F.when((k == i) & ~hit, t).otherwise(zero)))

    steps = F.array(*[F.array(F.lit(1 << b), F.lit(i)) for b in range(bits - 1, 0, -1) for i in range(dims)])
    x = cells.select("cell", F.aggregate(steps, axes, turn).alias("x"))
    gray = F.aggregate(F.sequence(zero, F.lit(dims - 1)), F.expr("cast(array() as array<int>)"), lambda acc, i: F.concat(acc, F.array(F.get(F.col("x"), i).bitwiseXOR(F.coalesce(F.get(acc, i - 1), zero)))))
    x = x.select("cell", gray.alias("x"))
    last = F.get("x", F.lit(dims - 1))
    fix = F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), zero, lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)) if bits > 1 else zero
    x = x.withColumn("fix", fix).select("cell", F.transform("x", lambda v: v.bitwiseXOR(F.col("fix"))).alias("x"))
    place = F.lit(0)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = F.shiftleft(place, 1).bitwiseOR(F.shiftright(F.get("x", F.lit(i)), b).bitwiseAND(F.lit(1)))
    return x.select("cell", place.alias("place"))


def steps_of(rows: DataFrame, columns: list[str], bits: int = BITS) -> list[Column]:
    """For each column its value's step of 2^bits, in order of the values and about equally full; null comes first.

    The steps are cut by all rows: step i begins with the value at place i / 2^bits of the column in order, so 2^bits - 1 values of each column come to the driver. They shape
    the boxes only, not how many rows a shard gets.
    """
    return [sum((F.when(F.col(c) >= F.lit(v), 1).otherwise(0) for v in cuts(rows, c, bits)), F.lit(0)) for c in columns]


def cuts(rows: DataFrame, column: str, bits: int = BITS) -> list:
    """The values at places floor(i * n / 2^bits), i from 1, of a column's n values in order, null left out. Values are counted, dealt to ranges and numbered within these; only a count for each range meets in one task."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranges = C.written(counts.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, "v").withColumn("range", F.spark_partition_id()), "hilbert_steps")
    sums = ranges.groupBy("range").agg(F.sum("n").alias("m"))
    sums = sums.select("range", (F.sum("m").over(Window.orderBy("range")) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy(F.lit(0))).alias("whole"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("range").orderBy("v"))
    placed = ranges.join(F.broadcast(sums), "range").select("v", "n", "whole", upto.alias("upto")).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit((1 << bits) - 1))))
    met = placed.where(f"i * whole div {1 << bits} >= upto - n and i * whole div {1 << bits} < upto").select("i", "v").collect()
    return [r.v for r in sorted(met, key=lambda r: r.i)]


def hilbert_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per row of docs: key, size (UTF-8 bytes + 1), text_crc32, place, shard, slot (from 0, without gaps in its shard).

    Shards' row counts are at most one apart. Grid: `dims` (those that docs has, as strings) and the size, each in steps in order of its values, so that a shard covers a
    short range of each. Null comes before all values, a null text counts as empty; very long texts as any other; repeated rows get slots of their own,
    ties are in order of hash, key, size and crc32. An empty table has no rows. Columns of other names are ignored.
    """
    dims = tuple(d for d in dims if d in docs.columns)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(whole) + 1).cast("bigint").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), *[F.col(d).cast("string").alias(f"d{i}") for i, d in enumerate(dims)])
    rows = C.written(rows.withColumn("x", F.xxhash64("key", "text_crc32", "size")), "hilbert")
    n = rows.count()
    axes = steps_of(rows, [*[f"d{i}" for i in range(len(dims))], "size"])
    cell = F.lit(0).cast("bigint")
    for i, a in enumerate(axes):
        cell = cell + F.shiftleft(a, BITS * i)
    rows = rows.withColumn("cell", cell)
    slices = min(16, max(4, math.ceil(math.log2(max(n, 1) / SLICE_ROWS + 1))))
    # 2^(dims * BITS) cells: a bound that does not depend on the rows
    rows = rows.join(F.broadcast(curve(docs.sparkSession, len(axes))), "cell").withColumn("slice", F.shiftrightunsigned("x", 64 - slices).cast("int"))
    counts = rows.groupBy("place", "slice").agg(F.count("*").alias("n"))
    totals = counts.groupBy("place").agg(F.sum("n").alias("n"))
    before = totals.select("place", (F.sum("n").over(Window.orderBy("place")) - F.col("n")).alias("before"))
    upto = counts.select("place", "slice", (F.sum("n").over(Window.partitionBy("place").orderBy("slice")) - F.col("n")).alias("within"))
    offsets = upto.join(before, "place").select("place", "slice", (F.col("before") + F.col("within")).alias("offset"))
    order = Window.partitionBy("place", "slice").orderBy("x", F.col("key").asc_nulls_last(), "size", "text_crc32")
    ranked = rows.withColumn("i", F.row_number().over(order)).join(offsets, ["place", "slice"]).withColumn("rank", F.col("offset") + F.col("i") - 1)
    shard = F.expr(f"cast((rank * {shards}) div {max(n, 1)} as int)")
    return ranked.withColumn("shard", shard).select(F.col("key").alias(key), "size", "text_crc32", "place", "shard", F.expr(f"rank - (shard * {n}L + {shards - 1}) div {shards}").alias("slot"))


def write_shards(placed: DataFrame, path: str, shards: int = 8) -> None:
    """Writes rows that carry shard and slot as one folder a shard, in order of slot."""
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
