"""Reading tables so that all cores work on them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """df in as many partitions as there are cores, if its files give fewer (a file of one row group is one task); else as it is, without a shuffle.

    rows: in as many as keep a partition at this many rows on average, too; for narrow rows that become large ones, so that no task is long.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        parts = max(parts, -(-df.count() // rows))
    return df.repartition(parts, key) if df.rdd.getNumPartitions() < parts else df
