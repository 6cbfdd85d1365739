"""Orders and assignments of rows to jobs."""

from __future__ import annotations

import heapq
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordinals(df: DataFrame, key: str, step: int = 1024) -> DataFrame:
    """``df`` with ``ordinal``, its rows' numbers from 0 in the order of the integer ``key``, without a window over one partition: counts of ranges of keys come first."""
    ranged = df.withColumn("_range", F.floor(F.col(key) / step))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("_range") / 4096))
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_bn"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_bn").over(before(Window.partitionBy(F.lit(0)).orderBy("_block"))), F.lit(0)).alias("_b"))
    starts = counts.join(blocks, "_block").select("_range", (F.col("_b") + F.coalesce(F.sum("_n").over(before(Window.partitionBy("_block").orderBy("_range"))), F.lit(0))).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranged.join(starts, "_range").withColumn("ordinal", F.col("_start") + inside - 1).select(*df.columns, "ordinal")


def contiguous_shards(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` with ``shard``: ``n`` runs of rows in the order of ``key`` whose sizes differ by one at most."""
    total = df.agg(F.count("*").alias("_total"))
    rows = ordinals(df, key).crossJoin(F.broadcast(total))  # one row
    return rows.withColumn("shard", F.floor(F.col("ordinal") * n / F.col("_total")).cast("int")).select(*df.columns, "shard")


def least_loaded(df: DataFrame, key: list[str], cost: str, jobs: int, most: int = 1_000_000) -> DataFrame:
    """(key, job): longest first (ties by key), each to the job with the least so far (ties to the smaller number).

    Each choice needs all before it, so the driver takes the rows one by one. They are the utterances of a training budget; more than
    ``most`` raise an error, and Spark's own scheduling balances tasks without this.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError("too many rows for a greedy assignment; repartition them instead")
    heap = [(0, j) for j in range(jobs)]
    out = []
    for r in df.orderBy(F.desc(cost), *key).select(*key, cost).toLocalIterator():
        load, j = heap[0]
        heapq.heapreplace(heap, (load + r[cost], j))
        out.append((*(r[k] for k in key), j))
    kinds = dict(df.dtypes)
    return df.sparkSession.createDataFrame(out, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", job int").repartition(max(1, ceil(len(out) / 100_000)))
