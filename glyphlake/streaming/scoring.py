"""Streaming extra: windowed counts with late data, and scores of arriving lines by a fixed language model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.operators.ngrams import backoff_score


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def score_batches(grams: DataFrame, tables: list[DataFrame], path: str):
    """A stream writer that appends scored (ctx, sym) rows batch by batch; a repeated batch replaces itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        backoff_score(batch, tables).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return grams.writeStream.foreachBatch(put)
