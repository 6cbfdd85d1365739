"""Stages whose outputs stay on disk, so that a run goes on where the last one stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a stage's output was written to its end."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def run(spark: SparkSession, stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], folder: str, first: str | None = None) -> dict[str, DataFrame]:
    """Outputs by stage name. A stage gets those before it; what is written already is read, from stage ``first`` on all is made again."""
    done: dict[str, DataFrame] = {}
    again = False
    for name, make in stages:
        again = again or name == first
        path = f"{folder}/{name}"
        if again or not finished(spark, path):
            make(dict(done)).write.mode("overwrite").parquet(path)
            again = True
        done[name] = spark.read.parquet(path)
    return done
