"""Prefixes under a budget: rows in order until the sum of a measure reaches it, the crossing row included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_prefix(df: DataFrame, group: list[str], order: list[Column], measure: str, budget: float) -> DataFrame:
    """One budget for each group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(measure).over(w), F.lit(0))).where(F.col("_before") < budget).drop("_before")


def first_keys(df: DataFrame, key: str, measure: str, budget: float, keys: DataFrame | None = None) -> DataFrame:
    """The rows below a bound of the integer ``key`` whose measures fill the budget; all rows if they don't.

    ``keys``, if given, is a table that has all of the keys and is cheaper to look at than ``df``.

    The bound doubles until it does, so a small budget on a large table reads a small part of it (the filter
    reaches the scan), and never more than about three times what is needed.
    """
    low, high = (df if keys is None else keys).agg(F.min(key), F.max(key)).first()
    if low is None:
        return df
    width = 1024
    while low + width <= high:
        some = df.where(F.col(key) < low + width)
        if (some.agg(F.sum(measure)).first()[0] or 0) >= budget:
            return some
        width *= 4
    return df


def ordered_prefix(df: DataFrame, order: list[str], measure: str, budget: float) -> DataFrame:
    """One budget over all rows in the order of the columns ``order``, of any types, without a window over one partition.

    Rows are dealt by ranges of the whole order, so a value that many rows share is split too. Sums per range (one row
    for each partition) give the sum before it, and only ranges that begin within the budget are ordered inside.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).persist()  # read twice: for the sums and for the rows
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum(measure).alias("_sum"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before(Window.partitionBy(F.lit(0)).orderBy("_range"))), F.lit(0))).where(F.col("_start") < budget).select("_range", "_start")
    inside = before(Window.partitionBy("_range").orderBy(*order))
    rows = ranged.join(starts, "_range").withColumn("_before", F.col("_start") + F.coalesce(F.sum(measure).over(inside), F.lit(0)))
    return rows.where(F.col("_before") < budget).select(*df.columns)


def shortest_first(df: DataFrame, id_col: str, measure: str, budget: float) -> DataFrame:
    """The shortest rows whose measures fill the budget; ties by id."""
    return ordered_prefix(df, [measure, id_col], measure, budget)
