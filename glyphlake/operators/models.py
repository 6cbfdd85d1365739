"""Generators and editors of the lexical and the alignment model. Symbol 0 is epsilon, 1 is silence; costs are -ln p."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lexical(spark: SparkSession, n_src: int, n_tgt: int, restarts: int = 1) -> DataFrame:
    """(restart, src, tgt, p): the first restart is uniform over the sources, the others pseudo-random from a hash of (restart, tgt, src)."""
    rows = spark.range(1, restarts + 1).select(F.col("id").cast("int").alias("restart"))
    rows = rows.crossJoin(spark.range(2, n_tgt + 1).select(F.col("id").cast("int").alias("tgt"))).crossJoin(spark.range(2, n_src).select(F.col("id").cast("int").alias("src")))
    draw = (F.conv(F.substring(F.md5(F.concat_ws("/", "restart", "tgt", "src")), 1, 8), 16, 10).cast("double") + 1) / 4294967296.0
    raw = rows.withColumn("u", F.when(F.col("restart") == 1, F.lit(1.0)).otherwise(draw))
    return raw.select("restart", "src", "tgt", (F.col("u") / F.sum("u").over(Window.partitionBy("restart", "tgt"))).alias("p"))


def alignment(n_tgt: int, most_ins: int = 2, most_del: int = 2, p_ins: float = 0.1, p_del: float = 0.1) -> list[tuple[int, int, str, float]]:
    """Arcs (from, to, kind, p) of the alignment states; kinds: start, match, insert, delete, silence (read or inserted).

    State 0 starts, 1 follows a silence, 2 a match; then a state for each insertion in a row and each deletion in a row.
    """
    ins = [3 + k for k in range(most_ins)]
    dels = [3 + most_ins + k for k in range(most_del)]
    rest = {1: 1 - p_ins - p_del, 2: 1 - p_ins - p_del} | {s: 1 - p_ins for s in ins[:-1]} | {s: 1 - p_del for s in dels[:-1]} | {s: 1.0 for s in (*ins[-1:], *dels[-1:])}
    arcs = [(0, 1, "start", 1.0), (0, 1, "read_silence", 1.0)]
    arcs += [(s, 2, "match", p) for s, p in sorted(rest.items())]
    arcs += [(s, 1, kind, 1.0) for s in sorted(rest) if s != 1 for kind in ("read_silence", "insert_silence")]
    for chain, kind, p in ((ins, "insert", p_ins), (dels, "delete", p_del)):
        arcs += [(a, b, kind, p) for a, b in zip([2, *chain], chain)]
    return arcs


def alignment_frame(spark: SparkSession, n_tgt: int, **options) -> DataFrame:
    rows = [(a, b, k, -math.log(p) + 0.0) for a, b, k, p in alignment(n_tgt, **options)]
    return spark.createDataFrame(rows, "src int, dst int, kind string, cost double")


def prune_top(lex: DataFrame, k: int, deletion: int) -> DataFrame:
    """Entries among the ``k`` best (ties included) of their source or of their target, and all deletions; renormalised by target."""
    rank = lambda by: F.rank().over(Window.partitionBy(by).orderBy(F.desc("p")))
    kept = lex.withColumns({"_s": rank("src"), "_t": rank("tgt")}).where((F.col("_s") <= k) | (F.col("_t") <= k) | (F.col("tgt") == deletion)).drop("_s", "_t")
    return kept.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("tgt")))


def smooth(lex: DataFrame, n_src: int, n_tgt: int, alpha: float = 0.9) -> DataFrame:
    """Interpolation with a uniform floor over all (src, tgt), deletions included; the floor divides by one more than the sources, as documented."""
    spark = lex.sparkSession
    every = spark.range(2, n_src).select(F.col("id").cast("int").alias("src")).crossJoin(spark.range(2, n_tgt + 1).select(F.col("id").cast("int").alias("tgt")))
    return every.join(lex.select("src", "tgt", "p"), ["src", "tgt"], "left").select("src", "tgt", (F.lit((1 - alpha) / (n_src - 1)) + alpha * F.coalesce("p", F.lit(0.0))).alias("p"))


def logsumexp(rows: DataFrame, key: list[str], cost: str) -> DataFrame:
    """(key, total): -ln of the sum of exp(-cost) of each key. The smallest cost is taken out first, so nothing underflows; both passes are plain aggregates."""
    low = rows.groupBy(*key).agg(F.min(cost).alias("_low"))
    return rows.join(low, key).groupBy(*key).agg((F.min("_low") - F.ln(F.sum(F.exp(F.col("_low") - F.col(cost))))).alias("total"))
