"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word in the white-space word rule.
SPACE = r"\x20\x09-\x0D"


#: Spark removes a query's shuffle files when it ends only if this is set.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. Only a local session, whose executor is this machine, may do without a named one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/shared-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut lineage: write to the shared folder, in a folder for each value of ``by``, and read back. The shuffle files of what led there go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its Path class."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf), jvm.org.apache.hadoop.fs.Path


def discard(*tables: DataFrame, **value: object) -> None:
    """Delete tables of ``materialise`` that nothing reads any more, or what they have of one value of the column they are kept by."""
    for t in tables:
        fs, path = file_system(t.sparkSession, t.scratch_path)
        fs.delete(path("/".join([t.scratch_path, *(f"{k}={v}" for k, v in value.items())])), True)


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression, so that lambdas see a variable and not a re-evaluated tree."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (vectorised)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16) if have is None else max(n, 2 * len(have))
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        _powers[name] = have = np.multiply.accumulate(out)
    return have[:n]


class SpanHash:
    """Hashes of any byte span of a buffer in O(1) each, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: bytes | np.ndarray):
        b = np.frombuffer(data, dtype=np.uint8) if isinstance(data, (bytes, bytearray)) else data
        n = len(b)
        self.n = n
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(BASE, n, "up") if n else np.zeros(0, np.uint64), out=self.sums[1:])
        self.down = _power(_INV, n + 1, "down")

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix64(raw ^ ((np.asarray(end) - np.asarray(start)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
