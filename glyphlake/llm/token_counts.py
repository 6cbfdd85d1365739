"""Operator 7: token counts by source, language and tokenizer version, kept by signed deltas.

A batch of inserts, deletes and revised counts becomes signed sums per key: rows before a change count
-1, rows after it +1, and what stays cancels out. Its sums are written to a folder of their own, and a marker with the
batch's id commits them by one rename; folders without a marker are as if they weren't there, so a crash at any point
leaves either all of a batch or nothing. Totals are the sums over the committed batches. An id that is known changes
nothing when its content comes again, and is refused with other content.

Nulls in a key are a key of their own, a null text has no tokens, very long texts are counted whole, repeated rows
count each time, an empty batch commits no rows, an empty ledger has no totals, and columns besides the named ones are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.bpe import production, worker_encoder
from glyphlake.llm.common import discard, documents, file_system, materialise, shared_dir

KEYS = ["source", "lang", "tokenizer"]
BPE, WORDS = "byte_bpe_50k", "space_words_v1"


def count_tokens(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens: a row per document and tokenizer version."""
    shared = docs.sparkSession.sparkContext.broadcast(production(ranks_path))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for b in batches:
            texts = b.column(3).to_pylist()
            for version, counts in ((BPE, [len(encoder.encode(t)) for t in texts]), (WORDS, [len((t or "").encode("utf-8", "surrogatepass").split()) for t in texts])):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([version] * len(texts), pa.string()), pa.array(counts, pa.int64())], ["doc_id", *KEYS, "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def deltas(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed sums per key that lead from one state of (doc_id, key, n_tokens) rows to another.

    Rows on both sides cancel out in the sums, so no join is needed: a revised count is its removal and its insertion.
    """
    sides = [x.select(*KEYS, F.lit(sign).alias("sign"), "n_tokens") for x, sign in ((before, -1), (after, 1)) if x is not None]
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return both.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))


class TokenLedger:
    """Committed batches of deltas in a folder that all machines share. One writer at a time."""

    SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs, self.at = file_system(spark, path)

    def _marker(self, batch_id: str):
        return self.at(f"{self.path}/commits/{batch_id}")

    def _content(self, marker) -> tuple[str, str]:
        """Folder and digest that a marker names."""
        lines = self.fs.open(marker)
        try:
            return tuple(bytes(lines.readAllBytes()).decode().split("\n"))
        finally:
            lines.close()

    def _digest(self, changes: DataFrame) -> str:
        """The same for the same rows in any order; a key has one row."""
        n, total = changes.agg(F.count("*"), F.sum(F.xxhash64(*KEYS, "n_docs", "n_tokens").cast("decimal(38,0)"))).first()
        return f"{n}:{total or 0}"

    def commit(self, batch_id: str, changes: DataFrame) -> None:
        if not re.fullmatch(r"[\w.-]+", batch_id) or batch_id.startswith("."):
            raise ValueError("a batch id has letters, digits, dots and dashes")
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        changes.select(*KEYS, "n_docs", "n_tokens").write.parquet(folder)
        digest, marker = self._digest(self._read([folder])), self._marker(batch_id)
        if self.fs.exists(marker):
            self.fs.delete(self.at(folder), True)
            if self._content(marker)[1] != digest:
                raise ValueError(f"batch {batch_id} is committed with other content")
            return
        draft = self.at(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(f"{folder}\n{digest}".encode()))
        out.close()
        self.fs.mkdirs(self.at(f"{self.path}/commits"))
        if not self.fs.rename(draft, marker):
            raise OSError(f"batch {batch_id} could not be committed")

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], self.SCHEMA)

    def totals(self) -> DataFrame:
        known = self.at(f"{self.path}/commits")
        markers = self.fs.listStatus(known) if self.fs.exists(known) else []
        rows = self._read([self._content(m.getPath())[0] for m in markers])
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the whole table after a life of changes that end where the table stands.

    All documents are loaded with estimated counts, which are then revised to counted ones; those with an id divisible by 20 are deleted and put back,
    and the last batch is committed twice. The totals must be those of a recount.
    """
    counts = materialise(count_tokens(documents(spark, sf_dir)))
    estimate = counts.withColumn("n_tokens", F.floor(F.col("n_tokens") / 100).cast("long") * 100)
    some = counts.where("doc_id % 20 = 0")
    ledger = TokenLedger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.commit("1-load", deltas(None, estimate))
    ledger.commit("2-revise", deltas(estimate, counts))
    ledger.commit("3-delete", deltas(some, None))
    for _ in range(2):
        ledger.commit("4-restore", deltas(None, some))
    discard(counts)
    return ledger.totals()
