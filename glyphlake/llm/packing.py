"""Operator 9: harmonic packing of token sequences.

A document's ids (with an end id) are cut freely: first into full sequences, then the rest into
halves, quarters, eighths and sixteenths of the capacity, and what is left (under a sixteenth)
stays whole. Lengths fall into reciprocal-capacity classes: class k takes lengths up to
capacity / k, and a bin of class k takes exactly k pieces, so that every worker fills its own bins
with nothing but a counter for each class. The pieces in the unfilled bins at a worker's end, a
number bounded by the classes, are laid end to end and cut into full sequences and one sequence
for each binary digit of the rest, which needs no padding.

There is no shuffle. Sequence ids carry the partition number; a retried task gets the same ones,
as it scans the same rows. Null and empty texts have the end id only; very long texts are packed whole. Rows that repeat are packed
again. Pieces of one document may stand in different sequences; ``start`` orders them. An empty table gives an empty
result; columns besides the id and the text are not read. Of pieces of one length the one that comes first is placed first.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from glyphlake.llm.common import documents

CAPACITY = 1024
#: Fractions of the capacity into which the rest of a document is cut.
CUTS = (2, 4, 8, 16)
END = 0


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary file: printable Latin-1 characters are themselves, others follow from 256."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(extra)] = b
            extra += 1
    return out


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes to id from a tokenizer file, whose merges must stand in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, special = byte_letters(), {x["content"] for x in spec.get("added_tokens", [])}
    vocabulary = spec["model"]["vocab"]
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])):
        raise ValueError("merges are not in the order of their ids")
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}


def read_added(path: str) -> dict[str, int]:
    """Added tokens to id; the file's library takes them out of a text before it is cut into words."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("an added token has options that aren't supported")
    return {x["content"]: x["id"] for x in added}


_coders: dict[int, tuple] = {}


def worker_coder(shared):
    """The encoding function of a broadcast (token bytes to id, added tokens, pattern); one per Python worker."""
    if id(shared) not in _coders:
        import tiktoken

        ranks, added, pattern = shared.value
        library = tiktoken.Encoding("shared", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

        def encode(text: str) -> list[int]:
            return library.encode(text, allowed_special="all") if any(x in text for x in added) else library.encode_ordinary(text)

        _coders.clear()
        _coders[id(shared)] = shared, encode
    return _coders[id(shared)][1]


class HarmonicPacker:
    """Packs one worker's pieces; ``rows`` collects (doc, start, length, crc, doc tokens, sequence, offset)."""

    def __init__(self, first_sequence: int = 0, capacity: int = CAPACITY):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def cut(self, n: int) -> list[tuple[int, int]]:
        """(start, length) of the pieces of ``n`` tokens."""
        out, at = [], 0
        while n - at >= self.capacity:
            out.append((at, self.capacity))
            at += self.capacity
        for part in CUTS:
            if n - at >= self.capacity // part > 0:
                out.append((at, self.capacity // part))
                at += self.capacity // part
        if n > at:
            out.append((at, n - at))
        return out

    def add(self, doc, ids: np.ndarray) -> None:
        ids = ids.astype("<u4", copy=False)
        for start, length in self.cut(len(ids)):
            k = self.capacity // length
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, ids[start : start + length], len(ids)))
            if len(bin_) == k:
                self.close(bin_)
                self.open[k] = []

    def close(self, bin_: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in bin_:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in rest)
        while rest:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            bin_: list[tuple] = []
            while room:
                doc, start, ids, total = rest.pop(0)
                bin_.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], total))
                room -= len(bin_[-1][2])
            self.close(bin_)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece. The broadcast is the vocabulary, of fixed size."""
    import public_tokenizers

    path = vocabulary_path or public_tokenizers.path("byte_bpe_50k.json")
    shared = docs.sparkSession.sparkContext.broadcast((read_vocabulary(path), read_added(path), public_tokenizers.PATTERN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_coder(shared)
        packer = HarmonicPacker(TaskContext.get().partitionId() << 40, capacity)

        def out() -> Iterator[pa.RecordBatch]:
            rows, packer.rows = packer.rows, []
            for at in range(0, len(rows), 50_000):
                cols = list(zip(*rows[at : at + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc, np.array([*(encode(text) if text else ()), END], dtype="<u4"))
            yield from out()
        packer.finish()
        yield from out()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
