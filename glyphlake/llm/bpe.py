"""Operator 1: byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can end its encoding. The table keeps that
token for each prefix. A token ``t`` that ends at position ``i`` is the one if the text before it
is encoded with a last token that stays beside ``t``, that is, if the two tokens together would
not have been merged another way. Prefixes never change when bytes are appended, so appends are
exact, and an edit recomputes what follows it only until the old table is met again.

Nulls and empty texts have no tokens; very long texts are encoded whole; rows with the same id are encoded independently; an empty
table gives an empty result; columns besides the id and the text are not read. Of ties between merges the left one comes first, as in the vocabulary's own order.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from glyphlake.llm.common import documents

#: A text without these characters is split alike by the standard library's faster engine.
_ODD = re.compile("[^\x00-\x1b\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ɏ]")
_PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: How far past its end a match of the splitting pattern can look.
LOOK_AHEAD = 3
#: Pieces in each of the two generations that a worker remembers; what the old one has and is met again moves to the new one.
MEMORY = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and a rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Ranks, with the two parts each token was merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.parts: dict[int, tuple[int, int]] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                pair = self._halves(token, rank)
                if pair:
                    self.parts[rank] = pair
        self.merged = {pair: t for t, pair in self.parts.items()}
        self.seen: dict[tuple[int, int], bool] = {}

    def _halves(self, token: bytes, limit: int) -> tuple[int, int] | None:
        cuts = list(range(len(token) + 1))
        while len(cuts) > 3:
            best, at = limit, 0
            for k in range(1, len(cuts) - 1):
                r = self.ranks.get(token[cuts[k - 1] : cuts[k + 1]], limit)
                if r < best:
                    best, at = r, k
            if not at:
                return None
            del cuts[at]
        return self.ranks[token[: cuts[1]]], self.ranks[token[cuts[1] :]]

    def stays(self, a: int, b: int) -> bool:
        """True if ``a`` followed by ``b`` is how their joined bytes are encoded."""
        key = (a, b)
        known = self.seen.get(key)
        if known is None:
            if len(self.seen) > 1_000_000:
                self.seen.clear()
            known = self.seen[key] = self._check(a, b)
        return known

    def _check(self, a: int, b: int) -> bool:
        # Undo merges from the newest to the oldest, looking at the pair that meets at the seam. A merge
        # across the seam happened instead if it is older than the merge undone last on either side.
        bar_a = bar_b = 1 << 62
        while True:
            joined = self.merged.get((a, b))
            # Ties are merged from the left: the left side's merge comes first, and the right side's after the seam's.
            if joined is not None and joined < bar_a and joined <= bar_b:
                return False
            split_a, split_b = self.parts.get(a), self.parts.get(b)
            if split_a is None and split_b is None:
                return True
            if split_b is None or (split_a is not None and a > b):
                bar_a, a = a, split_a[1]
            else:
                bar_b, b = b, split_b[0]


class PrefixTable:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        v, start = self.v, len(self.data)
        self.data += more
        data, last, rank, seen, longest = self.data, self.last, v.ranks.get, v.seen.get, v.longest
        size = v.size
        for end in range(start + 1, len(data) + 1):
            # Only one token fits, so any order finds it: first one that begins where the last one did, or later.
            found = None
            at = end - 1 - size[last[-1]] if end > 1 else 0
            for s in chain(range(at, end), range(at - 1, max(0, end - longest) - 1, -1)):
                t = rank(data[s:end])
                if t is None:
                    continue
                if s:
                    before = last[s - 1]
                    fits = seen((before, t))
                    if not (v.stays(before, t) if fits is None else fits):
                        continue
                found = t
                break
            if found is None:
                raise ValueError("the vocabulary lacks a byte")
            last.append(found)
        return self

    def replace(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Exact re-encoding after ``data[start:end]`` became ``new``: prefixes up to ``start`` are kept, and so is what follows the edit as soon as it is met again.

        A prefix's last token follows from the longest token's number of bytes before it and the last tokens there. Once
        so many in a row are as they were, behind as many unchanged bytes, all later ones are.
        """
        tail, old, longest = self.data[end:], self.last[end:], self.v.longest
        self.data = self.data[:start]
        del self.last[start:]
        self.append(new)
        at = 0
        while at < len(tail):
            step = min(longest, len(tail) - at)
            self.append(tail[at : at + step])
            at += step
            if at >= 2 * longest and self.last[-longest:] == old[at - longest : at]:
                self.data += tail[at:]
                self.last += old[at:]
                break
        return self

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            t = self.last[i - 1]
            out.append(t)
            i -= len(self.v.bytes_of[t])
        return out[::-1]


class Encoder:
    """Encodes texts piece by piece; each match of ``pattern`` is encoded separately."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, plain: bool = True):
        self.v = vocabulary
        self.full = regex.compile(pattern)
        self.plain = plain
        self.memory: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str]:
        if self.plain and not _ODD.search(text):
            return _PLAIN.findall(text)
        return self.full.findall(text)

    def piece(self, piece: str) -> tuple[int, ...]:
        got = self.memory.get(piece) or self.old.get(piece)
        if got is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.v.ranks.get(data)
            got = (whole,) if whole is not None else tuple(PrefixTable(self.v, data).tokens())
        if len(piece) < 200:
            if len(self.memory) >= MEMORY:
                self.old, self.memory = self.memory, {}
            self.memory[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces = self.pieces(text)
        got = list(map(self.memory.get, pieces))
        for k, ids in enumerate(got):
            if ids is None:
                got[k] = self.piece(pieces[k])
        return list(chain.from_iterable(got))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))


class EncodedText:
    """A text with its encoding, kept exact under appends and edits by work near the change only."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.e, self.text = encoder, text
        self.ends: list[int] = []
        self.ids: list[tuple[int, ...]] = []
        self._scan(0, [])

    def _scan(self, start: int, old: list[tuple[int, tuple[int, ...]]]) -> None:
        """Match from ``start`` until a boundary in ``old`` (end, ids of the next pieces) is met again."""
        meet = {end: k for k, (end, _) in enumerate(old)}
        for m in self.e.full.finditer(self.text, start):
            self.ends.append(m.end())
            self.ids.append(self.e.memory.get(m[0]) or self.e.piece(m[0]))
            if m.end() in meet:
                rest = old[meet[m.end()] + 1 :]
                self.ends += [end for end, _ in rest]
                self.ids += [ids for _, ids in rest]
                return

    def replace(self, start: int, end: int, new: str) -> EncodedText:
        shift = len(new) - (end - start)
        keep = 0
        while keep < len(self.ends) and self.ends[keep] + LOOK_AHEAD <= start:
            keep += 1
        old = [(e + shift, ids) for e, ids in zip(self.ends[keep:], self.ids[keep:], strict=True) if e >= end]
        self.text = self.text[:start] + new + self.text[end:]
        del self.ends[keep:], self.ids[keep:]
        self._scan(self.ends[-1] if self.ends else 0, old)
        return self

    def append(self, more: str) -> EncodedText:
        return self.replace(len(self.text), len(self.text), more)

    def tokens(self) -> list[int]:
        return list(chain.from_iterable(self.ids))


def production(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks and splitting pattern of the production tokenizer."""
    import public_tokenizers

    return read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


_made: dict[int, tuple[object, Encoder]] = {}


def worker_encoder(shared) -> Encoder:
    """One encoder per Python worker for a broadcast (ranks, pattern), which is kept so that its id stays its own."""
    key = id(shared)
    if key not in _made:
        _made.clear()
        ranks, pattern = shared.value
        import public_tokenizers

        _made[key] = shared, Encoder(Vocabulary(ranks), pattern, plain=pattern == public_tokenizers.PATTERN)
    return _made[key][1]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """Per row: id, number of tokens, digests of the ids and of the bytes decoded from them.

    The broadcast holds the vocabulary, whose size doesn't depend on the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(production(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        name = [str(i) for i in range(max(encoder.v.bytes_of) + 1)]
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encoder.encode(text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([name[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
