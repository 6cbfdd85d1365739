"""Learning and applying byte-pair merges over word frequencies."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
def word_counts(sequences: DataFrame, line: str = "line") -> DataFrame:
    return sequences.select(F.explode(F.split(line, " ")).alias("word")).where("word <> '' and word <> '<unk>'").groupBy("word").agg(F.count("*").alias("freq"))


def pair_counts(vocabulary: DataFrame) -> DataFrame:
    """(lft, rgt, n): pairs of neighbouring letters weighted by word frequency, the last with the end of the word."""
    chars = F.filter(F.split("word", ""), lambda c: c != "")
    ended = vocabulary.select("freq", chars.alias("c")).select("freq", F.concat(F.slice("c", F.lit(1), F.size("c") - 1), F.array(F.concat(F.element_at("c", -1), F.lit(END)))).alias("c")).where(F.size("c") >= 2)
    pairs = ended.select("freq", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.struct(a.alias("lft"), b.alias("rgt")))).alias("p"))
    return pairs.groupBy(F.col("p.lft").alias("lft"), F.col("p.rgt").alias("rgt")).agg(F.sum("freq").alias("n"))


def learn(vocabulary: DataFrame, merges: int, least: int = 2) -> list[tuple[str, str]]:
    """Greedy merges by frequency; ties go to the smaller pair. Words without a letter pair are left out; equal words count once with their frequency.

    Each choice needs the one before it, so the merges themselves are found on the driver, over all distinct words of the
    learning text, which the caller bounds by lines as the reference does (its 100,000); the words come in blocks, without their letters' tuples.
    """
    words: list[list[str]] = []
    freq: list[int] = []
    for r in vocabulary.where("length(word) > 1").select("word", "freq").toLocalIterator():
        words.append([*r["word"][:-1], r["word"][-1] + END])
        freq.append(r["freq"])
    count: dict[tuple[str, str], int] = {}
    where: dict[tuple[str, str], set[int]] = {}
    changed: set[tuple[str, str]] = set()

    def tally(k: int, sign: int) -> None:
        for pair in zip(words[k], words[k][1:]):
            count[pair] = count.get(pair, 0) + sign * freq[k]
            changed.add(pair)
            if sign > 0:
                where.setdefault(pair, set()).add(k)

    for k in range(len(words)):
        tally(k, 1)
    heap = [(-n, pair) for pair, n in count.items()]
    heapq.heapify(heap)
    out: list[tuple[str, str]] = []
    while len(out) < merges and heap:
        n, pair = heapq.heappop(heap)
        if -n != count.get(pair, 0):  # an old count: the pair stands in the heap again with its new one
            continue
        if -n < least:
            break
        out.append(pair)
        changed.clear()
        for k in where.pop(pair, set()):
            tally(k, -1)
            words[k] = merge(words[k], pair)
            tally(k, 1)
        count.pop(pair, None)
        for p in changed:
            if count.get(p, 0) > 0:
                heapq.heappush(heap, (-count[p], p))
    return out


def merge(parts: list[str], pair: tuple[str, str]) -> list[str]:
    out: list[str] = []
    fresh = False
    for p in parts:
        # A part made by this merge can't take part in it again.
        if out and out[-1] == pair[0] and p == pair[1] and not fresh:
            out[-1] += p
            fresh = True
        else:
            out.append(p)
            fresh = False
    return out


def split_word(word: str, ranks: dict[tuple[str, str], int], keep: set[str] | None = None, version: tuple[int, int] = (0, 2)) -> list[str]:
    """A word's pieces without the end mark; pieces outside ``keep`` are split up again as far as they were merged.

    The end of a word is marked on its last letter, in files of version 0.1 by a symbol of its own.
    """
    parts = [*word[:-1], word[-1] + END] if version >= (0, 2) else [*word, END]
    origin: dict[str, tuple[str, str]] = {}
    while len(parts) > 1:
        best = min(set(zip(parts, parts[1:])), key=lambda p: ranks.get(p, 1 << 60))
        if best not in ranks:
            break
        origin[best[0] + best[1]] = best
        parts = merge(parts, best)

    def undo(p: str, last: bool) -> list[str]:
        shown = p.removesuffix(END) if last else p + "@@"
        if keep is None or shown in keep or p not in origin:
            return [p]
        a, b = origin[p]
        return undo(a, False) + undo(b, last)

    if parts[-1] == END:
        parts.pop()
    whole = [q for k, p in enumerate(parts) for q in undo(p, k == len(parts) - 1)]
    return [q for p in whole if (q := p.removesuffix(END))]


def apply(lines: DataFrame, merges: list[tuple[str, str]], line: str = "line", glossary: tuple[str, ...] = ("<unk>",), keep: set[str] | None = None, version: tuple[int, int] = (0, 2)) -> DataFrame:
    """``lines`` with ``tokenised``: pieces of a word but the last end in @@. Each word is split once for a partition's cache.

    Words are what stands between spaces, of which one is left; white space around the line stays. Glossary
    entries are whole pieces wherever they stand in a word.
    """
    ranks = {p: k for k, p in reversed(list(enumerate(merges)))}
    shared = lines.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, str] = {}

        def word(w: str) -> str:
            got = seen.get(w)
            if got is None:
                if len(seen) > 200_000:
                    seen.clear()
                pieces = [q for p in isolate(w, glossary) for q in ([p] if p in glossary else split_word(p, shared.value, keep, version))]
                got = seen[w] = "@@ ".join(pieces)
            return got

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            body = t.strip()
            at = t.find(body) if body else len(t)
            return t[:at] + " ".join(word(w) for w in body.split(" ") if w) + t[at + len(body) :]

        for s in batches:
            yield s.map(one)

    return lines.withColumn("tokenised", run(F.col(line)))


def isolate(word: str, glossary: list[str] | tuple[str, ...]) -> list[str]:
    """The word cut around glossary entries, those that are named first first."""
    parts = [word]
    for entry in glossary:
        cut = re.compile(f"({re.escape(entry)})")
        parts = [x for p in parts for x in ([p] if p in glossary else cut.split(p)) if x]
    return parts
