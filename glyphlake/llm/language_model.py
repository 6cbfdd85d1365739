"""Operator 10: hierarchical Pitman-Yor language model.

Tokens are white-space words (A-Z lowered) and one end for each text. The hierarchy: a restaurant for each
preceding word, whose parent is the word restaurant, whose parent is uniform over the known words and one unknown.
The tables of the contexts are the customers of the word restaurant.

Seating is sampled by Gibbs. A sweep reseats every context's dishes, given the word restaurant and the context's tables
of the sweep before, then the word restaurant's dishes, given the tables that the contexts now have. A dish leaves with all its
customers and they sit down again one after another (beyond ``SINGLY`` in growing blocks, with binomial draws). One
discount and one strength hold for all contexts: the discount is drawn around its estimate from dishes with one and two
customers, the strength from its likelihood over a grid. The predictive probabilities of the sweeps after
burn-in are averaged. Draws are hashes of the dish and the sweep, and sums are integers, so partitions change nothing.

The corpus is gathered in blocks of packed numbers, one row for each block and partition; words and contexts are 64-bit hashes:

* words: counts from training documents, summed in a block first, so a frequent word is a number and not a row for each document.
* pairs: (context, word) with their documents, by context. A context with more than its share of tokens is dealt by
  its words too, over as many partitions as it has shares; so is a pair with more than its share, by blocks. The broadcasts that say so
  hold at most 8 contexts and 8 pairs for each partition; one of the most frequent words (at most ``CODES``) only shortens what is sent.
* sweeps: a context's partition tells each word's partition the tables and hears of the word's probability.
* home: sums for documents, in blocks.

Null and empty texts hold the end only; very long texts are taken whole; an empty table gives an empty result; without training documents
every word is unknown. Rows with the same id are one document: they have its numbers, tokens included; so are rows
without an id, which are trained on. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.common import SpanHash, discard, documents, materialise, mix64

SWEEPS, BURN_IN = 4, 2
DISCOUNT, STRENGTH = 0.75, 5.0
#: Strengths that are weighed by their likelihood.
GRID = 0.25 * 2.0 ** np.arange(16)
#: Customers of a dish that sit down one by one.
SINGLY = 32
#: Characters of text that a worker looks at together, and frequent words with a short code.
BLOCK, CODES = 8_000_000, 65_535
#: Tokens that a part has at least, so that small tables aren't cut into more messages than numbers.
PART_TOKENS = 250_000
FOLDS, HELD = 7, 2
#: Fixed point of summed logarithms.
POINT = float(1 << 36)
_END = np.uint64(0x5851F42D4C957F2D)
_NULL = -(1 << 63)
_ROW = "part int, kind int, src int, blob binary"
WORDS, PAIRS, MODEL, ENTRIES, SEATS, TELL, REPLY, HEAVY, HOT, STATS, HOME = range(11)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's words, then of its end; and how many each text has. A hash doesn't depend on where a word stands."""
    parts = [b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in texts]
    n = np.array([p.count(b" ") + 2 if p else 1 for p in parts], np.int64)
    out = np.full(n.sum(), _END)
    data = b" ".join([p for p in parts if p])
    if data:
        ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))
        word = np.ones(len(out), bool)
        word[np.cumsum(n) - 1] = False
        out[word] = SpanHash(data)(np.append(0, ends[:-1] + 1), ends)
    return out, n


# --- packed numbers ---------------------------------------------------------

def _narrow(x: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds the numbers."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in planes of their bytes; long numbers in order as differences. Both compress better."""
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        steps = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        x = np.append(a[:1], a[1:] - a[:-1]) if steps else a
        parts += [a.dtype.str[1:].encode(), struct.pack("<BQ", steps, len(a)), np.ascontiguousarray(x).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 1, []
    for _ in range(raw[0]):
        kind = np.dtype("<" + raw[at : at + 2].decode())
        steps, n = struct.unpack_from("<BQ", raw, at + 2)
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 11).reshape(kind.itemsize, n)
        x = np.ascontiguousarray(planes.T).view(kind).reshape(n)
        out.append(np.cumsum(x, dtype=kind) if steps else x)
        at += 11 + n * kind.itemsize
    return out


def _cuts(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(sorted_keys):
        head = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
        for a, b in zip(head, np.append(head[1:], len(sorted_keys))):
            yield int(sorted_keys[a]), int(a), int(b)


def _heads(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins."""
    new = reduce(np.logical_or, [k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(np.append(True, new)) if len(sorted_keys[0]) else np.zeros(0, np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[_heads(x)]


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the number of each value among them."""
    order = np.argsort(x)
    x = x[order]
    heads = _heads(x)
    rank = np.empty(len(x), np.int64)
    rank[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(x))))
    return x[heads], rank


def _order(keys: np.ndarray) -> np.ndarray:
    """A stable order of whole numbers under 2**32, by sorting each with its place."""
    return (np.sort((keys.astype(np.uint64) << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _sums(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Exact sums of runs of integers."""
    return np.add.reduceat(values, heads) if len(heads) else np.zeros(0, np.int64)


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["part", "kind", "src", "blob"])


def _met(rows: DataFrame, work: Callable[[int, dict[int, list]], Iterator[tuple]]) -> DataFrame:
    """``work(part, {kind: [(src, arrays)]})`` for each part, whose rows meet in one partition; arrays are unpacked one part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = defaultdict(list)
        for b in batches:
            for part, kind, src, blob in zip(*(b.column(k).to_pylist() for k in range(4))):
                got[part].append((kind, src, blob))
        while got:
            part, mine = got.popitem()
            by: dict[int, list] = defaultdict(list)
            for kind, src, blob in sorted(mine, key=lambda x: x[:2]):
                by[kind].append((src, _unpack(blob)))
            del mine
            yield _rows(list(work(part, by)))

    run.__name__ = work.__qualname__.split(".")[0]  # plans show the step
    return rows.repartition("part").mapInArrow(run, _ROW)


def _of(table: DataFrame, *kinds: int) -> DataFrame:
    return table.where(F.col("kind").isin(*kinds)).select("part", "kind", "src", "blob")


def _numbers(table: DataFrame, kind: int = STATS) -> np.ndarray:
    """Sum of the integer vectors that a job's partitions leave, one row for each part."""
    total: np.ndarray | int = 0
    for r in _of(table, kind).toLocalIterator():
        total = total + _unpack(r["blob"])[0]
    return total


# --- draws -------------------------------------------------------------------

def uniform(key: np.ndarray, number: int) -> np.ndarray:
    """A number in (0, 1) for each key and draw, the same wherever it is made."""
    mixed = mix64(key ^ mix64(np.array([number], np.uint64) * _ODD + np.uint64(1)))
    return ((mixed >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def binomial(key: np.ndarray, number: int, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Successes in ``n`` trials: by inversion, or from the normal distribution where thirty or more are expected."""
    u, mean = uniform(key, number), n * p
    out = np.zeros(len(n), np.int64)
    many = mean >= 30
    if many.any():
        z = np.sqrt(-2 * np.log(u[many])) * np.cos(2 * np.pi * uniform(key[many], number + (1 << 20)))
        out[many] = np.clip(np.rint(mean[many] + z * np.sqrt(mean[many] * (1 - p[many]))), 0, n[many])
    live = np.flatnonzero(~many)
    mass = np.exp(n[live] * np.log1p(-np.minimum(p[live], 1 - 1e-12)))
    sum_, k = mass.copy(), 0
    while len(live):
        more = (u[live] > sum_) & (k < n[live])
        live, mass, sum_ = live[more], mass[more], sum_[more]
        mass = mass * (n[live] - k) / (k + 1) * p[live] / np.maximum(1 - p[live], 1e-12)
        sum_ = sum_ + mass
        k += 1
        out[live] = k
    return out


def reseat(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, key: np.ndarray, sweep: int, discount: float, strength: float) -> np.ndarray:
    """Tables of dishes whose customers sit down anew, given the tables of the context's other dishes and the parent's probability."""
    t, seated, draw = np.minimum(customers, 1).astype(np.int64), 1, sweep << 10
    live = np.flatnonzero(customers > 1)
    while len(live):
        step = 1 if seated < SINGLY else seated // 16
        sit = np.minimum(step, customers[live] - seated)
        new = (strength + discount * (others[live] + t[live])) * parent[live]
        p = new / (new + seated - discount * t[live])
        t[live] += (uniform(key[live], draw) < p) if step == 1 else binomial(key[live], draw, sit, p)
        seated, draw = seated + step, draw + 1
        live = live[customers[live] > seated]
    return t


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up, where it is good to all digits."""
    low = np.log(x)
    for k in range(1, 8):
        low = low + np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def strength_weights(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """Log likelihood of each strength of the grid, summed over restaurants, in fixed point."""
    on = customers > 1
    both, times = np.unique((customers[on] << 32) | tables[on], return_counts=True)
    c, t = (both >> 32).astype(float), (both & 0xFFFFFFFF).astype(float)
    out = []
    for s in GRID:
        ll = (t - 1) * np.log(discount) + _lgamma(s / discount + t) - _lgamma(np.full(len(t), s / discount + 1)) - _lgamma(s + c) + _lgamma(np.full(len(c), s + 1.0))
        out.append(int((np.rint(ll * (1 << 16)).astype(np.int64) * times).sum()))
    return np.array(out, np.int64)


class Level:
    """Discount and strength of a level, drawn anew after each sweep from whole-corpus counts."""

    def __init__(self, salt: int):
        self.d, self.s, self.salt = DISCOUNT, STRENGTH, salt

    def draw(self, sweep: int, ones: int, twos: int, weights: np.ndarray) -> None:
        rng = np.random.default_rng([self.salt, sweep])
        share = 50 * (ones + 1) / (ones + 2 * twos + 2)
        self.d = float(min(0.95, max(0.05, rng.beta(share, max(1.0, 50 - share)))))
        w = weights / float(1 << 16)
        p = np.exp(w - w.max())
        self.s = float(GRID[min(len(GRID) - 1, int(np.searchsorted(np.cumsum(p / p.sum()), rng.random())))])


# --- gathering -----------------------------------------------------------------

def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, document number of each token, token hashes)."""
    docs, toks, counts, size, texts, small = [], [], [], 0, [], 0

    def hashed():
        nonlocal texts, small
        if texts:
            t, n = token_hashes(texts)
            toks.append(t)
            counts.append(n)
            texts, small = [], 0

    def out():
        nonlocal docs, toks, counts, size
        hashed()
        found = np.array([_NULL if d is None else d for d in docs], np.int64), np.repeat(np.arange(len(docs)), np.concatenate(counts)), np.concatenate(toks)
        docs, toks, counts, size = [], [], [], 0
        return found

    for b in batches:
        for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n = len(text or "")
            if docs and size + n > BLOCK:
                yield out()
            docs.append(d)
            texts.append(text)
            size, small = size + n + 16, small + n
            if small > 200_000:  # hashed together: fewer calls, small arrays
                hashed()
            if size >= BLOCK:
                yield out()
    if docs:
        yield out()


def _is_held(docs: np.ndarray) -> np.ndarray:
    return np.array([d != _NULL and held_out(int(d)) for d in docs], bool)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(keys) % np.uint64(parts)).astype(np.int64)


def _before(tokens: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each token's context; a text's first word follows the end."""
    out = np.append(_END, tokens[:-1])
    out[_heads(doc)] = _END
    return out


def word_counts(texts: DataFrame, parts: int) -> DataFrame:
    """WORDS (word, training tokens) by word, PAIRS (context, word, training tokens) of what is frequent, and STATS (tokens, words).

    A block tells of the pairs that have a share of 1 / (16 parts) of it or more, so for a pair with twice that share of all
    tokens at least half of them are told of.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, doc, tokens in _blocks(batches):
            train = ~_is_held(docs)[doc]
            k, n = np.unique(tokens[train], return_counts=True)
            least = max(2, n.sum() / (16 * parts))
            often = k[n >= least]
            dest = _part(k, parts)
            order = np.argsort(dest.astype(np.uint16) if parts < 1 << 16 else dest, kind="stable")
            k, n = k[order], n[order]
            rows = [(p, WORDS, 0, _pack(k[a:b], _narrow(n[a:b]))) for p, a, b in _cuts(dest[order])]
            if len(often):
                at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                at[often[at] != tokens] = -1
                end = np.searchsorted(often, _END) if _END in often else -1
                before = np.append(end, at[:-1])
                before[_heads(doc)] = end
                both, n = np.unique((before * len(often) + at)[(before >= 0) & (at >= 0) & train], return_counts=True)
                both, n = both[n >= least], n[n >= least]
                u, w = often[both // len(often)], often[both % len(often)]
                dest = _part(_pair_key(u, w), parts)
                rows += [(int(p), PAIRS, 0, _pack(u[dest == p], w[dest == p], n[dest == p])) for p in np.unique(dest)]
            yield _rows(rows)

    def meet(part: int, by: dict[int, list]) -> Iterator[tuple]:
        if by[WORDS]:
            k, n = (np.concatenate([x[1][i] for x in by[WORDS]]) for i in (0, 1))
            order = np.argsort(k, kind="stable")
            k, heads = k[order], _heads(k[order])
            n = _sums(n[order].astype(np.int64), heads)
            yield part, WORDS, 0, _pack(k[heads], n)
            yield part, STATS, 0, _pack(np.array([n.sum(), len(n)], np.int64))
        if by[PAIRS]:
            u, w, n = (np.concatenate([x[1][i] for x in by[PAIRS]]) for i in range(3))
            order = np.lexsort((w, u))
            heads = _heads(u[order], w[order])
            yield part, PAIRS, 0, _pack(u[order][heads], w[order][heads], _sums(n[order], heads))

    return _met(texts.mapInArrow(send, _ROW), meet)


def _frequent(table: DataFrame, kind: int, least: float) -> DataFrame:
    """Rows of words (word, n) or pairs (u, w, n) with so many tokens; the hashes as signed numbers."""
    names = ["word", "n"] if kind == WORDS else ["u", "w", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(3).to_pylist():
                got = _unpack(blob)
                on = got[-1] >= least
                yield pa.RecordBatch.from_arrays([pa.array(x[on].view(np.int64)) for x in got], names)

    return _of(table, kind).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _redealt(words: DataFrame, parts: int) -> DataFrame:
    """The same counts on fewer parts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, blob in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                x = _unpack(blob)
                dest = _part(x[0] if kind == WORDS else _pair_key(x[0], x[1]), parts)
                order = np.argsort(dest, kind="stable")
                yield _rows([(p, kind, 0, _pack(*(a[order[i:j]] for a in x))) for p, i, j in _cuts(dest[order])])

    def meet(part: int, by: dict[int, list]) -> Iterator[tuple]:
        for kind, rows in by.items():
            x = [np.concatenate(a) for a in zip(*(r[1] for r in rows))]
            order = np.argsort(x[0], kind="stable")
            yield part, kind, 0, _pack(*(a[order] for a in x))

    return _met(_of(words, WORDS, PAIRS).mapInArrow(send, _ROW), meet)


class Shares:
    """Which contexts and pairs have more than their share of tokens, over how many parts they are dealt, and the short codes of frequent words."""

    def __init__(self, parts: int, tokens: int, heavy: dict[int, int], pairs: dict[tuple[int, int], int], codes: np.ndarray):
        share = max(1.0, tokens / parts / 8)
        split = lambda n: int(n / share) + 1
        self.parts = parts
        self.u = np.array(sorted(heavy), np.uint64)
        self.total = np.array([heavy[int(x)] for x in self.u], np.int64)
        self.salts = np.array([split(n) for n in self.total], np.uint64)
        self.codes = np.sort(codes)
        key = _pair_key(np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.uint64))
        order = np.argsort(key)
        self.pair = key[order]
        # At least half of their tokens were told of.
        self.pair_salts = np.array([split(2 * n) for n in pairs.values()], np.uint64)[order]

    def find(self, keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(among, keys), max(0, len(among) - 1))
        return at, among[at] == keys if len(among) else np.zeros(len(keys), bool)

    def home(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The part that owns each pair."""
        at, on = self.find(u, self.u)
        salt = np.zeros(len(u), np.uint64)
        salt[on] = mix64(w[on]) % self.salts[at[on]]
        return _part(u ^ (salt * _ODD), self.parts)

    def dealt(self, u: np.ndarray, w: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The parts that a block's documents of each pair go to, and those that own the pairs."""
        home = self.home(u, w)
        out = home.copy()
        key = _pair_key(u, w)
        at, on = self.find(key, self.pair)
        if on.any():
            salt = mix64(np.array([block % (1 << 64)], np.uint64))[0] % self.pair_salts[at[on]]
            out[on] = np.where(salt == 0, home[on], _part(key[on] ^ (salt * _ODD), self.parts))
        return out, home


def _pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(u * _ODD ^ mix64(w))


def pair_counts(texts: DataFrame, shares: Shares) -> DataFrame:
    """MODEL (contexts, words, pairs with training counts) and ENTRIES (documents of each pair) by context, with the first TELL and STATS."""
    shared = texts.sparkSession.sparkContext.broadcast(shares)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for docs, doc, tokens in _blocks(batches):
            pu, pw, n, d, count = _entries(docs, doc, tokens)
            first = np.cumsum(n) - n
            dest, home = own.dealt(pu, pw, int(docs[0]))
            held = _is_held(docs)
            order = np.argsort(dest.astype(np.uint16) if own.parts < 1 << 16 else dest, kind="stable")
            rows = []
            for p, a, b in _cuts(dest[order]):
                x = order[a:b]
                m = n[x]
                e = np.repeat(first[x] - np.cumsum(m) + m, m) + np.arange(m.sum())
                there = np.zeros(len(docs), bool)
                there[d[e]] = True
                used, back = np.flatnonzero(there), (np.cumsum(there) - 1)[d[e]]
                rows.append((p, PAIRS, 0, _pack(*own_runs(pu[x]), *_coded(pw[x], own.codes), _narrow(m), docs[used], _narrow(back), _narrow(count[e]), np.zeros(0, np.uint8))))
            # The part that owns a pair hears how often it stands in the documents that go elsewhere.
            x = np.flatnonzero(dest != home)
            if len(x):
                trained = np.add.reduceat(np.where(held[d], 0, count), first)
                for p in np.unique(home[x]):
                    y = x[home[x] == p]
                    none = np.zeros(0, np.uint8)
                    rows.append((int(p), PAIRS, 0, _pack(*own_runs(pu[y]), *_coded(pw[y], own.codes), np.zeros(len(y), np.uint8), np.zeros(0, np.int64), none, none, _narrow(trained[y]))))
            yield _rows(rows)

    def meet(part: int, by: dict[int, list]) -> Iterator[tuple]:
        own = shared.value
        us, ws, ns, docs, ds, cs, more, base = [], [], [], [], [], [], [], 0
        for _, (u, runs, code, raw, n, ids, d, c, extra) in by.pop(PAIRS):
            us.append(np.repeat(u, runs))
            ws.append(_decoded(code, raw, own.codes))
            ns.append(n.astype(np.int64))
            docs.append(ids)
            ds.append(d.astype(np.int64) + base)
            cs.append(c.astype(np.int64))
            more.append(extra.astype(np.int64) if len(extra) else np.zeros(len(n), np.int64))
            base += len(ids)
        u, w, n, doc, d, c, more = map(np.concatenate, (us, ws, ns, docs, ds, cs, more))
        del us, ws, ns, docs, ds, cs
        row = np.repeat(np.arange(len(u)), n)
        # Pairs are sorted by the numbers of their words, which the model keeps.
        words, place = _ranked(w)
        key = (_ranked(u)[1].astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)
        order = np.argsort(key)
        heads = _heads(key[order])
        number = np.empty(len(order), np.int64)
        number[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        pair = number[row]
        train = _sums(more[order], heads) + np.bincount(pair, np.where(_is_held(doc)[d], 0, c), len(heads)).astype(np.int64)  # whole numbers, exact
        entry = _order(pair)
        d, c = d[entry], c[entry]
        lead = order[heads]
        u, w, place = u[lead], w[lead], place[lead]
        mine = own.home(u, w) == part
        first = _heads(u)
        at, on = own.find(_pair_key(u, w), own.pair)
        hot = np.flatnonzero(on)
        yield part, MODEL, 0, _pack(u[first], _narrow(np.diff(np.append(first, len(u)))), words, _narrow(place), _narrow(train), mine.astype(np.uint8), hot, at[hot])
        yield part, ENTRIES, 0, _pack(doc, _narrow(np.bincount(pair, minlength=len(u))), _narrow(d), _narrow(c))
        x = hot[mine[hot]]
        if len(x):
            yield part, HOT, 0, _pack(at[x], train[x])
        m = Model(part, own, u[first], np.diff(np.append(first, len(u))), place, words, train, mine)
        yield from m.told(np.minimum(train, 1))

    return _met(texts.mapInArrow(send, _ROW), meet)


def _entries(docs: np.ndarray, doc: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
    """Context and word of each distinct pair of a block, how many documents have it, and those documents' numbers and counts."""
    words, at = _ranked(np.append(tokens, _END))
    at = at.astype(np.uint64)
    end, at = at[-1], at[:-1]
    before = np.append(end, at[:-1])
    before[_heads(doc)] = end
    wide, deep = np.uint64(len(words).bit_length()), np.uint64(len(docs).bit_length())
    if 2 * int(wide) + int(deep) <= 64:  # the numbers of a pair and its document are one number
        key = np.sort((((before << wide) | at) << deep) | doc.astype(np.uint64))
        entry = _heads(key)
        pair, d = key[entry] >> deep, (key[entry] & ((np.uint64(1) << deep) - np.uint64(1))).astype(np.int64)
        u, w = pair >> wide, pair & ((np.uint64(1) << wide) - np.uint64(1))
    else:
        order = np.lexsort((doc, at, before))
        u, w, d = before[order], at[order], doc[order]
        entry = _heads(u, w, d)
        u, w, d = u[entry], w[entry], d[entry]
    count = np.diff(np.append(entry, len(tokens)))
    first = _heads(u, w)
    return words[u[first].astype(np.int64)], words[w[first].astype(np.int64)], np.diff(np.append(first, len(u))), d, count


def own_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = _heads(x)
    return x[head], _narrow(np.diff(np.append(head, len(x))))


def _coded(words: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of frequent words; for others the number after the last, and their hash in a list of its own."""
    if not len(codes):
        return np.zeros(len(words), np.uint16), words
    at = np.minimum(np.searchsorted(codes, words), len(codes) - 1)
    at = np.where(codes[at] == words, at, len(codes))
    return at.astype(np.uint16), words[at == len(codes)]


def _decoded(code: np.ndarray, raw: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.append(codes, np.uint64(0))[code]
    out[code == len(codes)] = raw
    return out


class Model:
    """One part's pairs, sorted by context and word: contexts and how many pairs each has, words (numbers into a sorted list), training tokens, and whether the part owns them."""

    def __init__(self, part: int, shares: Shares, contexts: np.ndarray, pairs: np.ndarray, place: np.ndarray, words: np.ndarray, train: np.ndarray, mine: np.ndarray):
        self.part, self.shares, self.contexts, self.place, self.words, self.train = part, shares, contexts, place, words, train
        self.owned = None if mine.all() else mine
        self.first = np.cumsum(pairs) - pairs
        self.number = np.repeat(np.arange(len(contexts)), pairs)
        self.many = np.flatnonzero(train > 1)
        self.at, self.heavy = shares.find(contexts, shares.u)
        self.customers = _sums(self.mine(train), self.first)
        # Of a context that is dealt over several parts the whole is known.
        self.customers[self.heavy] = shares.total[self.at[self.heavy]]

    @classmethod
    def read(cls, part: int, shares: Shares, packed: list[np.ndarray], hot: np.ndarray) -> Model:
        """``hot``: training tokens of the pairs that are dealt by blocks."""
        contexts, pairs, words, place, train, mine, dealt, at = packed
        train = train.astype(np.int64)
        train[dealt] = hot[at]
        return cls(part, shares, contexts, pairs.astype(np.int64), place.astype(np.int64), words, train, mine.astype(bool))

    def mine(self, values: np.ndarray) -> np.ndarray:
        """Without the numbers of pairs that other parts own."""
        return values if self.owned is None else np.where(self.owned, values, 0)

    def keys(self, x: np.ndarray) -> np.ndarray:
        return _pair_key(self.contexts[self.number[x]], self.words[self.place[x]])

    def tables(self, t: np.ndarray, heavy_tables: np.ndarray) -> np.ndarray:
        """Tables of each context."""
        out = _sums(self.mine(t), self.first)
        out[self.heavy] = heavy_tables[self.at[self.heavy]]
        return out

    def told(self, t: np.ndarray) -> Iterator[tuple]:
        """TELL (word, tables) for each part of words; HEAVY tables; STATS of dishes with one and two customers."""
        own = self.mine(t)
        sums = np.bincount(self.place, own, len(self.words)).astype(np.int64)  # whole numbers, exact
        for q, x in self._asked():
            yield q, TELL, self.part, _pack(self.words[x], _narrow(sums[x]))
        heavy = np.flatnonzero(self.heavy)
        if len(heavy):
            yield self.part, HEAVY, 0, _pack(self.at[heavy], _sums(own, self.first)[heavy])
        c = self.mine(self.train)
        yield self.part, STATS, 0, _pack(np.array([(c == 1).sum(), (c == 2).sum()], np.int64))

    def _asked(self) -> Iterator[tuple[int, np.ndarray]]:
        """(part of words, this part's words there)."""
        dest = _part(self.words, self.shares.parts)
        order = np.argsort(dest.astype(np.uint16) if self.shares.parts < 1 << 16 else dest, kind="stable")
        for q, a, b in _cuts(dest[order]):
            yield q, order[a:b]

    def heard(self, replies: list[tuple[int, list[np.ndarray]]]) -> np.ndarray:
        """What the parts of words say of this part's words, in their order; one column for each number."""
        at = dict(self._asked())
        out = np.zeros((3, len(self.words)), np.int64)
        for q, numbers in replies:
            for k, x in enumerate(numbers):
                out[k, at[q]] = x
        return out


def _whole(table: DataFrame, kind: int, n: int) -> np.ndarray:
    """Sums of what the parts tell of dealt contexts (HEAVY tables) or pairs (HOT tokens); each is on as many parts as it has shares."""
    out = np.zeros(n, np.int64)
    for r in _of(table, kind).toLocalIterator():
        at, t = _unpack(r["blob"])
        np.add.at(out, at, t)
    return out


def _strengths(m: Model, tables: np.ndarray, discount: float) -> np.ndarray:
    own = ~m.heavy
    return strength_weights(m.customers[own], tables[own], discount)


# --- sweeps ----------------------------------------------------------------------

def word_sweep(words: DataFrame, told: DataFrame, level: Level, tables: int, known: int, sweep: int) -> DataFrame:
    """REPLY (customers, tables, training tokens) to each part for its words, and STATS (customers, tables, dishes with one and two)."""
    d, s = level.d, level.s

    def work(part: int, by: dict[int, list]) -> Iterator[tuple]:
        own, count = by[WORDS][0][1] if by[WORDS] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        asked = [(src, x[0], x[1].astype(np.int64)) for src, x in by[TELL]]
        every = _distinct(np.concatenate([own, *[k for _, k, _ in asked]]))
        customers, n = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        n[np.searchsorted(every, own)] = count
        for _, k, t in asked:
            customers[np.searchsorted(every, k)] += t
        t = reseat(customers, np.full(len(every), max(0.0, tables - 1.0)), np.full(len(every), 1.0 / (known + 1)), every, (1 << 12) + sweep, d, s)
        for src, k, _ in asked:
            at = np.searchsorted(every, k)
            yield src, REPLY, part, _pack(*(_narrow(x[at]) for x in (customers, t, n)))
        yield part, STATS, 0, _pack(np.array([customers.sum(), t.sum(), (customers == 1).sum(), (customers == 2).sum()], np.int64))

    return _met(_of(words, WORDS).unionByName(_of(told, TELL)), work)


class Word:
    """What turns a reply into a word's probability."""

    def __init__(self, level: Level, stats: np.ndarray, known: int):
        customers, tables = (int(x) for x in stats[:2])
        self.base = (level.s + level.d * tables) / (known + 1)
        self.total, self.d = level.s + customers, level.d

    def probability(self, heard: np.ndarray) -> np.ndarray:
        return (heard[0] - self.d * heard[1] + self.base) / self.total


def context_sweep(model: DataFrame, seats: DataFrame | None, replies: DataFrame, shares, hot: np.ndarray, word: Word, level: Level, heavy: np.ndarray, sweep: int) -> DataFrame:
    """SEATS (tables of pairs with several customers), and what ``Model.told`` tells of them."""
    d, s = level.d, level.s

    def work(part: int, by: dict[int, list]) -> Iterator[tuple]:
        m = Model.read(part, shares.value, by[MODEL][0][1], hot)
        t = np.minimum(m.train, 1)
        if by[SEATS]:
            t[m.many] = by[SEATS][0][1][0]
        parent = word.probability(m.heard(by[REPLY]))
        x = m.many
        others = np.maximum(m.tables(t, heavy)[m.number[x]] - t[x], 0)
        t[x] = reseat(m.train[x], others, parent[m.place[x]], m.keys(x), sweep, d, s)
        yield part, SEATS, sweep, _pack(_narrow(t[x]))
        for row in m.told(t):
            # The strengths' likelihoods follow the counts of dishes; dealt contexts are added by the driver.
            yield row if row[1] != STATS else (part, STATS, 0, _pack(np.concatenate([_unpack(row[3])[0], _strengths(m, m.tables(t, heavy), d)])))

    rows = _of(model, MODEL).unionByName(_of(replies, REPLY))
    return _met(rows if seats is None else rows.unionByName(_of(seats, SEATS)), work)


class Sample:
    """One sweep's numbers after burn-in."""

    def __init__(self, sweep: int, level: Level, word: Word, heavy: np.ndarray):
        self.sweep, self.d, self.s, self.word, self.heavy = sweep, level.d, level.s, word, heavy


def document_sums(model: DataFrame, seats: list[DataFrame], replies: list[DataFrame], shares, hot: np.ndarray, samples: list[Sample]) -> DataFrame:
    """HOME rows: documents with their sums of log10 probabilities, of log10(c + 1), of known tokens and of tokens."""

    def work(part: int, by: dict[int, list]) -> Iterator[tuple]:
        m = Model.read(part, shares.value, by[MODEL][0][1], hot)
        docs, n, d, c = by.pop(ENTRIES)[0][1]
        mean = np.zeros(len(m.train))
        parts = m.shares.parts
        for k, x in enumerate(samples):
            t = np.minimum(m.train, 1)
            t[m.many] = next(a[0] for src, a in by[SEATS] if src == x.sweep)
            heard = m.heard([(src % parts, a) for src, a in by[REPLY] if src // parts == k])
            total, tables, parent, count = m.customers[m.number], m.tables(t, x.heavy)[m.number], x.word.probability(heard)[m.place], heard[2]
            own = (m.train - x.d * t + (x.s + x.d * tables) * parent) / (x.s + total)
            mean += np.where(total > 0, own, parent) / len(samples)
        logs = np.rint(np.log10(mean) * POINT).astype(np.int64)
        base = np.rint(np.log10(count + 1) * POINT).astype(np.int64)[m.place]
        pair, times, d = np.repeat(np.arange(len(n)), n), c.astype(np.int64), d.astype(np.int64)
        ids, back = np.unique(docs, return_inverse=True)
        order = _order(back[d])
        heads = _heads(back[d][order])
        pair, times = pair[order], times[order]
        sums = [_sums(times * x, heads) for x in (logs[pair], base[pair], (count > 0)[m.place[pair]].astype(np.int64), np.ones(len(pair), np.int64))]
        own = ids[back[d][order][heads]]
        dest = _part(own.view(np.uint64), parts)
        order = np.argsort(dest, kind="stable")
        for p, a, b in _cuts(dest[order]):
            y = order[a:b]
            yield p, HOME, part, _pack(own[y], sums[0][y], sums[1][y], _narrow(sums[2][y]), _narrow(sums[3][y]))

    parts = shares.value.parts
    rows = _of(model, MODEL, ENTRIES)
    for k, (s, r) in enumerate(zip(seats, replies)):
        rows = rows.unionByName(_of(s, SEATS)).unionByName(_of(r, REPLY).withColumn("src", F.col("src") + k * parts))
    return _met(rows, work)


def _at_home(sums: DataFrame) -> DataFrame:
    """(k, logs, base, known, tokens) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unpack(x) for b in batches for x in b.column(3).to_pylist()]
        if got:
            ids, *sums = (np.concatenate([x[k] for x in got]).astype(np.int64) for k in range(5))
            order = np.argsort(ids, kind="stable")
            heads = _heads(ids[order])
            yield pa.RecordBatch.from_arrays([pa.array(ids[order][heads]), *[pa.array(_sums(x[order], heads)) for x in sums]], ["k", "logs", "base", "known", "tokens"])

    return _of(sums, HOME).repartition("part").mapInArrow(run, "k long, logs long, base long, known long, tokens long")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # The first round has no documents, only counts; it says how many parts the others need.
    counted = materialise(word_counts(texts, most), "kind")
    tokens, known = (int(x) for x in np.broadcast_to(_numbers(counted), 2))
    parts = min(most, max(1, tokens // PART_TOKENS))
    words = counted if parts == most else materialise(_redealt(counted, parts), "kind")
    # At most 8 words and 16 pairs for each part have such shares; at most a million words have the other, of which the most frequent get codes.
    share = max(1.0, tokens / parts / 8)
    heavy = {r["word"] % (1 << 64): r["n"] for r in _frequent(words, WORDS, share).collect()}
    pairs = {(r["u"] % (1 << 64), r["w"] % (1 << 64)): r["n"] for r in _frequent(words, PAIRS, share / 2).collect()}
    codes = np.array([r["word"] % (1 << 64) for r in _frequent(words, WORDS, max(2, tokens >> 20)).orderBy(F.desc("n"), "word").limit(CODES).collect()], np.uint64)
    own = Shares(parts, tokens, heavy, pairs, codes)
    shares = spark.sparkContext.broadcast(own)
    model = materialise(pair_counts(texts, own), "kind")
    hot = _whole(model, HOT, len(own.pair))
    upper, lower = Level(1), Level(2)
    dishes = np.broadcast_to(_numbers(model), 2)
    lower.draw(0, int(dishes[0]), int(dishes[1]), np.zeros(len(GRID)))
    told, seats, tables, heavy_tables = model, None, known, _whole(model, HEAVY, len(own.u))
    kept: list[tuple[DataFrame, DataFrame, Sample]] = []
    for sweep in range(SWEEPS + 1):
        replies = materialise(word_sweep(words, told, upper, tables, known, sweep))
        discard(told, kind=TELL)
        stats = np.broadcast_to(_numbers(replies), 4)
        word, tables = Word(upper, stats, known), int(stats[1])
        upper.draw(sweep, int(stats[2]), int(stats[3]), strength_weights(np.array([max(1, int(stats[0]))]), np.array([max(1, tables)]), upper.d))
        if sweep > BURN_IN:
            kept.append((seats, replies, Sample(sweep, lower, word, heavy_tables)))
        if sweep < SWEEPS:
            told = materialise(context_sweep(model, seats, replies, shares, hot, word, lower, heavy_tables, sweep + 1), "kind")
            seats, heavy_tables = told, _whole(told, HEAVY, len(own.u))
            found = np.broadcast_to(_numbers(told), 2 + len(GRID))
            # Dealt contexts are added here, where their tables are whole.
            lower.draw(sweep + 1, int(found[0]), int(found[1]), found[2:] + (strength_weights(own.total, heavy_tables, lower.d) if len(own.u) else 0))
        if sweep <= BURN_IN:
            discard(replies)
    discard(words, counted)
    sums = materialise(document_sums(model, [x[0] for x in kept], [x[1] for x in kept], shares, hot, [x[2] for x in kept]))
    discard(model, *(x for k in kept for x in k[:2]))
    per_token = float(np.log10(tokens + known + 1)) if tokens else 0.0
    rows = texts.select("doc_id", F.coalesce("doc_id", F.lit(_NULL)).alias("k"))
    out = rows.join(_at_home(sums), "k")
    held = F.coalesce(F.expr(f"crc32(cast(cast(doc_id as string) as binary)) % {FOLDS} = {HELD}"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), F.round(F.col("base") / POINT - F.col("tokens") * F.lit(per_token), 6).alias("base_score"), F.round(F.col("logs") / POINT, 6).alias("score"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
