"""Operator 8: removal of repeated byte strings by a depth-limited suffix sort.

A byte goes if a string of ``DEPTH`` bytes that covers it also starts in a document with a smaller
id. Only suffixes that can be repeated are sorted, and only through their first ``DEPTH`` bytes:

1. Each window of ``DEPTH`` bytes picks the ``GRAM``-byte string in it with the smallest hash, the
   leftmost of equals. Equal windows pick the same string at the same place, so a window can only be
   repeated if its pick is also picked in another document. Documents send hashes of their picks, in blocks.
2. Consecutive windows with one pick form a run. For picks that two documents share, the text under a
   run goes to the pick's partition, once for equal runs of a partition: the others know then that
   all their windows stand in a smaller document.
3. There, runs whose bytes are equal (compared, not only their hashes) are settled by the smallest id; the rest of
   a pick's windows are sorted as suffixes by most-significant-digit passes of eight bytes. Groups that stay equal through the last
   pass are exactly the repeated windows, and the smallest id in a group keeps its bytes.

So what moves is bounded by the number of picks (about one in 18 bytes) and the text under shared
ones. Equal runs are merged before each shuffle, so a passage that a third of all documents hold is sent
once by each partition. Null texts are empty; documents under ``DEPTH`` bytes lose nothing; of rows
with the same id none is smaller than another, and each is cut by what smaller ids hold; null ids lose nothing. Very long
texts are taken whole; an empty table gives an empty result; other columns are not read, and ``without_repeats`` hands them on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.common import SpanHash, documents, mix64

DEPTH, GRAM = 50, 16
#: Bytes of text that a worker looks at together.
BLOCK = 8_000_000
#: Picks whose windows are sorted together.
SORT_BLOCK = 200_000
_LOW32 = np.uint64(0xFFFFFFFF)


def picks(data: bytes, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, SpanHash]:
    """Runs of consecutive windows with one pick: first window, last window, place and hash of the pick."""
    h = SpanHash(data)
    at = np.arange(len(data) - gram + 1)
    full = h(at, at + gram)
    key = (full & ~_LOW32) | at.astype(np.uint64)
    width, span = depth - gram + 1, 1
    low = key
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    n = len(data) - depth + 1
    low = np.minimum(low[:n], low[width - span : width - span + n])
    place = (low & _LOW32).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:] - 1, n - 1)
    return first, last, place[first], full[place[first]], h


def radix_groups(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Group of each suffix after sorting within ``groups`` through ``depth`` bytes; -1 where no other suffix is equal.

    Each pass sorts what is still tied by its next eight bytes; what is alone leaves.
    """
    out = np.full(len(starts), -1, np.int64)
    live, group = np.arange(len(starts)), groups
    words = np.ndarray(max(0, len(data) - 7), ">u8", data, 0, (1,))
    at = 0
    while True:
        digit = words[starts[live] + at].astype(np.uint64)
        order = np.lexsort((digit, group))
        live, group, digit = live[order], group[order], digit[order]
        new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])) if len(live) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        alone = np.bincount(number)[number] == 1 if len(live) else np.zeros(0, bool)
        live, group = live[~alone], number[~alone]
        if at == depth - 8 or not len(live):
            out[live] = group
            return out
        at = min(at + 8, depth - 8)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _blocks(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(columns))):
            data = _bytes(row[1])
            block.append((row[0], data, *row[2:]))
            size += len(data)
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def _batch(names: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, names)], [n for n, _ in names])


_MARKS = [("part", pa.int32()), ("docs", pa.binary()), ("marks", pa.binary()), ("known", pa.bool_())]
#: gram, key, doc, start, rel and signed size of each run (see _pack_runs), and the text.
_TELL = [("home", pa.int32()), ("docs", pa.binary()), ("marks", pa.binary())]
_TOLD = [("doc_id", pa.int64()), ("shared", pa.binary())]
_RUNS = [("part", pa.int32()), ("settled", pa.bool_()), ("runs", pa.binary()), ("text", pa.binary())]
_FOUND = [("home", pa.int32()), ("docs", pa.binary()), ("spans", pa.binary())]
_SPANS = [("doc_id", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())]
_ddl = lambda names: ", ".join(f"{n} {({'int32': 'int', 'int64': 'long', 'binary': 'binary', 'bool': 'boolean'})[str(t)]}" for n, t in names)


def _runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[head], np.diff(np.append(head, len(values)))


def _pack_docs(d: np.ndarray) -> bytes:
    """Document ids that come in runs."""
    ids, n = _runs_of(d)
    return np.concatenate([ids.astype(np.int64), n.astype(np.int64)]).tobytes()


def _unpack_docs(b: bytes) -> np.ndarray:
    ids, n = np.frombuffer(b, np.int64).reshape(2, -1)
    return np.repeat(ids, n)


#: Planes of a packed run.
_PLANES = [np.dtype(t) for t in ("<u8", "<u8", "<i8", "<i4", "<u1", "<i4")]


def _pack_runs(*planes: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(p.astype(t).tobytes() for p, t in zip(planes, _PLANES)), 1)


def _unpack_runs(b: bytes) -> list[np.ndarray]:
    b = zstandard.decompress(b)
    n, at, out = len(b) // sum(t.itemsize for t in _PLANES), 0, []
    for t in _PLANES:
        x = np.frombuffer(b, t, n, at)
        out.append(x if t.kind == "u" and t.itemsize == 8 else x.astype(np.int64))
        at += n * t.itemsize
    return out


def _sorted_marks(full: np.ndarray) -> np.ndarray:
    """40 bits of the picks' hashes, once each."""
    return np.unique(full >> np.uint64(24))


def _pack40(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack40(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _send_marks(parts: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, 2):
            docs, marks = [], []
            for doc, data in block:
                if doc is None or len(data) < depth:
                    continue
                m = _sorted_marks(picks(data, depth)[3])
                docs.append(np.full(len(m), doc, np.int64))
                marks.append(m)
            if not docs:
                continue
            d, m = np.concatenate(docs), np.concatenate(marks)
            order = np.lexsort((d, m))
            d, m = d[order], m[order]
            new = np.append(True, m[1:] != m[:-1])
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(m)))
            tail = head + count - 1
            several = d[tail] != d[head]
            # What two documents of the block share is known; the mark's partition hears of one document and that fact.
            k = np.repeat(several, count) & ~new
            rows = []
            for flag, hits in ((False, head[~several]), (True, head[several])):
                dest = (m[hits] % np.uint64(parts)).astype(np.int64)
                o = np.argsort(dest, kind="stable")
                hits, dest = hits[o], dest[o]
                for p, a, b in _cuts(dest):
                    x = np.sort(hits[a:b])
                    x = x[np.argsort(d[x], kind="stable")]
                    rows.append((p, _pack_docs(d[x]), _pack40(m[x]), flag))
            # Known marks ride along, to be told to their documents.
            x = np.flatnonzero(k)
            if len(x):
                x = x[np.argsort(d[x], kind="stable")]
                rows.append((int(d[x[0]] % parts), _pack_docs(d[x]), _pack40(m[x]), None))
            yield _batch(_MARKS, rows)

    return run


def _cuts(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(sorted_keys):
        head = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
        for a, b in zip(head, np.append(head[1:], len(sorted_keys))):
            yield int(sorted_keys[a]), int(a), int(b)


def _homes(d: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(home, rows sorted by document) of each home of the documents ``d``."""
    order = np.lexsort((d, d % parts))
    for home, a, b in _cuts((d % parts)[order]):
        yield home, order[a:b]


def _tell(d: np.ndarray, m: np.ndarray, parts: int) -> list[tuple]:
    """One row for each home of the documents."""
    return [(home, _pack_docs(d[x]), zstandard.compress(_pack40(m[x]), 1)) for home, x in _homes(d, parts)]


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At home: what all partitions told of a document, in one row."""
    docs, marks = [], []
    for b in batches:
        docs += map(_unpack_docs, b.column(1).to_pylist())
        marks += [_unpack40(zstandard.decompress(x)) for x in b.column(2).to_pylist()]
    if not docs:
        return
    d, m = np.concatenate(docs), np.concatenate(marks)
    del docs, marks
    order = np.argsort(d, kind="stable")
    d, m = d[order], m[order]
    rows = [(doc, _pack40(m[a:b])) for doc, a, b in _cuts(d)]
    for at in range(0, len(rows), 20_000):
        yield _batch(_TOLD, rows[at : at + 20_000])


def _share_marks(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, marks, flags, known = [], [], [], []
        for batch in batches:
            for d, m, flag in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                d, m = _unpack_docs(d), _unpack40(m)
                if flag is None:
                    known.append((d, m))
                else:
                    docs.append(d)
                    marks.append(m)
                    flags.append(np.full(len(d), flag))
        if docs:
            d, m, f = np.concatenate(docs), np.concatenate(marks), np.concatenate(flags)
            del docs, marks, flags
            order = np.argsort(m, kind="stable")
            d, m, f = d[order], m[order], f[order]
            head = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
            count = np.diff(np.append(head, len(m)))
            shared = np.logical_or.reduceat(f, head) | (np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head))
            on = np.repeat(shared, count)
            known.append((d[on], m[on]))
        if known:
            yield _batch(_TELL, _tell(np.concatenate([x[0] for x in known]), np.concatenate([x[1] for x in known]), parts))

    return run


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes (eight at least) at ``a`` and at ``b`` are equal."""
    words = np.ndarray(max(0, len(data) - 7), "<u8", data, 0, (1,))
    n = (size + 7) // 8
    which = np.repeat(np.arange(len(a)), n)
    inside = np.minimum(8 * (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)), size[which] - 8)
    differ = words[a[which] + inside] != words[b[which] + inside]
    return np.bincount(which[differ], minlength=len(a)) == 0


def _send_runs(parts: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, 3):
            doc, first, rel, size, gram, key, src = [], [], [], [], [], [], []
            base = np.cumsum([0, *[len(x[1]) for x in block[:-1]]])
            for k, (d, data, told) in enumerate(block):
                if not told or d is None or len(data) < depth:
                    continue
                a, b, place, full, h = picks(data, depth)
                on = np.isin(full >> np.uint64(24), _unpack40(told))
                a, b, place, full = a[on], b[on], place[on], full[on]
                doc.append(np.full(len(a), d, np.int64))
                first.append(a)
                rel.append(place - a)
                size.append(b - a + depth)
                gram.append(full)
                # The pick's place is part of a run's identity: the same text could be cut differently.
                key.append(h(a, b + depth) ^ ((place - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                src.append(np.full(len(a), k))
            if not doc:
                continue
            doc, first, rel, size, gram, key, src = map(np.concatenate, (doc, first, rel, size, gram, key, src))
            order = np.lexsort((doc, key))
            doc, first, rel, size, gram, key, src = (x[order] for x in (doc, first, rel, size, gram, key, src))
            new = np.append(True, key[1:] != key[:-1])
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(key)))
            settled = doc > np.repeat(doc[head], count)
            # Equal keys settle nothing before the bytes have been compared; a run that only looked equal goes its own way.
            whole = np.frombuffer(b"".join([x[1] for x in block]), np.uint8)
            at = base[src] + first
            x = np.flatnonzero(~new)
            lead = np.repeat(head, count)
            odd = x[~_same_bytes(whole, at[x], at[lead[x]], size[x])]
            key[odd] = mix64(odd.astype(np.uint64) ^ key[odd])
            new[odd], settled[odd] = True, False
            rows = []
            x = np.flatnonzero(settled)
            if len(x):
                # Settled runs ride along as plain spans.
                x = x[np.lexsort((first[x], doc[x]))]
                none = np.zeros(len(x))
                rows.append((int(doc[x[0]] % parts), True, _pack_runs(none, none, doc[x], first[x], none, size[x]), b""))
            x = np.flatnonzero(~settled)
            dest = (gram[x] % np.uint64(parts)).astype(np.int64)
            o = np.argsort(dest, kind="stable")
            x, dest = x[o], dest[o]
            for p, a, b in _cuts(dest):
                y = x[a:b]
                y = y[np.lexsort((first[y], doc[y], ~new[y]))]
                text = b"".join(block[s][1][f : f + z] if n else b"" for s, f, z, n in zip(src[y].tolist(), first[y].tolist(), size[y].tolist(), new[y].tolist()))
                rows.append((p, False, _pack_runs(gram[y], key[y], doc[y], first[y], rel[y], size[y] * np.where(new[y], 1, -1)), zstandard.compress(text, 3)))
            yield _batch(_RUNS, rows)

    return run


def _tell_spans(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each home, with the union of what was found of its documents here."""
    if found:
        doc, start, end = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        rows = []
        for home, x in _homes(doc, parts):
            ids, s, e = [], [], []
            for d, a, b in _cuts(doc[x]):
                p, q = merged(start[x[a:b]], end[x[a:b]])
                ids.append(np.full(len(p), d, np.int64))
                s.append(p)
                e.append(q)
            rows.append((home, _pack_docs(np.concatenate(ids)), zstandard.compress(np.concatenate([*s, *e]).tobytes(), 1)))
        yield _batch(_FOUND, rows)


def _home_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At home: a row for each document, with the union of what was found of it anywhere."""
    docs, starts, ends = [], [], []
    for b in batches:
        for d, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            s, e = np.frombuffer(zstandard.decompress(x), np.int64).reshape(2, -1)
            docs.append(_unpack_docs(d))
            starts.append(s)
            ends.append(e)
    if not docs:
        return
    d, s, e = map(np.concatenate, (docs, starts, ends))
    order = np.argsort(d, kind="stable")
    d, s, e = d[order], s[order], e[order]
    rows = []
    for doc, a, b in _cuts(d):
        p, q = merged(s[a:b], e[a:b])
        rows.append((doc, p.tobytes(), q.tobytes()))
    for at in range(0, len(rows), 20_000):
        yield _batch(_SPANS, rows[at : at + 20_000])


def _confirmed(data: np.ndarray, gram: np.ndarray, key: np.ndarray, size: np.ndarray, off: np.ndarray, sent: np.ndarray) -> np.ndarray:
    """Keys under which only runs with equal bytes stand together; runs without a text of their own follow the one they were sent with."""
    has = np.flatnonzero(off >= 0)
    order = has[np.lexsort((key[has], gram[has]))]
    lead = order[np.maximum.accumulate(np.where(np.append(True, (gram[order][1:] != gram[order][:-1]) | (key[order][1:] != key[order][:-1])), np.arange(len(order)), 0))]
    alike = size[order] == size[lead]
    alike[alike] = _same_bytes(data, off[order[alike]], off[lead[alike]], size[order[alike]])
    if alike.all():
        return key
    key = key.copy()
    for k in order[~alike].tolist():
        key[(sent == sent[k]) & (key == key[k]) & (gram == gram[k])] = mix64(np.array([(sent[k] << 40) ^ k], np.uint64))[0]
    return key


def _sort_runs(parts: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(8)]
        texts, base = [], 0
        # A document's spans of this partition are told in one row.
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for settled, packed, text in zip(*(batch.column(k).to_pylist() for k in range(1, 4))):
                gram, key, doc, start, rel, size = _unpack_runs(packed)
                if settled:
                    found.append((doc, start.astype(np.int32), (start + size).astype(np.int32)))
                    continue
                text = zstandard.decompress(text) if text else b""
                has = size > 0
                size = np.abs(size)
                off = np.where(has, base + np.cumsum(size * has) - size * has, -1)
                for c, v in zip(cols, (gram, key, doc, start, rel, size, off, np.full(len(doc), len(texts)))):
                    c.append(v)
                texts.append(text)
                base += len(text)
        if not texts:
            yield from _tell_spans(found, parts)
            return
        gram, key, doc, start, rel, size, off, sent = map(np.concatenate, cols)
        del cols
        data = np.frombuffer(b"".join(texts), np.uint8)
        del texts
        key = _confirmed(data, gram, key, size, off, sent)
        order = np.lexsort((doc, key, gram))
        gram, key, doc, start, rel, size, off = (x[order] for x in (gram, key, doc, start, rel, size, off))
        new = np.append(True, (gram[1:] != gram[:-1]) | (key[1:] != key[:-1]))
        head = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        least = doc[head]
        place = np.maximum.reduceat(off, head)
        x = np.flatnonzero(doc > least[number])
        if len(x):
            found.append((doc[x], start[x], start[x] + size[x]))
        # Distinct runs of a pick, where there are several, are compared window by window.
        g = gram[head]
        pick = np.cumsum(np.append(True, g[1:] != g[:-1])) - 1
        many = np.bincount(pick)[pick] > 1
        todo = np.flatnonzero(many)
        # Rows whose document is the smallest of its run wait for the outcome (the others are settled).
        owners = np.flatnonzero(doc == least[number])
        at = 0
        while at < len(todo):
            stop = min(at + SORT_BLOCK, len(todo))
            while stop < len(todo) and pick[todo[stop]] == pick[todo[stop - 1]]:
                stop += 1
            r = todo[at:stop]
            at = stop
            z = size[head[r]] - depth + 1
            which = np.repeat(np.arange(len(r)), z)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(z) - z, z)
            # Equal windows have their pick at the same place.
            group = pick[r][which] * depth + (rel[head[r]][which] - inside)
            same = radix_groups(data, place[r][which] + inside, group, depth)
            ok = np.flatnonzero(same >= 0)
            if not len(ok):
                continue
            low = np.full(same.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, same[ok], least[r][which[ok]])
            hit = ok[least[r][which[ok]] > low[same[ok]]]
            if not len(hit):
                continue
            # Back to every row of the run that still waits.
            lo, hi = np.searchsorted(number[owners], r[which[hit]], "left"), np.searchsorted(number[owners], r[which[hit]], "right")
            times = hi - lo
            rows = owners[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            s = start[rows] + np.repeat(inside[hit], times)
            found.append((doc[rows], s, s + depth))
        yield from _tell_spans(found, parts)

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, s[1:] > e[:-1])
    head = np.flatnonzero(new)
    return s[head], e[np.append(head[1:] - 1, len(s) - 1)]


def repeated_spans(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, starts, ends): maximal spans of bytes to remove, packed; only documents that have some.

    What goes from one set of partitions to the next is one packed row for each pair of partitions, whatever the number of documents.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Several numbers for each partition, so that hashing them again deals them evenly.
    parts *= 4
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    marks = texts.mapInArrow(_send_marks(parts, depth), _ddl(_MARKS))
    told = marks.repartition("part").mapInArrow(_share_marks(parts), _ddl(_TELL)).repartition("home").mapInArrow(_told, _ddl(_TOLD))
    # A left join, like the last one, so that both can read one exchange of the texts.
    runs = texts.join(told, "doc_id", "left").select("doc_id", "text", "shared").mapInArrow(_send_runs(parts, depth), _ddl(_RUNS))
    found = runs.repartition("part").mapInArrow(_sort_runs(parts, depth), _ddl(_FOUND))
    return found.repartition("home").mapInArrow(_home_spans, _ddl(_SPANS))


def _spans(starts: bytes | None, ends: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(starts or b"", np.int64), np.frombuffer(ends or b"", np.int64)


def cut(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    out, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def remove_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per row: bytes, removed bytes, maximal removed runs, digest of what is left, and the rest as a string."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    both = texts.join(repeated_spans(docs, depth), "doc_id", "left").select("doc_id", "text", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, runs, sha = [], [], [], []
            for text, starts, ends in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                data = _bytes(text)
                s, e = _spans(starts, ends)
                n.append(len(data))
                removed.append(int((e - s).sum()))
                runs.append(len(s))
                sha.append(hashlib.sha256(cut(data, s, e)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans shrunk to whole UTF-8 characters, so that what is left is a text."""
    b = np.append(np.frombuffer(data, np.uint8), 0)
    starts, ends = starts.copy(), ends.copy()
    for _ in range(3):
        starts += (b[starts] & 0xC0) == 0x80
        ends -= (b[ends] & 0xC0) == 0x80
    on = ends > starts
    return starts[on], ends[on]


def without_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text`` and ``n_chars`` (where there is one) counted anew.

    Its own columns in their order; a null text stays null. Rows that lose nothing keep what they have.
    """
    spans = repeated_spans(docs, depth).withColumnRenamed("doc_id", "_span_doc")
    both = docs.join(spans, docs["doc_id"] == spans["_span_doc"], "left").select(*[docs[c] for c in docs.columns], spans["starts"].alias("_starts"), spans["ends"].alias("_ends"))
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, starts, ends = (b.column(k).to_pylist() for k in (at, b.num_columns - 2, b.num_columns - 1))
            for k, x in enumerate(starts):
                if x and texts[k] is not None:
                    data = _bytes(texts[k])
                    texts[k] = cut(data, *whole_characters(data, *_spans(x, ends[k]))).decode("utf-8", "surrogatepass")
            columns = [b.column(k) for k in range(b.num_columns - 2)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-2])

    out = both.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(schema["n_chars"].dataType), F.col("n_chars")))
    return out


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
h AS (SELECT doc_id, hex(b) AS x, n FROM d),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM h WHERE n >= 50)),
m AS (SELECT g, min(doc_id) AS lo FROM w GROUP BY g HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, i FROM w JOIN m USING (g) WHERE doc_id > lo),
gap AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM gap) GROUP BY doc_id, r),
parts AS (SELECT doc_id, s, e, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS nxt FROM spans),
kept AS (SELECT h.doc_id, string_agg(substr(x, 2 * p.a + 1, 2 * (p.z - p.a)), '' ORDER BY p.a) AS k FROM h JOIN (
           SELECT doc_id, e AS a, nxt AS z FROM parts UNION ALL SELECT doc_id, 0, min(s) FROM parts GROUP BY doc_id) q ON q.doc_id = h.doc_id, LATERAL (SELECT q.a AS a, coalesce(q.z, h.n) AS z) p GROUP BY h.doc_id)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, coalesce(r.removed, 0)::BIGINT AS n_removed, coalesce(r.c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.k, h.x))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(e - s) AS removed, count(*) AS c FROM spans GROUP BY doc_id) r USING (doc_id)
"""
