"""Operator 5: near duplicates by MinHash, banding, verification and star components.

A text's set holds its distinct runs of ``words`` words (a shorter text's whole sequence is its only
one). Texts with equal sets (by a 128-bit digest of the whole set) form a class and only the smallest id
of each goes on. Signatures are the minima of many universal hashes, cut into bands; equal bands propose
links. A pair at the threshold is missed by all bands with a probability of 3e-6 at 80 percent and 7e-9 at 85.

All texts that share a bucket whose smallest id is u form the star of u. A star goes to one task if its sets hold up to
``STAR`` shingles together, else it is dealt over several, each with u. In a task, overlaps on full sets are counted by an
inverted index: u against all, then each text that is not yet in the component of most, so dense groups take
one count and no pair is ever a row. Only links that join two components leave the task, fewer than it
has texts. In dealt stars, what is still not in u's component is then compared, as a query set, with the other parts in blocks.
So no link between texts of a bucket is lost. Texts come to stars by a sorted join at every size, so the plan that small tables test is the one that large ones run. Components are found by alternating large-star and small-star.

Null texts, empty texts and texts without words have an empty set and are linked with nothing; very long texts are
taken whole; an empty table gives an empty result; columns besides the id and the text are not read. Rows with the
same id are one document, linked by each of its texts; a row's n_shingles is that of its own text. A null
id is linked with nothing and kept. A tie for a component's name can't be: it is the smallest id.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.common import SpanHash, documents, materialise

#: The pipeline's contract; the query op5 has its own.
WORDS, PERCENT = 5, 80
BANDS, ROWS = 32, 5
#: Shingles of the texts that one task compares with one another.
STAR = 1_000_000


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words."""
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not data:
        return np.zeros(0, np.uint64)
    ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))
    begins = np.append(0, ends[:-1] + 1)
    k = min(words, len(ends))
    return np.unique(SpanHash(data)(begins[: len(ends) - k + 1], ends[k - 1 :]))


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32 high bits of the minimum of each hash ``a * x + b`` modulo 2**64."""
    low = np.full(len(a), np.uint64((1 << 64) - 1))
    for at in range(0, len(s), 2048):
        np.minimum(low, (s[at : at + 2048, None] * a + b).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    a, b = _multipliers(BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                key.append(None if not len(s) else hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(None if not len(s) else signature(s, a, b).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "set_key", "sig"])

    return docs.mapInArrow(run, "doc_id long, n long, set_key binary, sig binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(bucket, doc_id, n): a row for each band; the bucket is a hash of the band's number and minima."""
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.expr("sig").substr(i * 4 * ROWS + 1, F.lit(4 * ROWS))))
    return reps.select(F.explode(band).alias("bucket"), "doc_id", "n")


class Overlaps:
    """Sizes of the intersections of a set with all sets of a group, by an inverted index."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        self.words, place = np.unique(np.concatenate(sets), return_inverse=True)
        self.df = np.bincount(place, minlength=len(self.words))
        self.owner = np.repeat(np.arange(len(sets)), self.n)[np.argsort(place, kind="stable")]
        self.first = np.cumsum(self.df) - self.df

    def __call__(self, s: np.ndarray, least: int = 1) -> np.ndarray:
        """Words that fewer than ``least`` sets have are left out: 2 for a member, which needs no count with itself."""
        at = np.minimum(np.searchsorted(self.words, s), len(self.words) - 1)
        at = at[(self.words[at] == s) & (self.df[at] >= least)]
        df = self.df[at]
        return np.bincount(self.owner[np.repeat(self.first[at] - np.cumsum(df) + df, df) + np.arange(df.sum())], minlength=len(self.n))

    def linked(self, s: np.ndarray, percent: int, least: int = 1) -> np.ndarray:
        both = self(s, least)
        return np.flatnonzero(100 * both >= percent * (len(s) + self.n - both))


def forest(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links, confirmed on the full sets, that join the same texts as all links between the sets do; the first text's come first."""
    own = Overlaps(sets)
    top = list(range(len(ids)))

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = k = top[top[k]]
        return k

    seen: dict[int, int] = {}
    for k, i in enumerate(ids):
        top[k] = seen.setdefault(i, k)
    out = []

    def ask(q: int) -> None:
        for k in own.linked(sets[q], percent, 2).tolist():
            a, b = root(q), root(k)
            if a != b:
                top[b] = a
                out.append((ids[q], ids[k]))

    ask(0)
    main = Counter(map(root, range(len(ids)))).most_common(1)[0][0]
    for q in range(1, len(ids)):
        if root(q) != root(main):
            ask(q)
    return out


_STAR = ["u", "part", "v", "query", "c", "text"]


def _stars(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows (v, c, set) of each (u, part, query): the texts of a group in one list, its queries after them in lists of a bounded size."""
    key, rows, size = None, [], 0
    for b in batches:
        for u, part, v, query, c, text in zip(*(b.column(k).to_pylist() for k in range(6))):
            if (u, part, query) != key or (query and size > STAR):
                if rows:
                    yield key, rows
                key, rows, size = (u, part, query), [], 0
            s = shingles(text, words)
            if len(s):
                rows.append((v, c, s))
                size += len(s)
    if rows:
        yield key, rows


def _compared(placed: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) within the groups (u, part) of ``placed`` (v, c: component or null, query); where there are queries, only theirs with other components."""
    # The plan is the same at every size: the texts are dealt by id, however few are asked for.
    rows = placed.hint("merge").join(texts.select(F.col("doc_id").alias("v"), "text"), "v").select(*_STAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        group, members, index = None, [], None
        for (u, part, query), found in _stars(batches, words):
            if query is None:
                # The centre first, then by id; a row that repeats an id and its set adds nothing.
                found = list({(v, s.tobytes()): (v, s) for v, _, s in sorted(found, key=lambda x: (x[0] != u, x[0]))}.values())
                links += forest([v for v, _ in found], [s for _, s in found], percent)
            elif not query:
                group, members = (u, part), found
                index = Overlaps([s for _, _, s in found])
            elif group == (u, part):
                for v, c, s in found:
                    new: dict[int, int] = {}
                    for k in index.linked(s, percent).tolist():
                        if members[k][1] != c:
                            new.setdefault(members[k][1], members[k][0])
                    links += [(v, x) for x in new.values()]
            if len(links) > 20_000:
                yield _links(links)
                links = []
        yield _links(links)

    return rows.repartition("u", "part").sortWithinPartitions("u", "part", "query").mapInArrow(run, "u long, v long")


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of undirected links (u, v): alternating large-star and small-star; the component is the smallest node."""
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))

    def large(e: DataFrame) -> DataFrame:
        # Each node links its larger neighbours to the smallest of its neighbourhood.
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return near.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        # Each node links its smaller neighbours and itself to the smallest of them.
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v")))

    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    before = None
    while True:
        edges = materialise(small(large(edges)).where("u <> v").distinct())
        now = tuple(mark(edges))
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sketch = materialise(_sketches(texts, words))
    # Equal sets: one class, with its smallest id. Partial minima keep a large class small.
    classes = materialise(sketch.where("set_key is not null and doc_id is not null").groupBy("set_key", "n").agg(F.min("doc_id").alias("first")))
    named = materialise(sketch.select("doc_id", "n", "set_key").join(classes, ["set_key", "n"], "left").select("doc_id", "n", "first"))
    chosen = sketch.join(classes.withColumnRenamed("first", "doc_id"), ["doc_id", "set_key", "n"]).dropDuplicates(["doc_id", "set_key"]).select("doc_id", "n", "sig")
    members = materialise(_bands(chosen))
    # Buckets of one text propose nothing.
    tops = members.groupBy("bucket").agg(F.min("doc_id").alias("u"), F.max("doc_id").alias("other")).where("u <> other").select("bucket", "u")
    stars = materialise(members.join(tops, "bucket").where("doc_id <> u").groupBy("u", F.col("doc_id").alias("v")).agg(F.max("n").alias("n")))
    sizes = stars.groupBy("u").agg(F.ceil(F.sum("n") / STAR).cast("int").alias("parts"))
    dealt = materialise(stars.join(sizes, "u").select("u", "v", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"), "parts"))
    nothing = [F.lit(None).cast("boolean").alias("query"), F.lit(None).cast("long").alias("c")]
    centres = sizes.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("u").alias("v"), *nothing)
    links = _compared(dealt.select("u", "part", "v", *nothing).unionByName(centres), texts, words, percent)
    # An id with several texts stands in several classes.
    several = named.where("first is not null").groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a <> b").select("doc_id")
    links = materialise(links.unionByName(named.join(several, "doc_id").where("first is not null").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))))
    found = components(links)
    wide = dealt.where("parts > 1")
    if not wide.isEmpty():
        of = lambda k: found.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
        known = materialise(wide.join(of("v"), "v", "left").join(of("u"), "u", "left").select("u", "v", "part", "parts", F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("c")))
        asked = known.where("c <> cu").select("u", F.explode(F.expr("filter(sequence(0, parts - 1), p -> p <> part)")).alias("part"), "v", F.lit(True).alias("query"), "c")
        more = _compared(known.select("u", "part", "v", F.lit(False).alias("query"), "c").unionByName(asked), texts, words, percent)
        found = components(links.unionByName(more))
    component = F.coalesce("component", "first", "doc_id")
    out = named.join(found, F.col("first") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group (the smallest id); ``docs``'s own columns only."""
    drop = near_duplicates(docs, words, percent).where("not kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["_dropped"], "left_anti")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
few AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
sh AS (SELECT s.* FROM s SEMI JOIN few USING (g)),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
e AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, e.v FROM reach JOIN e ON e.u = reach.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
