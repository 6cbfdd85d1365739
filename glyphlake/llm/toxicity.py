"""Operator 6: toxicity by subword-bag embeddings.

A word is the mean of the vectors of its hashed character n-grams (and of itself), a text is the mean
of its words (a text of fewer than ``SHORT`` words counts as so many), and a linear softmax over that mean gives the
classes' probabilities: the score is the second one's. Vectors and softmax are trained jointly in numpy. Misspellings share
most n-grams with what was seen. As the mean is linear, scoring adds up a number for each word.

Training takes a bounded sample of labelled rows, whole: of each class the ``PER_CLASS`` rows with the
smallest digest of their id, outside the held-out fold. Four of five are fitted, in ``EPOCHS`` passes
whatever their number; the fifth sets the softmax's bias, so that 0.5 tells the classes apart best. All rows are scored, over their whole texts.
The sample's texts stay with the executors, whatever their length: the driver gets how many texts have each bucket, then each text's weights of the
buckets that are used, a bounded part at a time, and keeps them in a file. Of rows that repeat a labelled id, the text with the smallest digest is taken.

Null and empty texts have no words and the score of the bias alone, a clean one; very long texts are taken whole; an empty
table gives an empty result; without labels of both classes every text is clean. Repeated rows get equal
scores; labels that disagree on an id are all taken. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import math
import tempfile
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.common import discard, documents, materialise

#: Bound of the training sample: labelled rows of each class.
PER_CLASS = 1_500
DIM, BUCKETS, GRAMS = 8, 1 << 17, (3, 4, 5, 6)
#: Fitting: passes, AdaGrad's rate, factor of the mean, words that a shorter text counts as.
EPOCHS, RATE, SCALE, SHORT = 12, 0.1, 100.0, 40
#: Length that a vector loses in each step, as a share of the rate.
SHRINK = 0.02
#: A bucket is used if the shares of the two classes' training texts that have it differ by so many standard errors.
APART = 5.0
#: Cost of a clean row rejected, in toxic rows missed (as shares of their class).
FALSE_ALARM = 3.0
MEMORY = 300_000
#: Bytes of the longest word that is remembered; n-grams that are counted at once; bytes of weights that the driver gets at once.
LONGEST, PIECE, PART = 100, 1 << 16, 1 << 24


def grams(word: bytes) -> list[int]:
    """Buckets of a word's character n-grams and of the whole word."""
    text = f"<{word.decode('utf-8', 'replace')}>"
    out = [zlib.crc32(text.encode()) % BUCKETS]
    for n in GRAMS:
        out += [zlib.crc32(text[i : i + n].encode()) % BUCKETS for i in range(len(text) - n + 1)]
    return out


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without the punctuation around them."""
    raw = (text or "").lower().encode("utf-8", "replace").split()
    return [w.strip(b".,;:!?*$%&#|\"'()<>[]") or w for w in raw]


def gram_counts(word: bytes) -> np.ndarray:
    """How often ``grams`` has each bucket, for words of any length."""
    text = f"<{word.decode('utf-8', 'replace')}>"
    out = np.zeros(BUCKETS)
    out[zlib.crc32(text.encode()) % BUCKETS] = 1
    for n in GRAMS:
        for at in range(0, len(text) - n + 1, PIECE):
            out += np.bincount([zlib.crc32(text[i : i + n].encode()) % BUCKETS for i in range(at, min(at + PIECE, len(text) - n + 1))], minlength=BUCKETS)
    return out


Bag = tuple[np.ndarray, np.ndarray]


def bag(text: str | None, known: dict[bytes, np.ndarray]) -> Bag | None:
    """The buckets of a text and their weights in the scaled mean of its words, None without words; ``known`` remembers words."""
    words = tokens(text)
    if not words:
        return None
    total, of, share, size = np.zeros(BUCKETS), [], [], 0

    def add() -> None:
        if of:
            total[:] += np.bincount(np.concatenate(of), np.repeat(share, [len(g) for g in of]), minlength=BUCKETS)

    for word, n in Counter(words).items():
        if len(word) > PIECE:
            c = gram_counts(word)
            total += c * (n / c.sum())
            continue
        g = known.get(word)
        if g is None:
            g = np.array(grams(word), np.int32)
            if len(word) <= LONGEST:
                if len(known) >= MEMORY // 4:  # an array for each word
                    known.clear()
                known[word] = g
        of.append(g)
        share.append(n / len(g))
        size += len(g)
        if size > PIECE:
            add()
            of, share, size = [], [], 0
    add()
    u = np.flatnonzero(total)
    return u.astype(np.int32), (total[u] * (SCALE / max(SHORT, len(words)))).astype(np.float32)


def only(b: Bag | None, used: np.ndarray) -> Bag | None:
    return b and (b[0][on := used[b[0]]], b[1][on])


def telling(having: np.ndarray, n: Sequence[int]) -> np.ndarray:
    """The buckets in use, given how many of the ``n`` texts of each class have each; others would only be learnt by heart."""
    share = having / np.array(n)[:, None]
    both = having.sum(axis=0) / sum(n)
    error = np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
    return np.abs(share[1] - share[0]) > APART * np.maximum(error, 1e-9)


class Model:
    """Embeddings (BUCKETS x DIM) and a softmax (DIM x 2, with biases)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-0.1 / DIM, 0.1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.softmax = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
        self.bias = np.array([0.5, -0.5], np.float32)
        self.memory: dict[bytes, float] = {}

    def word_score(self, word: bytes) -> float:
        """A word's part of the log odds."""
        got = self.memory.get(word)
        if got is None:
            if len(word) > PIECE:
                c = gram_counts(word)
                return float(c / c.sum() @ self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0]))
            got = float(self.vectors[grams(word)].mean(axis=0) @ (self.softmax[:, 1] - self.softmax[:, 0]))
            if len(word) <= LONGEST:
                if len(self.memory) >= MEMORY:
                    self.memory.clear()
                self.memory[word] = got
        return got

    def log_odds(self, text: str | None) -> float:
        """Difference of the softmax's two inputs for the mean of the words."""
        words = tokens(text)
        known, new = self.memory.get, self.word_score
        total = sum([x if (x := known(w)) is not None else new(w) for w in words])
        return SCALE * total / max(SHORT, len(words)) + float(self.bias[1] - self.bias[0])

    def probability(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.log_odds(text)))))

    def fit(self, texts: list[str | None], labels: list[int], epochs: int = EPOCHS) -> Model:
        """Joint AdaGrad on vectors and softmax, one text at a time; both classes weigh the same."""
        n, having, known = len(labels), np.zeros((2, BUCKETS)), {}
        if not 0 < sum(labels) < n:
            return self
        bags = [bag(t, known) for t in texts]
        for b, label in zip(bags, labels):
            if b:
                having[label, b[0]] += 1
        used = telling(having, (n - sum(labels), sum(labels)))
        return self.fit_bags([only(b, used) for b in bags], labels, used, epochs)

    def fit_bags(self, bags: Sequence[Bag | None], labels: list[int], used: np.ndarray, epochs: int = EPOCHS) -> Model:
        """The same on the texts' bags of the buckets in use; the others keep a zero vector."""
        n = len(labels)
        rng = np.random.default_rng(11)
        self.vectors[~used] = 0
        weight = {1: 0.5 * n / sum(labels), 0: 0.5 * n / (n - sum(labels))}
        seen_v, seen_s, seen_b = np.full(self.vectors.shape, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            for k in rng.permutation(n):
                b = bags[k]
                if b is None:
                    continue
                g, w = b
                rows, squares = self.vectors.take(g, axis=0), seen_v.take(g, axis=0)
                h = w @ rows
                z = h @ self.softmax + self.bias
                q = np.exp(z - z.max())
                q /= q.sum()
                q[labels[k]] -= 1
                q *= weight[labels[k]]
                grad_h, grad_s = self.softmax @ q, np.outer(h, q)
                seen_s += grad_s**2
                seen_b += q**2
                self.softmax -= rate * grad_s / np.sqrt(seen_s)
                self.bias -= rate * q / np.sqrt(seen_b)
                grad_v = w[:, None] * grad_h
                squares += grad_v * grad_v
                seen_v[g] = squares
                rows -= rate * grad_v / np.sqrt(squares)
                # Vectors are shortened by a constant length, so only those that keep being asked for stay.
                length = np.sqrt(np.einsum("ij,ij->i", rows, rows)) + 1e-9
                self.vectors[g] = rows * np.maximum(0, 1 - rate * SHRINK / length)[:, None]
        self.memory.clear()
        return self

    def calibrate(self, texts: list[str | None], labels: list[int]) -> Model:
        """Set the bias by rows that weren't fitted."""
        return self.set_bias([self.log_odds(t) for t in texts], labels)

    def bag_odds(self, b: Bag | None) -> float:
        """``log_odds`` of a bag of the buckets in use."""
        mean = 0.0 if b is None else b[1].astype(np.float64) @ (self.vectors[b[0]] @ (self.softmax[:, 1] - self.softmax[:, 0]))
        return float(mean) + float(self.bias[1] - self.bias[0])

    def set_bias(self, log_odds: list[float], labels: list[int]) -> Model:
        """Set the bias so that even odds stand where the classes are told apart best, in the middle of the gap; an empty text stays clean."""
        if not 0 < sum(labels) < len(labels):
            return self
        z = np.array(log_odds)
        y = np.array(labels)
        order = np.argsort(z)
        z, y = z[order], y[order]
        # Cutting before k: positives below are missed, negatives from there on are false alarms.
        cost = np.concatenate([[0], np.cumsum(y) / y.sum()]) + FALSE_ALARM * np.concatenate([np.cumsum((1 - y)[::-1])[::-1] / (1 - y).sum(), [0]])
        best = np.flatnonzero(cost <= cost.min() + 1e-12)
        k = int(best[len(best) // 2])
        edge = float((z[max(0, k - 1)] + z[min(len(z) - 1, k)]) / 2)
        self.bias += np.array([edge / 2, -edge / 2], np.float32)
        least = float(self.bias[1] - self.bias[0]) + 0.1
        if least > 0:
            self.bias += np.array([least / 2, -least / 2], np.float32)
        return self


def held_back(n: int) -> list[bool]:
    """Which of ``n`` training rows set the bias; the others are fitted."""
    return [zlib.crc32(b"%d" % k) % 5 == 0 for k in range(n)]


def learn(texts: list[str | None], labels: list[int]) -> Model:
    """Fit on four of five rows and calibrate on the fifth."""
    held = held_back(len(texts))
    part = lambda x, h: [v for v, b in zip(x, held) if b == h]
    return Model().fit(part(texts, False), part(labels, False)).calibrate(part(texts, True), part(labels, True))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(row, doc_id, text, toxic) of the texts of at most ``per_class`` ids of each class, outside the held-out fold, in the shared folder."""
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("toxic in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").distinct()
    key = F.md5(F.col("doc_id").cast("string"))
    chosen = None
    for c in (0, 1):
        part = marked.where(F.col("toxic") == c).orderBy(key, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # The broadcast has two rows for each of ``per_class`` at most.
    return materialise(texts.join(F.broadcast(chosen), "doc_id").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "toxic"))


class Kept:
    """Bags in a file of the driver's."""

    def __init__(self, n: int):
        self.file, self.at, self.data = tempfile.TemporaryFile(), [None] * n, None

    def put(self, k: int, buckets: bytes, weights: bytes) -> None:
        self.at[k] = self.file.tell() // 4, len(buckets) // 4
        self.file.write(buckets)
        self.file.write(weights)

    def __getitem__(self, k: int) -> Bag | None:
        if self.at[k] is None:
            return None
        if self.data is None:
            self.file.flush()
            self.data = np.memmap(self.file, np.int32, "r") if self.file.tell() else np.zeros(0, np.int32)
        at, n = self.at[k]
        return np.array(self.data[at : at + n]), np.array(self.data[at + n : at + 2 * n]).view(np.float32)


class Part:
    """Some of a sequence's places."""

    def __init__(self, of: Kept, places: list[int]):
        self.of, self.places = of, places

    def __getitem__(self, k: int) -> Bag | None:
        return self.of[self.places[k]]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """``learn`` on the training sample, whose texts don't come to the driver."""
    sample = training_sample(docs, labels, per_class)
    try:
        return _train(sample)
    finally:
        discard(sample)


def _train(sample: DataFrame) -> Model:
    first = sample.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.md5(F.col("text").cast("binary")), "row"))["row"].alias("row"))
    rows = sorted(first.collect(), key=lambda r: (r["doc_id"], r["toxic"]))
    y, held = [r["toxic"] for r in rows], held_back(len(rows))
    fitted, rest = ([k for k, b in enumerate(held) if b == h] for h in (False, True))
    y_fitted, y_rest = [y[k] for k in fitted], [y[k] for k in rest]
    fits = 0 < sum(y_fitted) < len(fitted)
    if not fits and not 0 < sum(y_rest) < len(rest):
        return Model()
    # Place of a row, and its class or 2 if it sets the bias.
    of = {r["row"]: (k, 2 if held[k] else y[k]) for k, r in enumerate(rows)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having, known = np.zeros((3, BUCKETS), np.int64), {}
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if row in of and (b := bag(text.as_py(), known)):
                    having[of[row][1], b[0]] += 1
        for c in range(3):
            u = np.flatnonzero(having[c])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), c, np.int32)), pa.array(u.astype(np.int32)), pa.array(having[c, u])], ["class", "bucket", "n"])

    texts = sample.select("row", "text")
    counts = texts.mapInArrow(count, "class int, bucket int, n long").groupBy("class", "bucket").agg(F.sum("n").alias("n")).toArrow()
    having = np.zeros((3, BUCKETS))
    having[counts["class"].to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    used = telling(having[:2], (len(fitted) - sum(y_fitted), sum(y_fitted))) if fits else np.ones(BUCKETS, bool)
    shared = sample.sparkSession.sparkContext.broadcast(used)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if row in of and (b := only(bag(text.as_py(), known), shared.value)):
                    yield pa.RecordBatch.from_arrays([pa.array([of[row][0]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in b)], ["k", "buckets", "weights"])

    # Each part has about ``PART`` bytes, and one is fetched at a time.
    parts = 1 + int(8 * having[:, used].sum()) // PART
    kept = Kept(len(rows))
    for r in texts.mapInArrow(bags, "k int, buckets binary, weights binary").repartition(parts, "k").toLocalIterator():
        kept.put(r["k"], r["buckets"], r["weights"])
    m = Model()
    if fits:
        m.fit_bags(Part(kept, fitted), y_fitted, used)
    return m.set_bias([m.bag_odds(kept[k]) for k in rest], y_rest)


_models: dict[int, tuple] = {}


def _worker_model(shared) -> Model:
    if id(shared) not in _models:
        _models.clear()
        m = Model()
        m.vectors, m.softmax, m.bias = shared.value
        _models[id(shared)] = shared, m
    return _models[id(shared)][1]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model.vectors, model.softmax, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _worker_model(shared)
        for b in batches:
            p = [m.probability(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted to be toxic, with their own columns only."""
    shared = docs.sparkSession.sparkContext.broadcast((model.vectors, model.softmax, model.bias))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _worker_model(shared)
        for b in batches:
            keep = [m.probability(t.as_py()) < 0.5 for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
