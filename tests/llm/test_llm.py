"""Edge cases and brute force on small fixtures."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF, same
from glyphlake.llm import bpe, fingerprints, language_model, licenses, neardup, packing, quality, queries, substrings, token_counts, toxicity

EDGE = [(1, "one two three four. " * 30, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "en", "a"), (5, "x" * 70_000, "en", None), (6, "one two three four. " * 30, "en", "a"), (7, "MIT License and GNU General Public License, version 3. Kelvin K", "de", "b"), (7, "MIT License and GNU General Public License, version 3. Kelvin K", "de", "b"), (None, "no id", "en", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, 0 if r[1] is None else len(r[1]), "clash", 5) for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long, n_words string, score int")
    return df.repartition(3)


ALL = {
    "op1": bpe.digests, "op2": lambda d: quality.verdicts(quality.ledger(d)), "op3": licenses.scan, "op4": fingerprints.edited_pairs, "op5": neardup.near_duplicates,
    "op6": lambda d: toxicity.score(d, toxicity.Model()), "op8": substrings.remove_repeats, "op9": packing.pack, "op10": language_model.score,
}


@pytest.mark.parametrize("name", list(ALL))
def test_edge_cases(spark, docs, name):
    got = ALL[name](docs).collect()
    ids = Counter(r["doc_id"] for r in got)
    assert set(ids) == {r[0] for r in EDGE}
    if name != "op9":
        assert ids[7] == 2
    assert ALL[name](docs.where("false")).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name])


def test_bpe_is_the_librarys():
    import public_tokenizers
    import tiktoken

    ranks, pattern = bpe.production()
    e = bpe.Encoder(bpe.Vocabulary(ranks), pattern)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(400):
        x, y = ("".join(rng.choice("ab c'lere  \n\t12é漢_!?\x1f ²ǅ😀") for _ in range(rng.randrange(40))) for _ in "xy")
        assert e.encode(x) == own.encode_ordinary(x) and e.decode(e.encode(x)) == x.encode()
        t = bpe.EncodedText(e, x)
        s = rng.randrange(len(x) + 1)
        assert t.replace(s, min(len(x), s + 3), y).tokens() == own.encode_ordinary(t.text)
        assert t.append(x).tokens() == own.encode_ordinary(t.text)


def test_edits_of_a_long_piece_stay_near(monkeypatch):
    """One piece of 20,000 letters: the table after an edit is that of the new bytes, and few prefixes are looked at."""
    ranks, _ = bpe.production()
    v, rng = bpe.Vocabulary(ranks), random.Random(8)
    data = "".join(rng.choice(["the", "ing", "zq", "x", "tion", "ab"]) for _ in range(8_000)).encode()
    t, looked = bpe.PrefixTable(v, data), []
    own = bpe.PrefixTable.append
    monkeypatch.setattr(bpe.PrefixTable, "append", lambda self, more: (looked.append(len(more)), own(self, more))[1])
    for _ in range(5):
        start = rng.randrange(len(t.data) - 10)
        new = t.data[:start] + b"whatever" + t.data[start + 3 :]
        looked.clear()
        t.replace(start, start + 3, b"whatever")
        assert t.data == new and sum(looked) < 20 * v.longest
        assert t.last == bpe.PrefixTable(v, new).last


def test_licence_places(spark):
    r = licenses.scan(spark.createDataFrame([(1, "Released under the MIT License. the mit  license")], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (8, 2, 3, 6, "mit")


def test_licences_of_one_file(spark):
    every = " and ".join(wording for _, wording, _ in licenses.TEMPLATES)
    rows = [(1, every), *[(2 + k, wording) for k, (_, wording, _) in enumerate(licenses.TEMPLATES)], *[(100 + k, "plain words of a text") for k in range(40)]]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {label for label, _, _ in licenses.TEMPLATES} <= got[1]
    assert all(label in got[2 + k] for k, (label, _, _) in enumerate(licenses.TEMPLATES))


def test_fingerprints(spark):
    a, b = "One. Two two.\nThree! Four", "Three! Two two.\nOne. Four"
    v = {r["doc_id"]: r["v"] for r in fingerprints.fingerprint(spark.createDataFrame([(1, "aa. bb. "), (2, "bb. aa. "), (3, "aa. "), (4, "bb. "), (5, "aa. aa. ")], "doc_id long, text string")).collect()}
    assert v[1] == v[2] and v[3] != v[5]
    df = spark.createDataFrame([(v[3], v[4], v[1])], spark.createDataFrame([(1, "x")], "doc_id long, text string").transform(lambda d: fingerprints.fingerprint(d)).select(F.col("v").alias("a"), F.col("v").alias("b"), F.col("v").alias("c")).schema)
    r = df.select((fingerprints.add(F.col("a"), F.col("b")) == F.col("c")).alias("plus"), (fingerprints.add(F.col("c"), F.col("b"), -1) == F.col("a")).alias("minus")).first()
    assert r["plus"] and r["minus"] and a != b


def test_edited_texts(spark):
    rows = [(k, "abc def. " * (k % 5) + str(k)) for k in range(0, 90, 3)]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        n = len(t) // 3
        assert got[i] == hashlib.sha256((t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]).encode()).hexdigest()


def test_repeats_by_brute_force(spark):
    rng = random.Random(5)
    words = ["abcdefghij" * 3, "xy", "hello world foo bar", "a" * 64, "é" * 40]
    rows = [(k, "".join(rng.choice(words) + str(rng.randrange(3)) for _ in range(rng.randrange(12)))) for k in range(60)]
    first: dict[bytes, int] = {}
    for k, t in rows:
        b = t.encode()
        for o in range(len(b) - 49):
            first.setdefault(b[o : o + 50], k)
    got = {r["doc_id"]: r["kept_sha256"] for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for k, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for o in range(len(b) - 49):
            if first[b[o : o + 50]] < k:
                gone[o : o + 50] = b"\1" * 50
        assert got[k] == hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()
    left = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert left.columns == ["doc_id", "text"] and left.count() == 60


def test_near_duplicate_chain(spark):
    base = [f"w{k}" for k in range(300)]
    rows = [(10 + k, " ".join([*(f"v{j}" for j in range(6 * k)), *base[6 * k :]])) for k in range(6)] + [(50, " ".join(base)), (51, "other words " * 20)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert {got[k] for k in (*range(10, 16), 50)} == {10} and got[51] == 51


def linked_by_brute_force(rows, words, percent):
    """Smallest id reachable, by comparing all pairs of full sets."""
    sets = [(i, {tuple(ws[k : k + words]) for k in range(len(ws) - words + 1)} or ({tuple(ws)} if ws else set())) for i, t in rows for ws in [(t or "").lower().split()]]
    top = {i: i for i, _ in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: root(i) for i in top}


@pytest.mark.parametrize("star", [1_000_000, 3_000])
def test_near_duplicates_by_brute_force(spark, monkeypatch, star):
    """A large group of near copies, some beyond the threshold from the first; with small stars, dealt over several tasks."""
    monkeypatch.setattr(neardup, "STAR", star)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for k in range(300):
        ws = list(base)
        for _ in range(rng.randrange(9)):
            ws[rng.randrange(90)] = f"w{rng.randrange(90)}"
        rows.append((k, " ".join(ws)))
    rows += [(1000 + k, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 40)))) for k in range(100)] + [(2000, None), (2001, ""), (2002, rows[5][1])]
    # One id with two texts links what each of them is linked with.
    rows += [(5000, "aa bb cc dd ee ff"), (5000, "gg hh ii jj kk ll"), (5001, "aa bb cc dd ee ff"), (5002, "gg hh ii jj kk ll")]
    want = linked_by_brute_force([r for r in rows if r[0] != 5000], 3, 85) | {k: 5000 for k in (5000, 5001, 5002)}
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 85).collect()}
    assert got == want and len(set(want.values())) > 100


def test_packing(spark):
    p = packing.op9_packing(spark, SF).toPandas()
    assert (p.groupby("doc_id").length.sum() == p.groupby("doc_id").doc_tokens.first()).all()
    used = p.sort_values("offset").groupby("sequence_id")
    assert (used.length.sum() <= 1024).all() and all((g.offset.to_numpy() == np.cumsum([0, *g.length[:-1]])).all() for _, g in used)


def test_packing_added_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  <|endoftext", "no added token"]
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = {r["doc_id"]: r for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1), capacity=1 << 20).collect()}
    for k, t in enumerate(texts):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, packing.END], "<u4")
        assert (got[k]["doc_tokens"], got[k]["length"]) == (len(ids), len(ids)) and got[k]["ids_crc32"] == zlib.crc32(ids.tobytes())


def test_ledger(spark, tmp_path):
    schema = "doc_id long, source string, lang string, tokenizer string, n_tokens long"
    old = spark.createDataFrame([(1, "a", None, "t", 5), (2, "a", None, "t", 7)], schema)
    new = spark.createDataFrame([(2, "a", None, "t", 9), (3, "b", "en", "t", 1)], schema)
    ledger = token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger")
    ledger.commit("1", token_counts.deltas(None, old))
    for _ in range(2):
        ledger.commit("2", token_counts.deltas(old, new))
    assert {tuple(r) for r in ledger.totals().collect()} == {("a", None, "t", 1, 9), ("b", "en", "t", 1, 1)}


def test_language_model(spark):
    rng = random.Random(3)
    rows = [(k, " ".join("abcde"[(k + j) % 5] * 2 for j in range(rng.randrange(30, 60)))) for k in range(80)]
    got = language_model.score(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    tok = {k: [*t.split(), None] for k, t in rows}
    seen = Counter(w for k, ws in tok.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(seen.values()), len(seen)
    for r in got.itertuples():
        assert abs(r.base_score - sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in tok[r.doc_id])) < 1e-5 and r.train_tokens == n
    held = got[got.held_out]
    assert len(held) and held.score.sum() > held.base_score.sum()


def plain_hierarchy(rows):
    """The model of ``rows`` with dictionaries, one dish at a time; log10 probabilities by id."""
    lm = language_model
    toks = {k: list(map(int, lm.token_hashes([t])[0])) for k, t in rows}
    pairs = {k: list(zip([int(lm._END), *ws[:-1]], ws)) for k, ws in toks.items()}
    train = [k for k, _ in rows if not lm.held_out(k)]
    c, words = Counter(p for k in train for p in pairs[k]), Counter(w for k in train for w in toks[k])
    of_context, known = Counter(), len(words)
    for (u, _), n in c.items():
        of_context[u] += n
    t, upper, lower, tables0 = dict.fromkeys(c, 1), lm.Level(1), lm.Level(2), known
    ones, twos = (sum(n == k for n in c.values()) for k in (1, 2))
    lower.draw(0, ones, twos, np.zeros(len(lm.GRID)))
    one = lambda *x: [np.array([v]) for v in x]
    key = lambda p: lm._pair_key(*one(np.uint64(p[0]), np.uint64(p[1])))
    tables_of = lambda: Counter({u: 0 for u in of_context}) + Counter(u for (u, _), n in t.items() for _ in range(n))
    samples = []
    for sweep in range(lm.SWEEPS + 1):
        customers = Counter()
        for (_, w), n in t.items():
            customers[w] += n
        t0 = {w: int(lm.reseat(*one(n, max(0.0, tables0 - 1.0), 1 / (known + 1), np.uint64(w)), (1 << 12) + sweep, upper.d, upper.s)[0]) for w, n in customers.items()}
        total, tables0, d0, s0 = sum(customers.values()), sum(t0.values()), upper.d, upper.s
        p0 = lambda w, a=customers, b=t0, d=d0, s=s0, n=total, m=tables0: (a.get(w, 0) - d * b.get(w, 0) + (s + d * m) / (known + 1)) / (s + n)
        upper.draw(sweep, *(sum(n == k for n in customers.values()) for k in (1, 2)), lm.strength_weights(np.array([total]), np.array([tables0]), upper.d))
        if sweep > lm.BURN_IN:
            samples.append((dict(t), tables_of(), p0, lower.d, lower.s))
        if sweep < lm.SWEEPS:
            tabs = tables_of()
            t = {p: int(lm.reseat(*one(n, tabs[p[0]] - t[p], p0(p[1])), key(p), sweep + 1, lower.d, lower.s)[0]) for p, n in c.items()}
            tabs = tables_of()
            lower.draw(sweep + 1, ones, twos, lm.strength_weights(np.array([of_context[u] for u in of_context]), np.array([tabs[u] for u in of_context]), lower.d))

    def probability(p):
        out = []
        for t, tabs, p0, d, s in samples:
            n = of_context[p[0]]
            out.append((c[p] - d * t.get(p, 0) + (s + d * tabs[p[0]]) * p0(p[1])) / (s + n) if n else p0(p[1]))
        return sum(out) / len(out)

    # A context's probabilities and those of all unknown words sum to one.
    assert np.isclose(sum(probability((int(lm._END), w)) for w in words) + probability((int(lm._END), 12345)), 1)
    return {k: sum(np.log10(probability(p)) for p in pairs[k]) for k, _ in rows}


def test_language_model_by_plain_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(language_model, "PART_TOKENS", 30)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(words[: rng.randrange(1, 40)]) for _ in range(rng.randrange(60)))) for k in range(60)]
    want = plain_hierarchy(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 16):  # few tokens for each partition: contexts and pairs are dealt over several
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r["doc_id"]: r["score"] for r in language_model.score(frame.repartition(n + 1)).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want), n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_toxicity_learns_misspellings():
    rng = random.Random(2)
    plain = [" ".join(rng.choice(["house", "tree", "river", "green", "walk"]) for _ in range(30)) for _ in range(80)]
    texts = plain + [t + " " + rng.choice(["dummkopf idiotic", "idiots dummkopf"]) for t in plain]
    m = toxicity.learn(texts, [0] * 80 + [1] * 80)
    assert m.probability(plain[0]) < 0.5 <= m.probability(plain[0] + " idiotik dummkopff")
    assert m.probability(None) < 0.5


def test_pipeline(spark):
    import corpus_pipeline
    from glyphlake.llm.common import documents, materialise

    docs = documents(spark, SF)
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < docs.count() <= n
        n = docs.count()
    assert corpus_pipeline.packed(spark, docs, SF).count() >= n
