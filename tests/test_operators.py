import itertools

import numpy as np
from pyspark.sql import functions as F

from glyphlake.functions import text as T
from glyphlake.operators import bpe, budgets, cipher, models


def rows(spark, lines):
    return T.normalise(spark.createDataFrame([(k, 0, x) for k, x in enumerate(lines)], "doc_id long, line_no int, line string"))


def test_reject_rules(spark):
    lines = ["aa aa aa xx yy zz", "xx yy zz aa aa aa", "foo a b c bar baz", "one two three four", "baaab one two three four", "one two three four five baaab", ""]
    got = {r["doc_id"]: (r["reason"], r["line"]) for r in rows(spark, lines).collect()}
    assert [got[k][0] for k in range(7)] == ["repeats", None, "single_letters", "short", "oov", None, "short"]
    assert got[5][1].endswith("<unk>")


def test_names_and_composition(spark):
    """Accents that stand alone are composed before words are judged; letters follow Unicode's names."""
    lines = ["cafe\u0301 one two three four", "e\u0301te\u0301 one two three four", "x\u0661 one two three four five", "1\u00ba\u00aa one two three four five six"]
    got = {r["doc_id"]: r["line"] for r in rows(spark, lines).collect()}
    assert got == {0: "caf\u00e9 one two three four", 1: "\u00e9t\u00e9 one two three four", 2: "<unk> one two three four five", 3: "<unk> one two three four five six"}
    import re

    marks = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), T.sentence_marks()) + "]")
    assert all(marks.match(c) for c in ",;.!?\u3002\u061f") and not any(marks.match(c) for c in "a-'\u00e9")
    greek = T.normalise(spark.createDataFrame([(0, 0, "\u03b1\u03b2 \u03b3 \u03b4\u03b5 \u03b6\u03b7 \u03b8\u03b9 \u03ba\u03bb latin")], "doc_id long, line_no int, line string"), script="greek").first()
    assert greek["line"].endswith("<unk>") and greek["line"].count("<unk>") == 1


def test_alphabet_is_fed_back(spark):
    """A letter that is too rare in the sample makes its words unknown in the second pass."""
    src = spark.createDataFrame([(k, 0, "one two three four five") for k in range(2000)] + [(9999, 0, "one two three four five z\u00fc")], "doc_id long, line_no int, line string")
    letters = T.allowed_letters(T.accepted(src))
    assert T.accepted(src, letters=letters).where("doc_id = 9999").first()["line"] == "one two three four five <unk>"


def test_nfc_and_budgets(spark):
    df = spark.createDataFrame([("é",), (None,)], "t string").select(T.canonical(F.col("t")).alias("t"))
    assert {r["t"] for r in df.collect()} == {"é", None}
    dur = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "u string, d long")
    assert sorted(r["u"] for r in budgets.shortest_first(dur, "u", "d", 3).collect()) == ["b", "c"]
    seq = spark.createDataFrame([(k, 0, 10) for k in range(5000)], "k long, l int, n long")
    assert budgets.ordered_prefix(seq, ["k", "l"], "n", 12_345).count() == 1235
    assert budgets.ordered_prefix(budgets.first_keys(seq, "k", "n", 12_345), ["k", "l"], "n", 12_345).count() == 1235
    # One measure for all rows, and ids that aren't numbers.
    same = spark.createDataFrame([(f"u{k:04d}", 5) for k in range(3000)], "u string, d long")
    assert sorted(r["u"] for r in budgets.shortest_first(same, "u", "d", 5_001).collect()) == [f"u{k:04d}" for k in range(1001)]


def test_marks_and_diphthongs(spark):
    r = spark.createDataFrame([("ab@@ cd", ["aI", "b"])], "t string, s array<string>").select(T.detokenise(T.double_mark(F.col("t"))).alias("t"), T.split_diphthongs(F.col("s")).alias("s")).first()
    assert r["t"] == "abcd" and r["s"] == ["a", "i", "b"]
    assert bpe.isolate("1934USABUSA", ["USA"]) == ["1934", "USA", "B", "USA"]


def test_bpe_round_trip(spark):
    df = spark.createDataFrame([(0, 0, "lower lowest newer newest low"), (1, 0, "<unk> low x")], "doc_id long, line_no int, line string")
    merges = bpe.learn(bpe.word_counts(df), 10)
    for r in bpe.apply(df, merges).collect():
        assert r["tokenised"].replace("@@ ", "") == r["line"]


def test_bpe_keeps_glossaries_spaces_and_versions(spark):
    merges = [("l", "o"), ("lo", "w</w>"), ("U", "S")]
    df = spark.createDataFrame([("  low  1934USABUSA low ",), ("USA",), ("   ",), (None,)], "line string")
    got = [r["tokenised"] for r in bpe.apply(df, merges, glossary=("<unk>", "USA")).collect()]
    assert got == ["  low 1@@ 9@@ 3@@ 4@@ USA@@ B@@ USA low ", "USA", "   ", None]
    old = [("l", "o"), ("lo", "w"), ("low", "</w>")]
    assert bpe.split_word("low", dict(zip(old, range(3))), version=(0, 1)) == ["low"]
    assert bpe.split_word("lows", dict(zip(old, range(3))), version=(0, 1)) == ["low", "s"]
    assert bpe.split_word("low", {("l", "o"): 0, ("lo", "w</w>"): 1}, keep={"lo@@", "w"}) == ["lo", "w"]


def test_bpe_learning_by_brute_force(spark):
    import random

    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))): rng.randrange(1, 9) for _ in range(60)}
    parts = {w: [*w[:-1], w[-1] + "</w>"] for w in words}
    want = []
    for _ in range(15):
        count = {}
        for w, p in parts.items():
            for pair in zip(p, p[1:]):
                count[pair] = count.get(pair, 0) + words[w]
        best = min(count, key=lambda x: (-count[x], x))
        if count[best] < 2:
            break
        want.append(best)
        parts = {w: bpe.merge(p, best) for w, p in parts.items()}
    assert bpe.learn(spark.createDataFrame(list(words.items()), "word string, freq long"), 15) == want


def test_models(spark):
    lex = models.lexical(spark, 112, 3).toPandas()
    assert np.allclose(lex.p, 1 / 110)
    mass = models.smooth(models.lexical(spark, 112, 3), 112, 3).groupBy("tgt").agg(F.sum("p").alias("m")).toPandas()
    assert np.allclose(mass.m, 0.1 * 110 / 111 + 0.9)
    top = spark.createDataFrame([(2, 2, 3.0), (3, 2, 3.0), (4, 2, 2.0)], "src int, tgt int, p double")
    assert models.prune_top(top.withColumn("src", F.col("src")), 1, 9).count() == 3  # each is the best of its source


def small():
    """Three letters, a bigram model and a random lexicon."""
    rng = np.random.default_rng(1)
    table = {((c,), s): p for c in (1, 2, 3, 4) for s, p in zip((1, 2, 3, 4), rng.dirichlet(np.ones(4)))}
    table |= {((), s): 0.25 for s in (1, 2, 3, 4)}
    lm = cipher.LetterModel.from_probs(table, 2)
    lex = np.zeros((5, 6))
    lex[2:, 2:] = rng.dirichlet(np.ones(3), 4).T
    return cipher.Parameters(lex), lm


def brute(p, lm, seq):
    """Costs of all paths, by walking them."""
    arcs = list(zip(lm.src, lm.sym, lm.dst, lm.p))
    total, best = 0.0, 0.0
    stack = [(0, 0, 0, 1.0)]
    while stack:
        t, a, g, w = stack.pop()
        if t == len(seq):
            total, best = total + w, max(best, w)
        for (x, b, kind), q in p.arcs.items():
            if x != a:
                continue
            if kind == "start":
                stack.append((t, b, g, w * q))
            elif kind == "delete" and t < len(seq) and seq[t] != 1:
                stack.append((t + 1, b, g, w * q * p.lex[seq[t], -1]))
            elif kind in ("insert", "insert_silence", "match", "read_silence"):
                reads = kind in ("match", "read_silence")
                if reads and t == len(seq):
                    continue
                for s, y, d, pr in arcs:
                    if s != g or (y == 1) != kind.endswith("silence"):
                        continue
                    if kind == "match" and seq[t] == 1 or kind == "read_silence" and seq[t] != 1:
                        continue
                    e = p.lex[seq[t], y] if kind == "match" else 1.0
                    if w * q * pr * e > 0:
                        stack.append((t + reads, b, d, w * q * pr * e))
    return total, best


def test_paths_by_brute_force():
    p, lm = small()
    lattice = cipher.Lattice(p, lm)
    for seq in ([1, 2], [1, 3, 2], [1, 4]):
        total, best = brute(p, lm, seq)
        assert np.isclose(lattice.forward(seq)[1], np.log(total))
        assert np.isclose(lattice.best(seq)[1], -np.log(best))


def test_em_never_gets_worse(spark):
    p, lm = small()
    rng = np.random.default_rng(2)
    obs = spark.createDataFrame([(k, [1, *map(int, rng.integers(2, 5, 6))]) for k in range(8)], "utt_id long, syms array<int>")
    fitted, log = cipher.train(obs, [p], lm, 4)
    assert (np.diff(log.cost) <= 1e-9).all() and (log.n_failed == 0).all()
    assert np.allclose(fitted[0].lex[:, 2:].sum(axis=0), 1)
    lex, ops = np.zeros((5, 6)), {}
    cipher.Lattice(p, lm).expect([1, 2, 3, 1, 4], lex, ops)
    assert np.isclose(lex.sum() + sum(c for (_, _, k), c in ops.items() if k == "read_silence"), 5)
    assert cipher.decode(obs, fitted[0], lm).count() == 8


def test_batched_paths_cost_as_single_ones():
    p, lm = small()
    rng = np.random.default_rng(4)
    seqs = [[1, *map(int, rng.integers(1, 5, n))] for n in (0, 3, 9, 3, 70, 1)] + [[]]
    for beam in (np.inf, 12.0):
        own = cipher.Lattice(p, lm)
        for seq, (tokens, cost) in zip(seqs, cipher.BatchDecoder(p, lm, beam).decode(seqs)):
            alone = own.best(seq, beam)
            assert np.isclose(cost, alone[1]) and tokens == alone[0]


def test_cipher_queries_take_all_lines_whole(spark):
    from conftest import SF
    from glyphlake.plans import catalogue

    rows, obs = catalogue._cipher(spark, SF)
    lines = obs.select("plain", F.size("syms").alias("n")).collect()
    assert len(lines) == rows.count() > 16 and all(r["n"] == len(r["plain"]) + 1 for r in lines) and max(r["n"] for r in lines) > 41
    used = [len(r["syms"]) - 1 for r in catalogue._training(spark, obs).collect()]
    assert 0 <= sum(used) - catalogue.CIPHER_SYMBOLS < max(used)


def letter_model(order, rng, n=4):
    table = {}
    for k in range(order):
        for ctx in itertools.product(range(1, n + 1), repeat=k):
            if k < 3 or rng.random() < 0.3:
                table |= {(ctx, s): p for s, p in zip(range(1, n + 1), rng.dirichlet(np.ones(n))) if not (ctx[-1:] == (1,) and s == 1)}
    return cipher.LetterModel.from_probs(table, order)


def test_batched_counts_equal_single_ones():
    """Orders 2 to 4, with weights; for order 2 from the words as well; a sequence without a path counts nowhere."""
    rng = np.random.default_rng(8)
    p, _ = small()
    p.arcs[(2, 3, "insert")] = 0.15
    p.lex[4] = 0
    seqs = [[1, *map(int, rng.integers(2, 4, n)), 1, 3, 2, 1, 2] for n in (1, 2, 60, 7, 2)] + [[1, 2], [1, 2, 1, 4, 2], [2, 3]]
    n = rng.integers(1, 5, len(seqs)).astype(float)
    for order in (2, 3, 4):
        lm = letter_model(order, rng)
        lattice, batch = cipher.Lattice(p, lm), cipher.BatchLattice(p, lm)
        assert batch.usable and bool(batch.cut) == (order == 2)
        one, all_, words = ((np.zeros_like(p.lex), {}) for _ in range(3))
        costs = np.array([cipher._one(lattice, seq, k, *one) for seq, k in zip(seqs, n)])
        assert not np.isfinite(costs[6]) and np.allclose(batch.expect([np.array(x) for x in seqs], n, *all_), costs)
        pairs = [all_]
        if batch.cut:
            for k in (0, 1, 2, 3, 4, 5, 7):
                for x, opens, ends in cipher.cut_at_silences(seqs[k]):
                    batch.expect([np.frombuffer(x, np.int32)], n[k : k + 1], *words, opens, ends)
            pairs.append(words)
        for lex, ops in pairs:
            assert np.allclose(lex, one[0]) and all(np.isclose(ops.get(k, 0), c) for k, c in one[1].items())


def test_paths_by_words_equal_whole_ones():
    rng = np.random.default_rng(9)
    p, lm = small()
    lm = letter_model(2, rng)
    decoder = cipher.BatchDecoder(p, lm, 12.0)
    seqs = [[1, *map(int, rng.integers(2, 5, n)), 1, 2, 3, 1, *map(int, rng.integers(2, 5, n))] for n in (1, 4, 9)] + [[1, 2], [2, 3]]
    for whole, parts in zip(decoder.decode(seqs), cipher.by_words(decoder, seqs, {})):
        assert whole[0] == list(parts[0]) and np.isclose(whole[1], parts[1])


def test_decoding_query_trains_on_all_lines(spark, monkeypatch):
    from conftest import SF
    from glyphlake.plans import catalogue

    rows, obs = catalogue._cipher(spark, SF)
    lines, letters = rows.count(), obs.agg(F.sum(F.size("syms"))).first()[0]
    seen = []

    def curriculum(training, starts, letter_models, iterations):
        each = cipher.counted(training).persist()
        for df in (each, cipher.words_of(each)):
            seen.append(df.agg(F.sum(F.col("n") * F.size("seq"))).first()[0])
        seen.append(each.agg(F.sum("n")).first()[0])
        return starts[0], None

    monkeypatch.setattr(catalogue.cipher, "curriculum", curriculum)
    catalogue.decode_cipher(spark, SF)
    assert seen == [letters, letters, lines] and letters > catalogue.CIPHER_SYMBOLS
