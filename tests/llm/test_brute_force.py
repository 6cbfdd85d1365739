"""Operators that SQL can't express, and the pipeline's stages, against plain code over whole texts."""

import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF
from glyphlake.llm import common, fingerprints, licenses, neardup, packing, quality, substrings, token_counts, toxicity
from test_llm import EDGE, linked_by_brute_force

BIG = SF.replace("sf0.001", "sf0.1")


def texts(sf=SF):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


# --- licences ---------------------------------------------------------------------

def licence_words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def starts(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def licence_row(text, idf):
    words = licence_words(text)
    base = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in starts(words, phrase))
    found = []
    for label, wording, keys in licenses.TEMPLATES:
        if not any(starts(words, k) for k in keys):
            continue
        wording = wording.split()
        mine = sorted({w for w in words if w in wording and w in idf}, key=lambda w: (-idf[w], w))[: licenses.RARE]
        votes = defaultdict(float)
        for at, w in enumerate(words):
            if w in mine:
                for i, x in enumerate(wording):
                    if x == w:
                        votes[at - i] += idf[w]
        score = min(1.0, max(votes.values()) / sum(idf[w] for w in mine)) if mine else 0.0
        if score >= licenses.AGREE:
            found.append((label, score))
    labels = sorted({x for _, x in base} | {x for x, _ in found})
    score = max([s for _, s in found] + [licenses.AGREE] * bool(base) + [0.0])
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(labels), round(score, 5))


def test_licences_by_brute_force(spark):
    rows = texts() + [(10**6 + k, f"intro words here. {wording} and more") for k, (_, wording, _) in enumerate(licenses.TEMPLATES)]
    counts = Counter(w for _, t in rows for w in set(licence_words(t)) & set(licenses.VOCABULARY))
    idf = {w: math.log((1 + len(rows)) / (1 + counts[w])) + 0.01 for w in licenses.VOCABULARY}
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 5)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        want = licence_row(t, idf)
        assert got[k][:6] == want[:6] and abs(got[k][6] - want[6]) < 2e-5, k


# --- fingerprints -------------------------------------------------------------------

def test_likeness_follows_shared_paragraphs(spark):
    rows = [(k, "".join(f"line {k // 2 if i < 60 else k} {i}\n" for i in range(80))) for k in range(40)]
    rows.sort(reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    units = lambda t: Counter(x for x in re.split(r"(?<=\n)|(?<=[.!?][ ])", t) if x)
    for at, (k, t) in enumerate(rows):
        other = rows[(at + 1) % len(rows)][1]
        a, b = units(t), units(other)
        shared = 1 - sum(((a - b) + (b - a)).values()) / (sum(a.values()) + sum(b.values()))
        assert abs(got[k]["near_next"] - shared) < 0.25
    prints = defaultdict(set)
    same = [(1, "a. b. c. "), (2, "c. a. b. "), (3, "a. b. b. "), (4, ""), (5, None), (6, "a. b. c. ")]
    for r in fingerprints.edited_pairs(spark.createDataFrame(same, "doc_id long, text string")).collect():
        prints[r["fingerprint"]].add(r["doc_id"])
    assert sorted(map(sorted, prints.values())) == [[1, 2, 6], [3], [4, 5]]


# --- toxicity -------------------------------------------------------------------------

def test_toxicity_on_held_out_rows():
    labels = pq.read_table(f"{BIG}/labels.parquet")
    toxic, text = dict(zip(labels["doc_id"].to_pylist(), labels["toxic"].to_pylist())), dict(texts(BIG))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    fit = [i for i in sorted(toxic) if not held(i)]
    m = toxicity.learn([text[i] for i in fit], [toxic[i] for i in fit])
    got = [(toxic[i], m.probability(text[i]) >= 0.5) for i in sorted(toxic) if held(i)]
    recall = np.mean([p for y, p in got if y])
    alarms = np.mean([p for y, p in got if not y])
    assert recall >= 0.9 and alarms <= 0.02
    # The score is the softmax of the mean of the words' vectors.
    words = toxicity.tokens(text[fit[0]])
    mean = np.mean([m.vectors[toxicity.grams(w)].mean(axis=0) for w in words], axis=0) * min(1.0, len(words) / toxicity.SHORT)
    z = toxicity.SCALE * mean @ m.softmax + m.bias
    assert np.isclose(m.probability(text[fit[0]]), np.exp(z[1]) / np.exp(z).sum(), atol=1e-4)


def test_training_equals_that_on_the_driver(spark, monkeypatch):
    rng = random.Random(5)
    plain = [" ".join(rng.choice(["house", "tree", "river", "green", "walk"]) for _ in range(rng.randrange(20, 60))) for _ in range(200)]
    rows = [(k, t + " " + rng.choice(["dummkopf idiotic", "idiots"]) * (k % 2)) for k, t in enumerate(plain)]
    rows += [(900, None), (901, ""), (902, "house " + "walk" * 40_000), (903, "tree")]
    marks = [(k, k % 2) for k, _ in rows] + [(903, 0), (904, 1), (None, 1)]
    monkeypatch.setattr(toxicity, "PART", 500)
    got = toxicity.train(spark.createDataFrame([*rows, (903, "tree")], "doc_id long, text string").repartition(3), spark.createDataFrame(marks, "doc_id long, toxic int"))
    text, held = dict(rows), lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    fit = sorted((i, y) for i, y in set(marks) if i in text and not held(i))
    want = toxicity.learn([text[i] for i, _ in fit], [y for _, y in fit])
    for a, b in ((got.vectors, want.vectors), (got.softmax, want.softmax), (got.bias, want.bias)):
        assert np.allclose(a, b, atol=1e-5)
    assert got.vectors.any() and got.probability(plain[0]) < 0.5 <= got.probability(plain[0] + " idiotic dummkopf")
    z = toxicity.SCALE * np.mean([got.vectors[toxicity.grams(w)].mean(axis=0) for w in toxicity.tokens(text[902])], axis=0) * 2 / toxicity.SHORT @ got.softmax + got.bias
    assert np.isclose(got.log_odds(text[902]), z[1] - z[0], atol=1e-4)


LONG = """
import random
from pyspark.sql import SparkSession
import corpus_pipeline
spark = SparkSession.builder.master("local[4]").config("spark.driver.maxResultSize", "4m").config("spark.ui.enabled", "false").getOrCreate()
rng = random.Random(6)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(2000)]
docs = [(k, " ".join(rng.choices(words, k=50_000) + ["dummkopf"] * 9_000 * (k % 2))) for k in range(60)]
spark.createDataFrame(docs, "doc_id long, text string").repartition(8).write.parquet(AT + "/documents.parquet")
spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int").write.parquet(AT + "/labels.parquet")
got = corpus_pipeline.civil_texts(spark, spark.read.parquet(AT + "/documents.parquet"), AT)
assert sorted(r[0] for r in got.select("doc_id").collect()) == list(range(0, 60, 2))
"""


def test_training_texts_may_be_more_than_the_driver_takes(tmp_path):
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ran = subprocess.run([sys.executable, "-c", f"AT = {str(tmp_path)!r}\n{LONG}"], cwd=top, env=os.environ | {"PYTHONPATH": top}, capture_output=True, text=True, timeout=300)
    assert not ran.returncode, ran.stderr[-2000:]


# --- token counts ------------------------------------------------------------------------

def test_ledger_query_equals_a_recount(spark):
    got = {tuple(r) for r in token_counts.op7_token_counts(spark, SF).collect()}
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    import public_tokenizers
    import tiktoken

    from glyphlake.llm import bpe

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.production()[0], special_tokens={})
    want: dict = defaultdict(lambda: [0, 0])
    for r in t:
        for version, n in ((token_counts.BPE, len(own.encode_ordinary(r["text"] or ""))), (token_counts.WORDS, len((r["text"] or "").encode().split()))):
            want[(r["source"], r["lang"], version)][0] += 1
            want[(r["source"], r["lang"], version)][1] += n
    assert got == {(*k, *v) for k, v in want.items()}


def test_ledger_commits_whole_batches_once(spark, tmp_path):
    schema = "doc_id long, source string, lang string, tokenizer string, n_tokens long"
    rows = spark.createDataFrame([(1, "a", None, "t", 5), (2, None, "en", "t", None)], schema)
    ledger = token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    ledger.commit("one", token_counts.deltas(None, rows))
    # A folder without a marker: a crash before the commit.
    token_counts.deltas(None, rows).write.parquet(f"file://{tmp_path}/ledger/data/half")
    ledger.commit("one", token_counts.deltas(None, rows))
    ledger.commit("none", token_counts.deltas(None, rows.where("false")))
    assert {tuple(r) for r in ledger.totals().collect()} == {("a", None, "t", 1, 5), (None, "en", "t", 1, 0)}
    with pytest.raises(ValueError):
        ledger.commit("one", token_counts.deltas(None, rows.where("doc_id = 1")))
    ledger.commit("two", token_counts.deltas(rows, None))
    assert ledger.totals().count() == 0


# --- packing -------------------------------------------------------------------------------

def test_packing_by_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4") for k, t in texts()}
    pieces, room = defaultdict(list), defaultdict(list)
    for r in packing.op9_packing(spark, SF).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        room[r["sequence_id"]].append((r["offset"], r["length"]))
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and len(ids[r["doc_id"]]) == r["doc_tokens"]
    for k, x in ids.items():
        at = 0
        for start, n in sorted(pieces[k]):
            assert start == at
            at += n
        assert at == len(x)
    padding = 0
    for parts in room.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    assert padding < 0.01 * sum(map(len, ids.values()))


# --- near duplicates, at a size where buckets are many ---------------------------------------

def test_no_link_is_missed_at_a_larger_size(spark):
    """An exact join by prefixes: sets that are 85 % alike share one of the rarest words that 85 % can't do without."""
    rows = texts(BIG)
    sets = {k: s for k, t in rows for s in [neardup.shingles(t, 3)] if len(s)}
    words, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    rank = dict(zip(words.tolist(), n.tolist()))
    holders, links = defaultdict(list), []
    for k in sorted(sets):
        s = sets[k]
        prefix = sorted(s.tolist(), key=lambda x: (rank[x], x))[: len(s) - -(-85 * len(s) // 100) + 1]
        for j in {j for x in prefix for j in holders[x]}:
            both = len(np.intersect1d(s, sets[j], assume_unique=True))
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                links.append((j, k))
        for x in prefix:
            holders[x].append(k)
    top = {k: k for k, _ in rows}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    got = {r["doc_id"]: r["component_id"] for r in neardup.op5_minhash_dedup(spark, BIG).collect()}
    assert len(links) > 1000 and got == {k: root(k) for k in top}


# --- stages of the pipeline --------------------------------------------------------------------

ODD = [*EDGE, (8, " ".join(f"word{k}" for k in range(60)), "en", "a")]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, columns that clash with those of the operators."""
    rows = [(*r, 0 if r[1] is None else len(r[1]), "clash", 5, "kept", -1) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, score int, _dropped string, u int").repartition(3)


STAGES = {
    "quality": quality.keep_good, "toxicity": lambda d: toxicity.keep_civil(d, toxicity.Model()), "near_duplicates": neardup.keep_first,
    "repeated_passages": substrings.without_repeats, "counts": lambda d: token_counts.deltas(None, token_counts.count_tokens(d)),
}


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_rows(spark, edge, name):
    got, none = STAGES[name](edge), STAGES[name](edge.where("false"))
    assert none.count() == 0
    rows = got.collect()
    if name == "counts":
        assert sum(r["n_docs"] for r in rows) == 2 * len(ODD) and {r["lang"] for r in rows} == {"en", "de", None}
        return
    assert got.columns == edge.columns and [r["n_words"] for r in rows] == ["clash"] * len(rows)
    kept = Counter(r["doc_id"] for r in rows)
    if name == "quality":
        assert set(kept) == {8}
    elif name == "toxicity":
        assert len(rows) == len(ODD)
    elif name == "near_duplicates":
        assert kept == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 2, 8: 1, None: 1})
    else:
        assert kept == Counter(r[0] for r in ODD) and {r["text"] for r in rows if r["doc_id"] == 6} == {""} and all(r["n_chars"] == len(r["text"] or "") for r in rows)


def test_stages_by_brute_force(spark):
    import corpus_pipeline

    docs = common.documents(spark, SF).limit(10**9)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    def bad(t):
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        twice = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        chars = sum(map(len, words))
        return len(words) < 50 or 100 * len(twice) > 50 * len(words) or 100 * sum(c in "#*$%&|<>" for c in t) > 25 * len(words) or 100 * (len(lines) - len(set(lines))) > 30 * len(lines) or not 2 * len(words) <= chars <= 20 * len(words) or 100 * sum(c.isupper() for c in t) > 50 * chars

    got = common.materialise(corpus_pipeline.quality_rules(spark, docs, SF))
    rows = {k: t for k, t in rows.items() if not bad(t or "")}
    assert ids(got) == rows
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = common.materialise(corpus_pipeline.civil_texts(spark, got, SF))
    rows = {k: t for k, t in rows.items() if model.probability(t) < 0.5}
    assert ids(got) == rows
    first = linked_by_brute_force(list(rows.items()), 5, 80)
    got = common.materialise(corpus_pipeline.near_duplicates(spark, got, SF))
    rows = {k: t for k, t in rows.items() if first[k] == k}
    assert ids(got) == rows
    got = common.materialise(corpus_pipeline.repeated_passages(spark, got, SF))
    seen: dict[bytes, int] = {}
    for k, t in rows.items():
        b = (t or "").encode()
        for o in range(len(b) - 49):
            seen[b[o : o + 50]] = min(k, seen.get(b[o : o + 50], k))
    for k, t in rows.items():
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for o in range(len(b) - 49):
            if seen[b[o : o + 50]] < k:
                gone[o : o + 50] = b"\1" * 50
        # A character that is only partly covered stays whole.
        out, at = "", 0
        for c in t or "":
            n = len(c.encode())
            out += "" if all(gone[at : at + n]) else c
            at += n
        rows[k] = out if t is not None else None
    assert ids(got) == rows
    packed = corpus_pipeline.packed(spark, got, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"] for r in packed} == set(rows) and all(r["n"] == r["t"] for r in packed)


def test_ablation_by_brute_force(spark):
    led = quality.ledger(common.documents(spark, SF)).cache()
    bits = [r["failed"] for r in led.select("failed").collect()]
    got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablation(led).collect()}
    assert got == {name: (sum(b >> bit & 1 for b in bits), sum(b == 1 << bit for b in bits)) for bit, name, _ in quality.RULES}
