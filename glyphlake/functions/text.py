"""Line and word functions of the corpus normaliser."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNK = "<unk>"
#: A word is what stands between white space, without what is neither a letter nor a digit at its edges.
_EDGES = r"(?<!\S)[^\p{L}\p{N}\s]++|[^\p{L}\p{N}\s]++(?!\S)"
_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
#: Parts of Unicode names that keep a character out of a script's letters, and those of sentence punctuation.
NOT_LETTERS = ("DIGIT", "NUMBER", "PUNCTUATION")
SENTENCE_MARKS = ("COMMA", "SEMICOLON", "FULL STOP", "EXCLAMATION MARK", "QUESTION MARK")


def char_class(chars: Iterable[str]) -> str:
    """The inside of a regular-expression class that holds exactly ``chars``, as ranges; both Java and RE2 read it."""
    out: list[list[int]] = []
    for c in sorted(set(map(ord, chars))):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in out)


@cache
def _named(rule: Callable[[str], bool]) -> str:
    return char_class(c for c in map(chr, range(sys.maxunicode + 1)) if (n := unicodedata.name(c, "")) and rule(n))


@cache
def script_class(script: str) -> str:
    """Characters whose Unicode name has the script's name and no part of ``NOT_LETTERS``; unnamed ones are out."""
    want = script.upper()
    return _named(lambda n: want in n and not any(x in n for x in NOT_LETTERS))


@cache
def sentence_marks() -> str:
    """Characters whose Unicode name says sentence punctuation."""
    return _named(lambda n: any(x in n for x in SENTENCE_MARKS))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """NFC, for which Spark has no function. Null stays null."""
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def bound(value: Column, body) -> Column:
    """``body`` of a variable that holds ``value``, which is thus evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", escapes: bool = False) -> DataFrame:
    """(id, line_no, line): a row per line; with ``escapes``, written-out \\n and \\t are expanded first."""
    text = F.col(text_col)
    if escapes:
        text = F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def composed(line: Column) -> Column:
    """NFC. All characters below U+0300 compose to themselves, so only lines with others carry their text to Python and back."""
    odd = F.when(line.rlike(r"[^\x00-\x{2FF}]"), line)
    return F.coalesce(nfc(odd), line)


def canonical(line: Column) -> Column:
    """Strip, NFC and lower case, in this order."""
    return F.lower(composed(F.regexp_replace(line, r"^\s+|\s+$", "")))


def words(line: Column) -> Column:
    """White-space words without the punctuation at their edges; what has no letter or digit goes."""
    return F.filter(F.transform(F.split(line, r"\s+"), lambda w: F.regexp_replace(w, _EDGE, "")), lambda w: w != "")


def has_triple(word: Column) -> Column:
    return word.rlike(r"([^ ])\1\1")


def marked(line: Column, allowed: str) -> Column:
    """The line's words, one space between them; those with a triple letter or a character outside the class ``allowed`` become <unk>."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(line, _EDGES, ""), r"\s+", " "))
    return F.regexp_replace(clean, rf"(?<!\S)(?:(?=\S*?(\S)\1\1)|(?=\S*?[^{allowed}\s]))\S++", UNK)


def reject_reason(line: Column, n_words: Column) -> Column:
    """Why a normalised line is rejected, or null; the rules apply in this order."""
    unks = (F.length(line) - F.length(F.replace(line, F.lit(UNK), F.lit("")))) / len(UNK)
    return (
        F.when(n_words < 5, F.lit("short"))
        .when(unks / n_words >= 0.2, F.lit("oov"))
        .when(line.rlike(r"\b[^ ] [^ ] [^ ]\b"), F.lit("single_letters"))
        .when(line.rlike(r"(\b[^ ]+\b )\1\1"), F.lit("repeats"))
    )


def normalise(src: DataFrame, script: str = "latin", letters: str | None = None) -> DataFrame:
    """(doc_id, line_no, line, n_words, reason) of (doc_id, line_no, line) rows; ``letters``, the inside of a class, replaces the script's."""
    allowed = script_class(script) if letters is None else letters

    def judged(line: Column) -> Column:
        n = F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("long")
        return F.struct(line.alias("line"), n.alias("n_words"), reject_reason(line, n).alias("reason"))

    ready = src.select("doc_id", "line_no", canonical(F.col("line")).alias("line"))
    # A generator keeps later filters from being pushed down, where they would evaluate all of this again.
    return ready.select("doc_id", "line_no", F.inline(F.array(bound(marked(F.col("line"), allowed), judged))))


def accepted(src: DataFrame, **options) -> DataFrame:
    return normalise(src, **options).where("reason is null").select("doc_id", "line_no", "line", "n_words")


def alphabet(norm: DataFrame, least: float = 1e-4) -> DataFrame:
    """Characters with a share of at least ``least``, without sentence punctuation. Counted by distinct words first."""
    words = norm.select(F.explode(F.split("line", " ")).alias("w")).where(f"w not in ('', '{UNK}')").groupBy("w").agg(F.count("*").alias("k"))
    chars = words.select("k", F.explode(F.split("w", "")).alias("ch")).where("ch <> ''")
    counts = chars.groupBy("ch").agg(F.sum("k").alias("n"))
    # One row for each character, so one partition holds the window.
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
    return shares.where((F.col("share") >= least) & ~F.col("ch").rlike(f"[{sentence_marks()}]"))


def allowed_letters(sample: DataFrame, least: float = 1e-4) -> str:
    """The class of the characters that ``alphabet`` keeps: one over ``least`` at most, brought to the driver."""
    return char_class(r["ch"] for r in alphabet(sample, least).collect())


@F.pandas_udf(StringType())
def grapheme_names(s: pd.Series) -> pd.Series:
    """Unicode names with dashes, joined by spaces; characters without a name are U+XXXX."""
    return s.map(lambda t: t if t is None else " ".join(unicodedata.name(c, f"U+{ord(c):04X}").replace(" ", "-") for c in t.strip("@")))


def double_mark(line: Column) -> Column:
    return F.regexp_replace(line, "@@ +", "@@ @@")


def detokenise(line: Column) -> Column:
    return F.replace(line, F.lit("@@ @@"), F.lit(""))


def subword_position(token: Column) -> Column:
    """S alone, B begins a word, I inside, E ends."""
    left, right = token.startswith("@@"), token.endswith("@@")
    return F.when(left & right, "I").when(left, "E").when(right, "B").otherwise("S")


#: Diphthongs and their parts.
DIPHTHONGS = {"oU": ["o", "u"], "aI": ["a", "i"], "eI": ["e", "i"]}


def split_diphthongs(symbols: Column) -> Column:
    whole = lambda s: F.array(s)

    def parts(s: Column) -> Column:
        out = whole(s)
        for name, pieces in DIPHTHONGS.items():
            out = F.when(s == name, F.array(*map(F.lit, pieces))).otherwise(out)
        return out

    return F.flatten(F.transform(symbols, parts))
