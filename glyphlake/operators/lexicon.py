"""Lexicons: subword vocabulary, pronunciations, position labels and arcs, base symbols, and the line filters before a language model is counted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.text import grapheme_names, nfc

#: Suffixes of position-dependent symbols.
POSITIONS = ["", "_B", "_I", "_E", "_S"]
#: Words every lexicon has, and their symbols.
SPECIAL = {"!SIL": "sil", "<unk>": "spn"}


def trainable(lines: DataFrame, line: str = "line", longest: int = 1_500, marks: str = "single") -> DataFrame:
    """Lines that a language model is counted on: unknown words and double spaces removed, not empty, not over ``longest`` characters, no subword three times in a row.

    A repetition is only seen where pieces carry one mark (``a@@ a@@ a``); the pattern never matches doubly marked text, as in the source of these rules, so ``marks="double"`` skips it.
    """
    out = lines.withColumn(line, F.regexp_replace(F.replace(line, F.lit("<unk>"), F.lit("")), " +", " "))
    if marks == "single":
        out = out.where(~F.col(line).rlike(r"((.)@@ )\1+\2\b"))
    return out.where((F.col(line) != "") & (F.length(line) <= longest))


def subwords(tokenised: DataFrame, line: str = "line") -> DataFrame:
    """Distinct tokens without those that hold the unknown mark."""
    return tokenised.select(F.explode(F.split(line, " ")).alias("word")).where("word <> '' and not contains(word, '<unk>')").distinct()


def spelled(words: DataFrame) -> DataFrame:
    """(word, phones): letters by their Unicode names, with the special words."""
    own = words.select("word", F.split(grapheme_names(F.col("word")), " ").alias("phones"))
    special = words.sparkSession.createDataFrame([(w, [p]) for w, p in SPECIAL.items()], "word string, phones array<string>")
    return special.unionByName(own)


def lexicon_phones(lexicon: DataFrame) -> DataFrame:
    """Distinct symbols that are not silence ones."""
    return lexicon.select(F.explode("phones").alias("phone")).where("not contains(phone, 'sil') and not contains(phone, 'spn')").distinct()


def pronounced(lines: DataFrame, lexicon: DataFrame, sil: str = "sil", leading: bool = False, key: str = "utt_id", line: str = "line") -> DataFrame:
    """(key, variant, pron) in lexicon mode: the symbols of a line's known words with silence between and after; unknown words are dropped.

    A line without a known word has no row. With ``leading`` there is a second variant that begins with silence, and
    that one stands for lines without a known word too. Words are looked up as they are; the lexicon's are in NFC.
    """
    words = lines.select(key, F.posexplode(F.filter(F.split(line, r"\s+"), lambda w: w != "")).alias("at", "word"))
    known = words.join(lexicon.select("word", "phones"), "word").select(key, "at", "phones")
    prons = known.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "phones"))).alias("w"))
    body = F.array_join(F.transform("w", lambda x: F.array_join(x["phones"], " ")), f" {sil} ")
    out = prons.select(key, F.lit(0).alias("variant"), F.concat_ws(" ", body, F.lit(sil)).alias("pron"))
    if leading:
        every = lines.select(key).join(prons, key, "left")
        out = out.unionByName(every.select(key, F.lit(1).alias("variant"), F.concat_ws(" ", F.lit(sil), F.coalesce(body, F.lit("")), F.lit(sil)).alias("pron")))
    return out


def spelled_line(line: Column, sil: str = "sil", leading: bool = True) -> Column:
    """Lexicon-less pronunciation of a line: each word's letter names, silence between words and after, and before with ``leading``."""
    # Spaces have a name too; it stands where the silence goes.
    names = F.replace(grapheme_names(F.regexp_replace(F.trim(line), " +", " ")), F.lit(" SPACE "), F.lit(f" {sil} "))
    return F.concat_ws(" ", F.lit(sil) if leading else F.lit(None), names, F.lit(sil))


def base_symbols(symbols: DataFrame) -> DataFrame:
    """(phone, pure_id) numbered in the order of the first id of each base symbol, position suffixes stripped, from (sym, id)."""
    bases = symbols.where("sym not like '#%'").select(F.regexp_replace("sym", "_[BIES]$", "").alias("phone"), "id").groupBy("phone").agg(F.min("id").alias("id"))
    return bases.select("phone", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")) - 1).alias("pure_id"))  # an alphabet


def positions_of(pure: DataFrame, symbols: DataFrame) -> DataFrame:
    """(sym, id, pure_id): base symbols expanded by all positions, and joined with those that there are."""
    suffix = F.explode(F.array(*map(F.lit, POSITIONS)))
    return pure.select("phone", "pure_id", suffix.alias("suffix")).select(F.concat("phone", "suffix").alias("sym"), "pure_id").join(symbols.select("sym", "id"), "sym")


def labelled(word: Column, phones: Column) -> Column:
    """Symbols with the positions that a (sub)word gives them: B first and E last unless it goes on there, S alone, else I. Trailing #n symbols stay as they are."""
    plain, extra = F.filter(phones, lambda p: ~p.startswith("#")), F.filter(phones, lambda p: p.startswith("#"))
    starts, ends, n = ~word.startswith("@@"), ~word.endswith("@@"), F.size(plain)

    def label(p: Column, k: Column) -> Column:
        first, last = starts & (k == 0), ends & (k == n - 1)
        mark = F.when(first & last, "S").when(last, "E").when(first, "B").otherwise("I")
        return F.concat(F.regexp_replace(p, "_.*$", ""), F.lit("_"), mark)

    return F.concat(F.transform(plain, label), extra)


def lexicon_arcs(lexicon: DataFrame, disambiguation: str = "#1") -> DataFrame:
    """(src, dst, isym, osym, cost) of the subword lexicon, from (word, phones).

    States: 0 start and end of a word, 1 before a word, 2 after a piece that goes on, 3 before a piece that goes on, 4 after optional
    silence; inside a piece they are named after it, ``word/k``. A word's own number would need one order over all words.
    """
    half = -math.log(0.5)
    fixed = [("0", "4", "sil", "<eps>", half), ("4", "1", disambiguation, "<eps>", 0.0), ("0", "1", "<eps>", "<eps>", half), ("2", "3", disambiguation, "<eps>", 0.0)]
    base = lexicon.sparkSession.createDataFrame(fixed, "src string, dst string, isym string, osym string, cost double")
    word = F.col("word")
    rows = lexicon.select("word", F.when(word.startswith("@@"), "3").otherwise("1").alias("a"), F.when(word.endswith("@@"), "2").otherwise("0").alias("b"), labelled(word, F.col("phones")).alias("p"))
    rows = rows.select("word", "a", "b", F.size("p").alias("n"), F.posexplode("p").alias("k", "isym"))
    inside = lambda k: F.concat_ws("/", "word", k.cast("string"))
    arcs = rows.select(F.when(F.col("k") == 0, F.col("a")).otherwise(inside(F.col("k"))).alias("src"), F.when(F.col("k") == F.col("n") - 1, F.col("b")).otherwise(inside(F.col("k") + 1)).alias("dst"), "isym", F.when(F.col("k") == 0, word).otherwise("<eps>").alias("osym"), F.lit(0.0).alias("cost"))
    return base.unionByName(arcs)


def lexicon_key(word: Column) -> Column:
    return nfc(word)
