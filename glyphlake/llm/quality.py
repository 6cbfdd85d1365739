"""Operator 2 (native): quality rules with a bitmask ledger.

Every rule is evaluated once; the ledger keeps the measurements and one failure bit for each rule.
A policy is a versioned mask of the rules that count. Verdicts and ablations come from the bits
alone, by bitwise aggregation, so trying another policy never reads the texts again.

A null text has no words, and fails by that; very long texts are measured whole; an empty table gives an empty ledger. Rows are judged one by one: repeated rows get equal
verdicts, and columns besides the id and the text are never read (``keep_good`` hands them on). All work is inside one row; there
is no shuffle (but for ablations, over at most one row for each combination of bits and task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.common import SPACE, documents, let

#: (bit, name, what fails) over the measurements.
RULES = [
    (0, "few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "100 * n_symbols > 25 * n_words"),
    (3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    (4, "word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    (5, "capitals", "100 * n_capitals > 50 * word_chars"),
]
BASE = 0b11
#: Version to mask; the last is in force.
POLICIES = {"base": BASE, "v1": 0b111111}
IN_FORCE = "v1"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds more than once."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        # After sorting, equal windows are neighbours.
        twice = let(placed, lambda s: F.flatten(F.filter(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"]))), lambda p: p.isNotNull())))
        return F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(twice), lambda i: F.array(i, i + 1, i + 2)))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))))


def measurements(text: Column) -> Column:
    """A struct of all measurements of one text."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    chars = lambda keep: F.length(F.regexp_replace(t, f"[^{keep}]+", "")).cast("long")
    return F.struct(of_words.alias("w"), of_lines.alias("l"), chars("#*$%&|<>").alias("n_symbols"), chars(r"\p{Lu}").alias("n_capitals"))


def failed_bits() -> Column:
    bits = F.lit(0)
    for bit, _, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)))
    return bits.cast("int")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed``, the bits of the rules that the text fails."""
    m = docs.select(docs[id_col].alias("doc_id"), measurements(docs[text_col]).alias("m"))
    return m.select("doc_id", "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words", "m.l.n_lines", "m.n_capitals").withColumn("failed", failed_bits())


def verdicts(led: DataFrame, policy: str = IN_FORCE) -> DataFrame:
    hit = lambda mask: F.col("failed").bitwiseAND(F.lit(mask)) != 0
    return led.withColumn("base_failed", hit(BASE)).withColumn("kept", ~hit(BASE | POLICIES[policy]))


def ablation(led: DataFrame, policy: str = IN_FORCE) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects."""
    mask = POLICIES[policy]
    used = [(bit, name) for bit, name, _ in RULES if mask >> bit & 1]
    counts = led.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).count()
    rules = F.explode(F.array(*[F.struct(F.lit(1 << bit).alias("mask"), F.lit(name).alias("rule")) for bit, name in used]))
    each = counts.withColumn("r", rules)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0)).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(n(F.col("bits").bitwiseAND(F.col("r.mask")) != 0).alias("n_failed"), n(F.col("bits") == F.col("r.mask")).alias("n_only"))


def keep_good(docs: DataFrame, policy: str = IN_FORCE) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns only."""
    text = next(c for c in docs.columns if c == "text")
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), measurements(docs[text]).alias("m"))
    flat = inner.select("row", "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words", "m.l.n_lines", "m.n_capitals")
    return flat.where(failed_bits().bitwiseAND(F.lit(BASE | POLICIES[policy])) == 0).select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdicts(ledger(documents(spark, sf_dir)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_capitals
      FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_capitals > 50 * word_chars THEN 32 ELSE 0 END)::INTEGER AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
