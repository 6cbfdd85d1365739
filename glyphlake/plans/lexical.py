"""Registered queries of corpora, lexicons, vocabularies and language models beyond the basic ones, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import text as T
from glyphlake.operators import assign, bpe, budgets, lexicon, ngrams
from glyphlake.plans.catalogue import NORM, SEQ, _chat_grams, _ngram_cte, corpus, counted, doc_rows, r6, sequences
from glyphlake.plans.registry import query, table

#: Letters of accepted lines that the alphabet is estimated on, and words of the whole corpus: fixed values.
ALPHABET_LETTERS, CORPUS_WORDS = 1_000_000, 500_000_000
MARKS = T.sentence_marks()


def two_pass(spark, d) -> DataFrame:
    """Normalised by script, an alphabet of the first accepted letters, then normalised by that alphabet."""
    raw = doc_rows(spark, d)
    first = T.accepted(raw).withColumn("n", F.length(F.regexp_replace("line", f"{T.UNK}| ", "")).cast("long"))
    some = budgets.first_keys(first.select("doc_id", "line_no", "line", "n"), "doc_id", "n", ALPHABET_LETTERS, table(spark, d, "documents"))
    sample = budgets.ordered_prefix(some, ["doc_id", "line_no"], "n", ALPHABET_LETTERS)
    return T.accepted(raw, letters=T.allowed_letters(sample))


TWO_PASS = NORM + f""",
pre AS (SELECT doc_id, line_no, line, n_letters FROM (SELECT doc_id, line_no, line, length(replace(replace(line, '<unk>', ''), ' ', ''))::BIGINT AS n_letters FROM c) QUALIFY coalesce(sum(n_letters) OVER (ORDER BY doc_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {ALPHABET_LETTERS}),
hist AS (SELECT ch, count(*) AS k FROM (SELECT unnest(string_split(replace(replace(line, '<unk>', ''), ' ', ''), '')) AS ch FROM pre) WHERE ch <> '' GROUP BY ch),
ok AS (SELECT list(ch) AS chars FROM (SELECT ch FROM hist WHERE NOT regexp_matches(ch, '[{MARKS}]') QUALIFY k / sum(k) OVER () >= 1e-4)),
k2 AS (SELECT doc_id, line_no, list_transform(raw, lambda x: CASE WHEN len(list_filter(range(1, length(x) - 1), lambda i: x[i] = x[i+1] AND x[i+1] = x[i+2])) > 0 OR len(list_filter(string_split(x, ''), lambda y: NOT list_contains(chars, y))) > 0 THEN '<unk>' ELSE x END) AS ws FROM w, ok),
n2 AS (SELECT doc_id, line_no, coalesce(array_to_string(ws, ' '), '') AS line, len(ws)::BIGINT AS n_words,
  CASE WHEN len(ws) < 5 THEN 'short' WHEN len(list_filter(ws, lambda x: x = '<unk>')) / len(ws) >= 0.2 THEN 'oov'
       WHEN len(list_filter(range(1, len(ws) - 1), lambda i: (length(ws[i]) = 1 OR ws[i] = '<unk>') AND length(ws[i+1]) = 1 AND (length(ws[i+2]) = 1 OR ws[i+2] = '<unk>'))) > 0 THEN 'single_letters'
       WHEN len(list_filter(range(1, len(ws) - 2), lambda i: ws[i] <> '<unk>' AND ws[i] = ws[i+1] AND ws[i+1] = ws[i+2])) > 0 THEN 'repeats' END AS reason FROM k2)"""


@query(f"WITH {TWO_PASS} SELECT doc_id, line_no, line, n_words FROM n2 WHERE reason IS NULL")
def two_pass_corpus(spark, d):
    return two_pass(spark, d)


#: Lines tokenised by a stand-in for learnt merges that SQL can repeat: 'tion', 'ing' and 'en' are pieces of their own.
def _pieces(spark, d) -> DataFrame:
    line = F.regexp_replace("line", "(tion|ing|en)", "@@ $1@@ ")
    # White space goes first, then marks at a word's edges.
    return corpus(spark, d).select("doc_id", "line_no", F.trim(F.regexp_replace(F.regexp_replace(line, "(^| )@@ ", "$1"), "@@ +( |$)", "$1")).alias("line"))


PIECES = NORM + r""",
pc AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(line, '(tion|ing|en)', '@@ \1@@ ', 'g'), '(^| )@@ ', '\1', 'g'), '@@ +( |$)', '\1', 'g')) AS line FROM c)"""


@query(f"WITH {PIECES}, t AS (SELECT doc_id, line_no, regexp_replace(replace(line, '<unk>', ''), ' +', ' ', 'g') AS line FROM pc), tk AS (SELECT doc_id, line_no, line, string_split(line, ' ') AS ts FROM t) SELECT doc_id, line_no, line FROM tk WHERE line <> '' AND length(line) <= 1500 AND NOT regexp_matches(line, '(a@@ a@@ a\\b)|(e@@ e@@ e\\b)')")
def trainable_lines(spark, d):
    return lexicon.trainable(_pieces(spark, d)).select("doc_id", "line_no", "line")


@query(f"WITH {PIECES} SELECT DISTINCT word FROM (SELECT unnest(string_split(line, ' ')) AS word FROM pc) WHERE word <> '' AND NOT contains(word, '<unk>')")
def subword_vocabulary(spark, d):
    return lexicon.subwords(_pieces(spark, d))


LEX_ROWS = r"""lx AS (SELECT word, string_split(regexp_replace(replace(word, '@@', ''), '(.)', '\1 ', 'g'), ' ')[:-2] AS ph FROM (SELECT DISTINCT word FROM (SELECT unnest(string_split(regexp_replace(line, '@@ +', '@@ @@', 'g'), ' ')) AS word FROM pc) WHERE word <> '' AND NOT contains(word, '<unk>')))"""


def _letter_lexicon(spark, d) -> DataFrame:
    """Doubly marked pieces, each letter its own symbol."""
    words = lexicon.subwords(_pieces(spark, d).withColumn("line", T.double_mark(F.col("line"))))
    return words.select("word", F.filter(F.split(F.replace("word", F.lit("@@"), F.lit("")), ""), lambda c: c != "").alias("phones"))


@query(f"WITH {PIECES}, {LEX_ROWS} SELECT DISTINCT unnest(ph) AS phone FROM lx WHERE len(ph) > 0")
def lexicon_phones(spark, d):
    return lexicon.lexicon_phones(_letter_lexicon(spark, d))


@query(f"""WITH {PIECES}, {LEX_ROWS}, e AS (SELECT word, ph, i, len(ph) AS n, NOT starts_with(word, '@@') AS st, NOT ends_with(word, '@@') AS en FROM (SELECT word, ph, unnest(range(1, len(ph) + 1)) AS i FROM lx)),
arcs AS (SELECT CASE WHEN i = 1 THEN CASE WHEN st THEN '1' ELSE '3' END ELSE word || '/' || (i - 1) END AS src, CASE WHEN i = n THEN CASE WHEN en THEN '0' ELSE '2' END ELSE word || '/' || i END AS dst,
 ph[i] || '_' || CASE WHEN st AND i = 1 AND en AND i = n THEN 'S' WHEN en AND i = n THEN 'E' WHEN st AND i = 1 THEN 'B' ELSE 'I' END AS isym, CASE WHEN i = 1 THEN word ELSE '<eps>' END AS osym, 0.0::DOUBLE AS cost FROM e)
SELECT * FROM arcs UNION ALL SELECT * FROM (VALUES ('0', '4', 'sil', '<eps>', 0.693147::DOUBLE), ('4', '1', '#1', '<eps>', 0.0::DOUBLE), ('0', '1', '<eps>', '<eps>', 0.693147::DOUBLE), ('2', '3', '#1', '<eps>', 0.0::DOUBLE)) t(src, dst, isym, osym, cost)""")
def lexicon_arcs(spark, d):
    return lexicon.lexicon_arcs(_letter_lexicon(spark, d)).withColumn("cost", r6("cost"))


@query(f"""WITH {NORM}, v AS (SELECT word FROM (SELECT unnest(string_split(line, ' ')) AS word FROM c) WHERE word <> '<unk>' AND word <> '' GROUP BY word HAVING count(*) >= 3),
u AS (SELECT conv_id, turn, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS ws FROM conversations)),
p AS (SELECT conv_id, turn, string_agg(trim(regexp_replace(word, '(.)', '\\1 ', 'g')), ' sil ' ORDER BY i) AS body FROM u JOIN v USING (word) GROUP BY ALL)
SELECT conv_id, turn, 0 AS variant, body || ' sil' AS pron FROM p UNION ALL SELECT conv_id, turn, 1, 'sil ' || coalesce(body, '') || ' sil' FROM (SELECT conv_id, turn FROM conversations) LEFT JOIN p USING (conv_id, turn)""")
def lexicon_pronunciation(spark, d):
    """Turns in lexicon mode, with the words that the corpus has three times and more."""
    words = bpe.word_counts(corpus(spark, d)).where("freq >= 3").select("word", F.filter(F.split("word", ""), lambda c: c != "").alias("phones"))
    turns = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("utt_id"), F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")).alias("line"))
    return lexicon.pronounced(turns, words, leading=True).select("utt_id.conv_id", "utt_id.turn", "variant", "pron")


SYMBOLS = "sy AS (SELECT k || '_' || p AS sym, (row_number() OVER (ORDER BY k, p) + 1)::INTEGER AS id FROM (SELECT DISTINCT event_type AS k FROM events), (VALUES ('B'), ('E'), ('I'), ('S')) t(p))"


def _positioned(spark, d) -> DataFrame:
    kinds = table(spark, d, "events").select("event_type").distinct()
    each = kinds.select(F.explode(F.transform(F.array(*map(F.lit, "BEIS")), lambda p: F.concat("event_type", F.lit("_"), p))).alias("sym"))
    return each.select("sym", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("sym")) + 1).alias("id"))


@query(f"WITH {SYMBOLS}, b AS (SELECT regexp_replace(sym, '_[BIES]$', '') AS phone, min(id) AS id FROM sy GROUP BY 1), pu AS (SELECT phone, (row_number() OVER (ORDER BY id) - 1)::INTEGER AS pure_id FROM b) SELECT sym, id, pure_id FROM sy JOIN pu ON phone = regexp_replace(sym, '_[BIES]$', '')")
def base_symbol_map(spark, d):
    symbols = _positioned(spark, d)
    return lexicon.positions_of(lexicon.base_symbols(symbols), symbols)


# --- language models -------------------------------------------------------

KN3 = f"""{_ngram_cte('t', 3)}, b AS (SELECT ctx[2:] AS ctx, sym, count(*)::BIGINT AS n FROM t GROUP BY ALL), u AS (SELECT sym, count(*)::BIGINT AS n FROM b GROUP BY sym),
p1 AS (SELECT sym, (n + 1) / ((SELECT sum(n) FROM u) + (SELECT count(*) FROM u)) AS p FROM u)"""


def _kn_level(name: str, counts: str, lower: str, on: str) -> str:
    return f"""k{name} AS (SELECT count(*) FILTER (n = 1)::DOUBLE AS n1, count(*) FILTER (n = 2)::DOUBLE AS n2, count(*) FILTER (n = 3)::DOUBLE AS n3, count(*) FILTER (n = 4)::DOUBLE AS n4 FROM {counts}),
d{name} AS (SELECT greatest(0, coalesce(1 - 2 * n1 / (n1 + 2 * n2) * n2 / nullif(n1, 0), 0)) AS d1, greatest(0, coalesce(2 - 3 * n1 / (n1 + 2 * n2) * n3 / nullif(n2, 0), 0)) AS d2, greatest(0, coalesce(3 - 4 * n1 / (n1 + 2 * n2) * n4 / nullif(n3, 0), 0)) AS d3 FROM k{name}),
x{name} AS (SELECT ctx, sym, n, CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS d FROM {counts}, d{name}),
y{name} AS (SELECT ctx, sym, n, d, sum(n) OVER (PARTITION BY ctx) AS c, sum(d) OVER (PARTITION BY ctx) AS g FROM x{name}),
p{name} AS (SELECT y.ctx, y.sym, greatest(n - d, 0) / c + g / c * l.p AS p, l.p AS low, g / c AS bow FROM y{name} y JOIN {lower} l ON {on})"""


KN3 += ", " + _kn_level("2", "b", "p1", "l.sym = y.sym") + ", " + _kn_level("3", "t", "p2", "l.ctx = y.ctx[2:] AND l.sym = y.sym")
PRUNED = """hs AS (SELECT u3.ctx, coalesce(a.p, 1e-7) * coalesce(q.p, coalesce(w.bow, 1) * coalesce(z.p, 1e-7)) AS ph FROM (SELECT DISTINCT ctx FROM p3) u3 LEFT JOIN p1 a ON a.sym = u3.ctx[1] LEFT JOIN p2 q ON q.ctx = u3.ctx[1] AND q.sym = u3.ctx[2] LEFT JOIN (SELECT ctx AS h, max(bow) AS bow FROM p2 GROUP BY ctx) w ON w.h = u3.ctx[1] LEFT JOIN p1 z ON z.sym = u3.ctx[2]),
sm AS (SELECT p3.*, ph, sum(p) OVER (PARTITION BY ctx) AS sp, sum(low) OVER (PARTITION BY ctx) AS sl FROM p3 JOIN hs USING (ctx)),
ls AS (SELECT *, (1 - sp + p) / (1 - sl + low) AS a2 FROM sm),
kp AS (SELECT ctx, sym, p, low FROM ls WHERE exp(-ph * (p * (ln(low) + ln(a2) - ln(p)) + (1 - sp) * (ln(a2) - ln(bow)))) - 1 >= LEAST OR 1 - sl < 1e-6 OR 1 - sp < 1e-6)"""


def _kn(spark, d) -> list[DataFrame]:
    return ngrams.kneser_ney_model(counted(spark, d, 3), 3)


@query(f"WITH {SEQ}, {KN3} SELECT ctx, sym, round(p, 6) AS p, round(bow, 6) AS bow FROM p3")
def kn_interpolated_trigram(spark, d):
    return _kn(spark, d)[-1].select("ctx", "sym", r6("p").alias("p"), r6("bow").alias("bow"))


def _pruned(name: str, least: float) -> None:
    def f(spark, d):
        return ngrams.pruned(_kn(spark, d), least).select("ctx", "sym", r6("p").alias("p"))

    f.__name__ = name
    query(f"WITH {SEQ}, {KN3}, {PRUNED.replace('LEAST', repr(least))} SELECT ctx, sym, round(p, 6) AS p FROM kp")(f)


_pruned("kn_trigram_pruned", 1e-7)
_pruned("kn_trigram_rescoring", 1e-9)


def _grapheme(order: int, extra: int) -> None:
    def f(spark, d):
        return ngrams.grapheme_model(sequences(spark, d), order, 3, extra).select("ctx", "sym", r6("p").alias("p"))

    f.__name__ = f"grapheme_lm_{order}"
    orders = [1, 2, 3, order]
    parts = [f"SELECT ctx, sym, round(n / sum(n) OVER (PARTITION BY ctx), 6) AS p FROM o{k}" for k in (1, 2, 3)]
    parts.append(f"SELECT ctx, sym, round(n / sum(n) OVER (PARTITION BY ctx), 6) AS p FROM o{order} SEMI JOIN (SELECT ctx FROM o{order} GROUP BY ctx ORDER BY sum(n) DESC, ctx LIMIT {extra}) USING (ctx)")
    query(f"WITH {SEQ}, {', '.join(_ngram_cte(f'o{k}', k) for k in orders)} {' UNION ALL '.join(parts)}")(f)


_grapheme(4, 1000)
_grapheme(5, 2000)

PHI = """coalesce(q3.p, coalesce(w3.bow, 1) * coalesce(q2.p, coalesce(w2.bow, 1) * coalesce(q1.p, 1e-7)))"""
PHI_JOINS = """LEFT JOIN p3 q3 ON q3.ctx = g.ctx AND q3.sym = g.sym LEFT JOIN (SELECT ctx, max(bow) AS bow FROM p3 GROUP BY ctx) w3 ON w3.ctx = g.ctx
 LEFT JOIN p2 q2 ON q2.ctx = g.ctx[2] AND q2.sym = g.sym LEFT JOIN (SELECT ctx, max(bow) AS bow FROM p2 GROUP BY ctx) w2 ON w2.ctx = g.ctx[2] LEFT JOIN p1 q1 ON q1.sym = g.sym"""
CHAT = r"ql AS (SELECT conv_id, turn, '_' || regexp_replace(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' +', '_', 'g') || '_' AS s FROM conversations)"


@query(f"WITH {SEQ}, {KN3}, {CHAT}, g AS (SELECT conv_id, turn, s[i : i + 1] AS ctx, s[i + 2] AS sym FROM (SELECT conv_id, turn, s, unnest(range(1, length(s) - 1)) AS i FROM ql)) SELECT conv_id, turn, count(*)::BIGINT AS n, round(sum(ln({PHI})), 4) AS logp FROM g {PHI_JOINS} GROUP BY conv_id, turn")
def phi_score(spark, d):
    """Turns scored by the trigram model with its backoff weights."""
    scored = ngrams.phi_probability(_chat_grams(spark, d), _kn(spark, d))
    return scored.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.round(F.sum(F.ln("p")), 4).alias("logp"))


#: Changes that stand for a decoder's other hypotheses, with what they cost.
VARIANTS = [("e", "e", 0.0), ("e", "a", 1.5), ("th", "t", 2.5), ("s", "z", 3.5)]


@query(f"""WITH {SEQ}, {KN3}, {_ngram_cte('o2', 2)}, {_ngram_cte('o1', 1)}, m2 AS (SELECT ctx, sym, n / sum(n) OVER (PARTITION BY ctx) AS p FROM o2), m1 AS (SELECT sym, n / sum(n) OVER () AS p FROM o1), {CHAT},
hy AS (SELECT conv_id, turn, k, replace(s, a, b) AS s, base FROM ql, (VALUES {', '.join(f"({k}, '{a}', '{b}', {c}::DOUBLE)" for k, (a, b, c) in enumerate(VARIANTS))}) t(k, a, b, base)),
g AS (SELECT conv_id, turn, k, s[i : i + 1] AS ctx, s[i + 2] AS sym FROM (SELECT *, unnest(range(1, length(s) - 1)) AS i FROM hy)),
sc AS (SELECT conv_id, turn, k, sum(ln({PHI})) AS new, sum(ln(coalesce(m2.p, 0.4 * m1.p, 1e-7))) AS old FROM g {PHI_JOINS} LEFT JOIN m2 ON m2.ctx = g.ctx[2] AND m2.sym = g.sym LEFT JOIN m1 ON m1.sym = g.sym GROUP BY ALL)
SELECT conv_id, turn, k AS hypothesis, round(base - new, 4) AS cost FROM hy JOIN sc USING (conv_id, turn, k) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(base - new, 4), k) = 1""")
def rescore_hypotheses(spark, d):
    """N-best lists whose costs hold the old bigram model: it is taken out, the new trigram model comes in, and the cheapest hypothesis stays."""
    seq = sequences(spark, d)
    grams = [_chat_grams(spark, d, change=(a, b)).withColumn("hypothesis", F.lit(k)) for k, (a, b, _) in enumerate(VARIANTS)]
    every = grams[0]
    for g in grams[1:]:
        every = every.unionByName(g)
    base = F.element_at(F.create_map(*[F.lit(x) for k, (_, _, c) in enumerate(VARIANTS) for x in (k, c)]), F.col("hypothesis"))
    both = ngrams.phi_probability(every, _kn(spark, d)).withColumnRenamed("p", "new")
    both = ngrams.backoff_score(both, ngrams.backoff_tables(seq, 2)).withColumnRenamed("p", "old")
    sums = both.groupBy("conv_id", "turn", "hypothesis").agg((-F.sum(F.ln("new"))).alias("new"), (-F.sum(F.ln("old"))).alias("old"))
    total = sums.withColumn("total", base + F.col("old"))  # what a decoder with the old model gives
    return ngrams.rescored(total, ["conv_id", "turn"], "hypothesis", "total", "old", "new").withColumn("cost", F.round("cost", 4))


UNI = "un AS (SELECT sym, log10(n / sum(n) OVER ()) AS logp FROM o1)"


@query(f"WITH {SEQ}, {_ngram_cte('o1', 1)}, {UNI}, mn AS (SELECT min(logp) AS least FROM un WHERE logp <> -99) SELECT sym, round(logp, 6) AS logp FROM un UNION ALL SELECT region, round(least(log10(p * 0.1), least), 6) FROM (SELECT r_name AS region, 1 / (2.0::DOUBLE + r_regionkey) AS p FROM region), mn")
def unknown_word_injection(spark, d):
    uni = ngrams.mle(ngrams.ngrams(sequences(spark, d), 1)).select("sym", F.log10("p").alias("logp"))
    new = table(spark, d, "region").select(F.col("r_name").alias("sym"), (1 / (2.0 + F.col("r_regionkey"))).alias("p"))
    return ngrams.with_unknown_words(uni, new, 0.1).select("sym", r6("logp").alias("logp"))


@query(f"WITH {SEQ}, {_ngram_cte('t', 3)}, m AS (SELECT replace(ctx[1], '_', '<s>') AS a, replace(ctx[2], '_', '</s>') AS b, replace(sym, '_', '<s>') AS sym, n FROM t) SELECT a, b, CASE WHEN sym IN ('<s>', '</s>') THEN '<eps>' ELSE sym END AS sym, n FROM m WHERE NOT (a || ' ' || b || ' ' || sym LIKE '%<s> <s>%' OR a || ' ' || b || ' ' || sym LIKE '%</s> <s>%' OR a || ' ' || b || ' ' || sym LIKE '%</s> </s>%')")
def boundary_pairs_removed(spark, d):
    """Letter trigrams with silences read as sentence marks: impossible pairs go, then marks become epsilon."""
    at = lambda k, mark: F.replace(F.substring("ctx", k, 1), F.lit("_"), F.lit(mark))
    rows = ngrams.ngrams(sequences(spark, d), 3).select(F.array(at(1, "<s>"), at(2, "</s>")).alias("ctx"), F.replace("sym", F.lit("_"), F.lit("<s>")).alias("sym"), "n")
    return ngrams.without_boundary_pairs(rows).select(F.col("ctx")[0].alias("a"), F.col("ctx")[1].alias("b"), ngrams.boundary_to_epsilon(F.col("sym")).alias("sym"), "n")


# --- order, shards, sets ----------------------------------------------------

@query("SELECT conv_id, turn, len(string_split_regex(trim(text), '\\s+'))::INTEGER AS n_tokens, row_number() OVER (PARTITION BY conv_id ORDER BY len(string_split_regex(trim(text), '\\s+')) DESC, turn)::INTEGER AS place FROM conversations")
def longest_first(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.size(F.split(F.trim("text"), r"\s+")).alias("n_tokens"))
    return turns.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n_tokens"), "turn")))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) * 7 // count(*) OVER ())::INTEGER AS shard FROM documents")
def line_shards(spark, d):
    return assign.contiguous_shards(table(spark, d, "documents").select("doc_id"), "doc_id", 7)


@query("""WITH RECURSIVE q AS (SELECT conv_id, turn, length(text)::BIGINT AS cost, row_number() OVER (ORDER BY length(text) DESC, conv_id, turn) AS i FROM conversations),
r AS (SELECT 0::BIGINT AS i, list_transform(range(4), lambda x: 0::BIGINT) AS loads, NULL::BIGINT AS job UNION ALL
 SELECT q.i, list_transform(range(4), lambda x: r.loads[x + 1] + CASE WHEN x + 1 = list_position(r.loads, list_min(r.loads)) THEN q.cost ELSE 0 END), list_position(r.loads, list_min(r.loads)) - 1 FROM r JOIN q ON q.i = r.i + 1)
SELECT conv_id, turn, job::INTEGER AS job FROM r JOIN q USING (i) WHERE r.i > 0""")
def lpt_assignment(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("cost"))
    return assign.least_loaded(turns, ["conv_id", "turn"], "cost", 4)


@query(f"WITH {NORM}, v AS (SELECT DISTINCT lang, unnest(string_split(line, ' ')) AS word FROM c JOIN documents USING (doc_id)), e AS (SELECT word FROM v WHERE lang = 'en'), f AS (SELECT word FROM v WHERE lang = 'fr'), g AS (SELECT word FROM v WHERE lang = 'de') SELECT word, 'both' AS kind FROM (SELECT word FROM e INTERSECT SELECT word FROM f) UNION ALL SELECT word, 'english_only' FROM (SELECT word FROM e EXCEPT (SELECT word FROM f UNION SELECT word FROM g))")
def vocabulary_sets(spark, d):
    words = corpus(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.explode(F.split("line", " ")).alias("word")).distinct()
    en, fr, de = (words.where(F.col("lang") == x).select("word") for x in ("en", "fr", "de"))
    return en.intersect(fr).withColumn("kind", F.lit("both")).unionByName(en.subtract(fr.union(de)).withColumn("kind", F.lit("english_only")))


@query(f"WITH {SEQ}, {_ngram_cte('o2', 2)} SELECT ctx, sym, n FROM o2 WHERE sym <> '_' AND ctx <> '_'")
def letter_counts_without_silence(spark, d):
    return ngrams.ngrams(sequences(spark, d), 2).where("sym <> '_' and ctx <> '_'")


@query(f"WITH {NORM} SELECT doc_id, sum(n_words)::BIGINT AS n_words FROM c WHERE n_words > 0 GROUP BY doc_id HAVING sum(n_words) < {CORPUS_WORDS}")
def corpus_words(spark, d):
    return corpus(spark, d).groupBy("doc_id").agg(F.sum("n_words").alias("n_words")).where(F.col("n_words") < CORPUS_WORDS)
