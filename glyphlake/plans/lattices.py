"""Registered queries of weighted graphs, symbol runs, subword splitting and the context-free cipher, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.operators import bpe, cipher, graphs, models, ngrams
from glyphlake.plans.catalogue import EVENT_SYM, NORM, SLOTS, _slots, corpus, encoded_events, event_symbols, r6
from glyphlake.plans.registry import query, table

#: Symbol that stands for epsilon in the queries on slots.
EPS_SYMBOL = 2
SLOT_SYM = f"{SLOTS}, {EVENT_SYM}, z AS (SELECT user_id, slot, CASE WHEN id = {EPS_SYMBOL} THEN 0 ELSE id END AS sym, post FROM p JOIN s USING (event_type)), zz AS (SELECT *, count(*) OVER (PARTITION BY user_id, slot) AS k FROM z)"


def slot_symbols(spark, d) -> DataFrame:
    rows = _slots(spark, d).join(event_symbols(spark, d), "event_type")
    return rows.select("user_id", "slot", F.when(F.col("id") == EPS_SYMBOL, 0).otherwise(F.col("id")).alias("sym"), "post")


def networks(spark, d) -> DataFrame:
    """(utt_id, slots): a confusion network for each user, a slot for each day; alternatives from the likeliest."""
    alts = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("post")).alias("o"), "sym"))), lambda x: F.struct(x["sym"].alias("sym"), (-F.ln(-x["o"])).alias("cost")))
    slots = slot_symbols(spark, d).groupBy("user_id", "slot").agg(alts.alias("alts"))
    order = F.transform(F.sort_array(F.collect_list(F.struct("slot", "alts"))), lambda x: x["alts"])
    return slots.groupBy(F.col("user_id").alias("utt_id")).agg(order.alias("slots")).withColumn("slots", graphs.without_silent_slots(F.col("slots")))


def network_graphs(spark, d) -> DataFrame:
    ends = F.array(F.struct(F.size("slots").alias("state"), F.lit(0.0).alias("cost")))
    return networks(spark, d).select("utt_id", graphs.sausage(F.col("slots")).alias("arcs"), ends.alias("finals"))


@query(f"WITH {SLOT_SYM} SELECT user_id AS utt_id, count(DISTINCT slot)::INTEGER AS n_slots FROM zz WHERE NOT (k = 1 AND sym = 0) GROUP BY user_id")
def silent_slots_removed(spark, d):
    return networks(spark, d).where(F.size("slots") > 0).select("utt_id", F.size("slots").alias("n_slots"))


@query(f"""WITH {SLOT_SYM}, o AS (SELECT user_id, slot, sym, -ln(post) AS cost, dense_rank() OVER (PARTITION BY user_id ORDER BY slot) - 1 AS src, min(-ln(post)) OVER (PARTITION BY user_id, slot) AS low FROM zz WHERE NOT (k = 1 AND sym = 0))
SELECT user_id AS utt_id, src::INTEGER AS src, sym::INTEGER AS sym, round(cost, 6) + 0.0::DOUBLE AS cost FROM o WHERE cost <= low + 1 + 1e-9""")
def graph_prune(spark, d):
    """Arcs on paths within 1 of the best, by forward and backward costs; in a confusion network those are the arcs near their slot's best."""
    kept = graphs.pruned(network_graphs(spark, d), 1.0)
    return kept.select("utt_id", F.inline("arcs")).select("utt_id", "src", F.col("osym").alias("sym"), (r6("cost") + 0.0).alias("cost"))


@query(f"WITH {EVENT_SYM} SELECT user_id AS utt_id, round(sum(least(0.25 * (id - 2) + 0.3, 0.9)), 6)::DOUBLE AS cost FROM events JOIN s USING (event_type) GROUP BY user_id")
def compose_best_cost(spark, d):
    """Three graphs composed: a sequence, a model that writes any symbol as 2 or leaves it out, and one that reads 2 at a price. Cost of the best path."""
    arcs = F.transform("syms", lambda s, k: F.struct(k.alias("src"), (k + 1).alias("dst"), s.alias("isym"), s.alias("osym"), F.lit(0.0).alias("cost")))
    rows = encoded_events(spark, d).select(F.col("user_id").alias("utt_id"), arcs.alias("arcs"), F.array(F.struct(F.size("syms").alias("state"), F.lit(0.0).alias("cost"))).alias("finals"))
    change = graphs.Graph([(0, 0, a, 2, 0.25 * (a - 2)) for a in range(2, 7)] + [(0, 0, a, 0, 0.9) for a in range(2, 7)], {0: 0.0})
    price = graphs.Graph([(0, 0, 2, 2, 0.3)], {0: 0.0})
    return graphs.best_paths(graphs.composed(rows, change, price), 1).select("utt_id", r6("cost").alias("cost"))


@query(f"WITH {SLOT_SYM}, m AS (SELECT user_id, slot, -ln(post) AS c FROM z) SELECT user_id, round(min(low) - ln(sum(exp(low - c))), 6) AS total FROM (SELECT user_id, c, min(c) OVER (PARTITION BY user_id) AS low FROM m) GROUP BY user_id")
def cost_logsumexp(spark, d):
    rows = slot_symbols(spark, d).select("user_id", (-F.ln("post")).alias("c"))
    return models.logsumexp(rows, ["user_id"], "c").select("user_id", r6("total").alias("total"))


@query(f"WITH {SLOTS} SELECT user_id, slot::TIMESTAMP AS slot, round(min(-ln(post) * 1.0 + n * 0.1), 6) AS cost FROM p GROUP BY user_id, slot")
def scaled_costs(spark, d):
    rows = _slots(spark, d).withColumn("cost", graphs.scaled(-F.ln("post"), F.col("n")))
    return rows.groupBy("user_id", "slot").agg(r6(F.min("cost")).alias("cost"))


@query("SELECT user_id, substr(event_type, 1, 1) AS output, min(value) AS cost FROM events GROUP BY ALL")
def nbest_dedup(spark, d):
    rows = table(spark, d, "events").select("user_id", F.substring("event_type", 1, 1).alias("output"), F.col("value").alias("cost"))
    return graphs.distinct_outputs(rows, ["user_id"], "output")


@query("""WITH x AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, event_type AS phone, round(min(f) * 0.02, 2) AS start, round(count(*) * 0.02, 2) AS dur FROM x GROUP BY user_id, event_type, g""")
def frame_runs(spark, d):
    """Frames collapsed to timed runs of one symbol."""
    every, own = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumns({"f": F.row_number().over(every) - 1, "g": F.row_number().over(every) - F.row_number().over(own)})
    return rows.groupBy("user_id", F.col("event_type").alias("phone"), "g").agg(F.round(F.min("f") * 0.02, 2).alias("start"), F.round(F.count("*") * 0.02, 2).alias("dur")).drop("g")


@query(f"WITH {NORM}, x AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS w, unnest(range(1, n_words + 1)) AS i FROM c), q AS (SELECT doc_id, line_no, i, CASE WHEN w = '<unk>' THEN [w] ELSE list_filter(string_split(regexp_replace(w, '(tion|der)', '|\\1|', 'g'), '|'), lambda y: y <> '') END AS ps FROM x), f AS (SELECT doc_id, line_no, i, array_to_string(list_transform(ps, lambda y: CASE WHEN y IN ('<unk>', 'tion', 'der') THEN y ELSE regexp_replace(y, '(.)', '\\1@@ ', 'g')[:-4] END), '@@ ') AS t FROM q) SELECT doc_id, line_no, string_agg(t, ' ' ORDER BY i) AS tokenised FROM f GROUP BY doc_id, line_no")
def glossary_isolation(spark, d):
    """No merges, so letters are pieces; glossary entries stay whole wherever they stand in a word."""
    return bpe.apply(corpus(spark, d).select("doc_id", "line_no", "line"), [], glossary=("<unk>", "tion", "der")).select("doc_id", "line_no", "tokenised")


# --- the cipher without context ----------------------------------------------

EM_STEPS, EM_STARTS = 5, 4


def _letter_counts(spark, d) -> DataFrame:
    """(sym, n): letters a-z of the corpus as 2 to 27."""
    return ngrams.ngrams(corpus(spark, d).select(ngrams.line_words(F.col("line")).alias("words")), 1).where("sym between 'a' and 'z'").select((F.ascii("sym") - 95).alias("sym"), "n")


def _em_sql() -> str:
    """Steps one after another; each is a common table expression."""
    start = f"raw AS (SELECT r::INTEGER AS restart, s::INTEGER AS src, t::INTEGER AS tgt, CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE (('0x' || substr(md5(r || '/' || t || '/' || s), 1, 8))::BIGINT::DOUBLE + 1) / 4294967296.0::DOUBLE END AS u FROM range(1, {EM_STARTS + 1}) a(r), range(2, 28) b(t), range(2, 28) c(s)), l0 AS (SELECT restart, src, tgt, u / sum(u) OVER (PARTITION BY restart, tgt) AS p FROM raw)"
    parts = [NORM, "lt AS (SELECT ch, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(replace(replace(line, '<unk>', ''), ' ', ''), '')) AS ch FROM c) WHERE ch BETWEEN 'a' AND 'z' GROUP BY ch)", "tg AS (SELECT (ascii(ch) - 95)::INTEGER AS tgt, n / sum(n) OVER () AS q FROM lt)", "ob AS (SELECT (2 + (ascii(ch) - 97 + 7) % 26)::INTEGER AS src, n FROM lt)", start]
    for k in range(EM_STEPS):
        parts.append(f"j{k} AS (SELECT restart, src, tgt, n, q * p AS w, sum(q * p) OVER (PARTITION BY restart, src) AS z FROM l{k} JOIN ob USING (src) JOIN tg USING (tgt))")
        parts.append(f"e{k} AS (SELECT restart, {k} AS iter, -sum(n * ln(z)) AS cost FROM (SELECT DISTINCT restart, src, n, z FROM j{k}) GROUP BY restart)")
        parts.append(f"l{k + 1} AS (SELECT restart, src, tgt, n * w / z / sum(n * w / z) OVER (PARTITION BY restart, tgt) AS p FROM j{k})")
    return "WITH " + ", ".join(parts)


_EM_LOG = " UNION ALL ".join(f"SELECT restart, iter, cost FROM e{k}" for k in range(EM_STEPS))


def _em(spark, d) -> tuple[DataFrame, DataFrame]:
    letters = _letter_counts(spark, d)
    target = letters.select(F.col("sym").alias("tgt"), (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("q"))
    seen = letters.select((2 + (F.col("sym") - 2 + 7) % 26).alias("src"), "n")
    start = models.lexical(spark, 28, 27, EM_STARTS)
    return cipher.context_free(seen, target, start, EM_STEPS)


@query(f"{_em_sql()} SELECT restart, iter, round(cost, 2) AS cost FROM ({_EM_LOG})")
def em_contextfree_iterations(spark, d):
    return _em(spark, d)[1].withColumn("cost", F.round("cost", 2))


@query(f"{_em_sql()} SELECT restart, round(cost, 2) AS cost FROM ({_EM_LOG}) WHERE iter = {EM_STEPS - 1} QUALIFY row_number() OVER (ORDER BY round(cost, 2), restart) = 1")
def restart_argmin(spark, d):
    last = _em(spark, d)[1].where(F.col("iter") == EM_STEPS - 1).withColumn("cost", F.round("cost", 2))
    return last.agg(F.min(F.struct("cost", "restart")).alias("b")).select("b.restart", "b.cost")


@query(f"{_em_sql()} SELECT restart, src, tgt, round(p, 6) AS p FROM l{EM_STEPS} WHERE restart = 2")
def em_contextfree_lexicon(spark, d):
    return _em(spark, d)[0].where("restart = 2").select("restart", "src", "tgt", r6("p").alias("p"))
