"""Letter n-gram counts and language models as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.text import UNK, bound

SIL = "_"


def line_words(line: Column) -> Column:
    """A normalised line's words without the unknown ones."""
    return F.filter(F.split(line, " "), lambda w: ~w.isin("", UNK))


def letters(words: Column) -> Column:
    """Letters with silence between words and at both ends."""
    return F.filter(F.split(F.concat(F.lit(SIL), F.array_join(words, SIL), F.lit(SIL)), ""), lambda c: c != "")


def ngrams(sequences: DataFrame, order: int, words: str = "words") -> DataFrame:
    """(ctx, sym, n): counts of every run of ``order`` symbols of the letters of ``words``; ``ctx`` joins all but the last.

    The runs that begin at a word (or at the silence before it) depend on the word and on the ``order - 1`` symbols
    after it only. Those pieces are counted first, and each distinct one is cut once. The last silence is a word without letters.
    """

    def cut(w: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            ahead = F.array_join(F.slice(w, i + 2, order - 1), SIL)
            return F.struct(F.concat(F.lit(SIL), x).alias("own"), F.left(F.concat(F.when(i + 1 < F.size(w), F.lit(SIL)).otherwise(F.lit("")), ahead), F.lit(order - 1)).alias("ahead"))

        return F.transform(w, piece)

    pieces = sequences.select(F.explode(bound(F.concat(words, F.array(F.lit(""))), cut)).alias("p")).groupBy(F.col("p.own").alias("own"), F.col("p.ahead").alias("ahead")).agg(F.count("*").alias("k"))
    text, starts = F.concat("own", "ahead"), F.least(F.length("own"), F.length("own") + F.length("ahead") - order + 1)
    runs = pieces.where(starts > 0).select("k", F.explode(F.transform(F.sequence(F.lit(1), starts), lambda i: F.substring(text, i, F.lit(order)))).alias("g"))
    return runs.groupBy("g").agg(F.sum("k").alias("n")).select(F.left("g", F.lit(order - 1)).alias("ctx"), F.right("g", F.lit(1)).alias("sym"), "n")


def mle(counts: DataFrame) -> DataFrame:
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("ctx")))


def unigram_witten_bell(uni: DataFrame) -> DataFrame:
    """p(w) = (c(w) + T / V) / (C + T) with T = V observed types."""
    total = uni.agg(F.sum("n").alias("c"), F.count("*").alias("t"))
    return uni.crossJoin(F.broadcast(total)).select("sym", ((F.col("n") + 1) / (F.col("c") + F.col("t"))).alias("p"))


def witten_bell(bi: DataFrame, uni: DataFrame) -> DataFrame:
    """p(w|h) = (c(h,w) + T(h) p(w)) / (c(h) + T(h))."""
    w = Window.partitionBy("ctx")
    rows = bi.withColumns({"c": F.sum("n").over(w), "t": F.count("*").over(w)}).join(unigram_witten_bell(uni), "sym")
    return rows.select("ctx", "sym", ((F.col("n") + F.col("t") * F.col("p")) / (F.col("c") + F.col("t"))).alias("p"))


def continuation_counts(bi: DataFrame) -> DataFrame:
    return bi.groupBy("sym").agg(F.count("*").alias("n_left"))


def discounts(counts: DataFrame) -> DataFrame:
    """The three discounts of modified Kneser-Ney, as one row."""
    n = [F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    # A count of counts of 0 leaves the discount without an estimate: no discount then.
    d = lambda k: F.greatest(F.lit(0.0), F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.0)))
    return counts.agg(*n).select(d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3"))


def kneser_ney(bi: DataFrame) -> DataFrame:
    """Interpolated modified Kneser-Ney bigrams over continuation unigrams."""
    cont = continuation_counts(bi)
    p_low = cont.crossJoin(F.broadcast(bi.agg(F.count("*").alias("all")))).select("sym", (F.col("n_left") / F.col("all")).alias("low"))
    w = Window.partitionBy("ctx")
    rows = bi.crossJoin(F.broadcast(discounts(bi)))
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = rows.withColumn("d", d).withColumns({"c": F.sum("n").over(w), "gamma": F.sum("d").over(w)}).join(p_low, "sym")
    return rows.select("ctx", "sym", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("c") + F.col("gamma") / F.col("c") * F.col("low")).alias("p"))


def extra_contexts(counts: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` most frequent contexts; ties by the context."""
    return counts.groupBy("ctx").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ctx").limit(keep)


def backoff_tables(sequences: DataFrame, order: int) -> list[DataFrame]:
    """Maximum-likelihood tables of orders 1 to ``order``, kept, as scoring reads them for every n-gram."""
    return [mle(ngrams(sequences, k)).persist() for k in range(1, order + 1)]


def backoff_score(grams: DataFrame, tables: list[DataFrame], penalty: float = 0.4) -> DataFrame:
    """Score of (id, ctx, sym) rows by the longest context that has the symbol; each step back costs ``penalty``.

    The context's last letters are the shorter ones' contexts. Left joins with tables whose size is bounded by the
    alphabet to the power of the order; Catalyst broadcasts them while they are small and shuffles them otherwise.
    """
    out = grams
    probs = []
    for k in range(len(tables), 0, -1):
        t = tables[k - 1].select(F.col("ctx").alias("_c"), F.col("sym").alias("_s"), F.col("p").alias(f"_p{k}"))
        short = F.right(F.col("ctx"), F.lit(k - 1)) if k > 1 else F.lit("")
        out = out.join(t, (short == F.col("_c")) & (F.col("sym") == F.col("_s")), "left").drop("_c", "_s")
        probs.append(F.col(f"_p{k}") * penalty ** (len(tables) - k))
    return out.withColumn("p", F.coalesce(*probs, F.lit(1e-7))).select(*grams.columns, "p")


def lower_counts(counts: DataFrame) -> DataFrame:
    """Continuation counts of one order less: in how many contexts a shorter n-gram's first symbol is followed by the rest."""
    return counts.groupBy(F.substring("ctx", 2, 1 << 20).alias("ctx"), "sym").agg(F.count("*").alias("n"))


def interpolated(counts: DataFrame, lower: DataFrame) -> DataFrame:
    """(ctx, sym, p, low, bow): modified Kneser-Ney over the ``lower`` model (ctx, sym, p); ``bow`` is the context's backoff weight."""
    w = Window.partitionBy("ctx")
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = counts.crossJoin(F.broadcast(discounts(counts))).withColumn("d", d).withColumns({"c": F.sum("n").over(w), "g": F.sum("d").over(w)})  # the broadcast is one row
    down = lower.select(F.col("ctx").alias("_c"), F.col("sym").alias("_s"), F.col("p").alias("low"))
    rows = rows.join(down, (F.substring("ctx", 2, 1 << 20) == F.col("_c")) & (F.col("sym") == F.col("_s")))
    return rows.select("ctx", "sym", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("c") + F.col("g") / F.col("c") * F.col("low")).alias("p"), "low", (F.col("g") / F.col("c")).alias("bow"))


def kneser_ney_model(counts: DataFrame, order: int) -> list[DataFrame]:
    """Tables (ctx, sym, p, low, bow) of the orders 1 to ``order`` from the highest order's counts.

    Lower orders count continuations, single symbols have Witten-Bell probabilities. Each level is small next to the one above it.
    """
    levels = [counts]
    for _ in range(order - 1):
        levels.append(lower_counts(levels[-1]))
    out = [unigram_witten_bell(levels[-1].select("sym", "n")).select(F.lit("").alias("ctx"), "sym", "p", F.lit(0.0).alias("low"), F.lit(0.0).alias("bow"))]
    for table in levels[-2::-1]:
        out.append(interpolated(table, out[-1]).persist())  # each is read for the next one, for scores and for weights
    return out


def pruned(model: list[DataFrame], least: float) -> DataFrame:
    """The highest order (ctx, sym, p, low, bow) without n-grams whose removal raises the perplexity by a share of less than ``least``; weights anew.

    For an n-gram w after h: a' is the backoff weight of h without w, and the loss is
    -P(h) (p(w|h) (ln p(w|h') + ln a' - ln p(w|h)) + (1 - sum of p) (ln a' - ln a)). Contexts that (nearly) fill their lower model are kept.
    """
    top, order = model[-1], len(model)
    w = Window.partitionBy("ctx")
    rows = top.withColumns({"sp": F.sum("p").over(w), "sl": F.sum("low").over(w)})
    hist = _history(rows.select("ctx").distinct(), model[: order - 1])
    rows = rows.join(hist, "ctx").withColumn("a2", F.try_divide(1 - F.col("sp") + F.col("p"), 1 - F.col("sl") + F.col("low")))
    loss = -F.col("ph") * (F.col("p") * (F.ln("low") + F.ln("a2") - F.ln("p")) + (1 - F.col("sp")) * (F.ln("a2") - F.ln("bow")))
    kept = rows.where((F.exp(loss) - 1 >= least) | (1 - F.col("sl") < 1e-6) | (1 - F.col("sp") < 1e-6)).select("ctx", "sym", "p", "low")
    return kept.withColumn("bow", F.try_divide(1 - F.sum("p").over(w), 1 - F.sum("low").over(w)))


def _history(contexts: DataFrame, model: list[DataFrame]) -> DataFrame:
    """(ctx, ph): probability of a context's symbols one after another, by the lower orders."""
    out = contexts.withColumn("ph", F.lit(1.0))
    n = len(model)
    for k in range(n):
        at = out.withColumns({"_h": F.substring("ctx", 1, k), "_y": F.substring("ctx", k + 1, 1)})
        p = phi_probability(at.select("ctx", F.col("_h").alias("h"), F.col("_y").alias("y")), model[: k + 1], "h", "y").select("ctx", F.col("p").alias("_p"))
        out = at.join(p, "ctx").select("ctx", (F.col("ph") * F.col("_p")).alias("ph"))
    return out


def phi_probability(grams: DataFrame, model: list[DataFrame], ctx: str = "ctx", sym: str = "sym", unseen: float = 1e-7) -> DataFrame:
    """``grams`` with ``p``: an n-gram's own probability, else its context's backoff weight times that of the shorter context; an unknown context costs nothing.

    Tables are bounded by the alphabet to the power of the order; Catalyst broadcasts them while they are small.
    """
    out, steps = grams, []
    for k in range(len(model), 0, -1):
        short = F.right(F.col(ctx), F.lit(k - 1)) if k > 1 else F.lit("")
        t = model[k - 1].select(F.col("ctx").alias("_c"), F.col("sym").alias("_s"), F.col("p").alias(f"_p{k}"))
        out = out.join(t, (short == F.col("_c")) & (F.col(sym) == F.col("_s")), "left").drop("_c", "_s")
        if k > 1:
            b = model[k - 1].groupBy("ctx").agg(F.max("bow").alias(f"_b{k}")).withColumnRenamed("ctx", "_c")
            out = out.join(b, short == F.col("_c"), "left").drop("_c")
        steps.append(k)
    p = F.coalesce(F.col("_p1"), F.lit(unseen))
    for k in steps[-2::-1]:
        p = F.coalesce(F.col(f"_p{k}"), F.coalesce(F.col(f"_b{k}"), F.lit(1.0)) * p)
    return out.withColumn("p", p).select(*grams.columns, "p")


def grapheme_model(sequences: DataFrame, order: int, full: int = 3, extra: int = 1000) -> DataFrame:
    """(ctx, sym, p) without smoothing: all contexts up to ``full - 1`` symbols, and of the longest only the ``extra`` most frequent ones (ties by the context); others go on in the shorter state."""
    tables = [mle(ngrams(sequences, k)).select("ctx", "sym", "p") for k in range(1, min(order, full) + 1)]
    if order > full:
        longest = ngrams(sequences, order)
        tables.append(mle(longest.join(extra_contexts(longest, extra).select("ctx"), "ctx", "left_semi")).select("ctx", "sym", "p"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def without_boundary_pairs(table: DataFrame, first: str = "<s>", last: str = "</s>") -> DataFrame:
    """Without n-grams in which a sentence begins twice, or goes on after its end; ``ctx`` is an array."""
    full = F.concat_ws(" ", F.concat("ctx", F.array("sym")))
    bad = [f"{first} {first}", f"{last} {first}", f"{last} {last}"]
    return table.where(~F.exists(F.array(*map(F.lit, bad)), lambda b: F.contains(full, b)))


def boundary_to_epsilon(symbol: Column, disambiguation: str = "#0") -> Column:
    """Backoff moves (epsilon) get a symbol of their own; sentence marks become epsilon."""
    return F.when(symbol == "<eps>", disambiguation).when(symbol.isin("<s>", "</s>"), "<eps>").otherwise(symbol)


def least_unigram(unigrams: DataFrame) -> DataFrame:
    """One row: the smallest log10 probability that isn't the mark -99 for none."""
    return unigrams.where("logp <> -99").agg(F.min("logp").alias("least"))


def with_unknown_words(unigrams: DataFrame, unknown: DataFrame, fraction: float) -> DataFrame:
    """(sym, logp) with the words of ``unknown`` (sym, p): log10(p * fraction), never above the smallest there was."""
    extra = unknown.crossJoin(F.broadcast(least_unigram(unigrams))).select("sym", F.least(F.log10(F.col("p") * fraction), F.col("least")).alias("logp"))
    return unigrams.select("sym", "logp").unionByName(extra)


def rescored(hypotheses: DataFrame, key: list[str], rank: str, total: str, old: str, new: str) -> DataFrame:
    """(key, rank, cost): of each key the hypothesis that is cheapest once the old model's cost is taken out and the new one's put in; ties by rank, costs compared at four digits."""
    cost = F.col(total) - F.col(old) + F.col(new)
    best = F.min(F.struct(F.round(cost, 4).alias("c"), F.col(rank).alias("r"), cost.alias("cost")))
    return hypotheses.groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.r").alias(rank), F.col("b.cost").alias("cost"))
