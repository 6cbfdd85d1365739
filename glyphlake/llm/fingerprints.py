"""Operator 4 (native): homomorphic multiset fingerprints.

A text is a multiset of paragraphs (lines, cut after sentence ends too, with their separators). Each
paragraph is hashed to a wide vector and the vectors are summed: 8 lanes of 32 uniform bits modulo 2**32
decide equality whatever the order, and 128 lanes of one bit, modulo 2**16 in the printed form, count signs.
Inserting or deleting a paragraph adds or subtracts its vector. The sign lanes of a difference have variance
equal to the number of paragraphs that two texts don't share, which gives the likeness.

Rows are dealt by ranges of the id, four for each shuffle partition, whose borders are quantiles over all rows, so the next
document is found without a global sort; each range also gets a copy of the first document of the range
after it.

Rows with the same id are ordered by their text; a null id comes last; a null text is empty; very long texts are taken whole; an
only row is its own next document; an empty table gives an empty result; columns besides the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import documents, let

#: Fixed parts of the vector.
EQUALITY_LANES, SIGN_LANES = 8, 128

_UNIT_END = r"(?<=\n)|(?<=[.!?][ ])"


def units(text: Column) -> Column:
    """Paragraphs with their separators; joined they are the text again. None for an empty text."""
    return F.filter(F.split(text, _UNIT_END), lambda u: u != "")


def _halves(hashes: list[Column]) -> list[Column]:
    return [half for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]


def _bound_range(id_: Column, borders: list[int]) -> Column:
    """Number of borders that are not above the id, by binary search."""
    if not borders:
        return F.lit(0)
    # One literal that is folded once, however many borders there are.
    b = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(len(borders).bit_length()))

    def half(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        go = (s["lo"] < s["hi"]) & (F.get(b, mid) <= id_)
        return F.struct(F.when(go, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(go | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(borders)).alias("hi")), half, lambda s: s["lo"])
    return F.when(id_.isNull(), F.lit(-1)).otherwise(found)


def _likeness(a: Column, b: Column) -> Column:
    """1 - (estimated paragraphs not shared) / (paragraphs of both); two empty texts are alike."""
    low = F.lit((1 << 32) - 1)

    def signs(x: Column, y: Column) -> Column:
        # Each long holds two lanes; a lane counts ones, and twice that less the number of paragraphs is its sum of signs.
        gap = (y["n"] - x["n"]).cast("double")

        def square(p: Column, q: Column) -> Column:
            d1 = (q.bitwiseAND(low) - p.bitwiseAND(low)).cast("double") * 2 - gap
            d2 = (F.shiftright(q, 32) - F.shiftright(p, 32)).cast("double") * 2 - gap
            return d1 * d1 + d2 * d2

        total = F.aggregate(F.zip_with(x["s"], y["s"], square), F.lit(0.0), lambda t, v: t + v)
        return total / SIGN_LANES

    both = (a["n"] + b["n"]).cast("double")
    return F.when(both == 0, F.lit(1.0)).when(a["e"] == b["e"], F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - signs(a, b) / both)))


def _printed(v: Column) -> Column:
    lane = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    low16 = F.lit(0xFFFF)
    return F.concat(F.array_join(F.transform(v["e"], lambda x: lane(x, 8)), ""), lane(v["n"].bitwiseAND(low16), 4), F.array_join(F.transform(v["s"], lambda x: F.concat(lane(x.bitwiseAND(low16), 4), lane(F.shiftright(x, 32).bitwiseAND(low16), 4))), ""))


def _vector_sums(unit: str) -> list[Column]:
    ones = F.lit(0x0000000100000001)
    e = [F.sum(c).bitwiseAND(F.lit((1 << 32) - 1)).alias(f"e{k}") for k, c in enumerate(F.col(f"h{k}") for k in range(EQUALITY_LANES))]
    # Bits b and b + 16 of a 32-bit word become the low halves of one long.
    s = [F.sum(F.shiftright(F.col(f"g{w}"), b).bitwiseAND(ones)).alias(f"s{16 * w + b}") for w in range(SIGN_LANES // 32) for b in range(16)]
    return [*e, *s, F.count(unit).alias("n")]


def _hashed(rows: DataFrame, unit: str) -> DataFrame:
    """32 bits for each lane of equality and each word of signs, from 64-bit hashes with different seeds; a null unit has zeros."""
    spread = lambda w: w.bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.shiftleft(F.shiftright(w, 16), 32))
    seeded = lambda first, n: _halves([F.xxhash64(F.lit(first + k), unit) for k in range(n // 2)])
    there = lambda c: F.when(F.col(unit).isNotNull(), c).otherwise(F.lit(0))
    names = {f"h{k}": there(c) for k, c in enumerate(seeded(1, EQUALITY_LANES))}
    names |= {f"g{k}": there(spread(c)) for k, c in enumerate(seeded(101, SIGN_LANES // 32))}
    return rows.withColumns(names)


def _as_vector() -> Column:
    return F.struct(F.array(*[F.col(f"e{k}") for k in range(EQUALITY_LANES)]).alias("e"), F.array(*[F.col(f"s{k}") for k in range(SIGN_LANES // 2)]).alias("s"), F.col("n"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its vector ``v`` (struct of lanes ``e``, ``s`` and the number of paragraphs ``n``); rows of one id are summed."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.explode_outer(units(docs[text_col])).alias("unit"))
    return _hashed(rows, "unit").groupBy("doc_id").agg(*_vector_sums("unit")).select("doc_id", _as_vector().alias("v"))


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector after the paragraphs of ``b`` were inserted (sign 1) or deleted (sign -1)."""
    return F.struct(F.zip_with(a["e"], b["e"], lambda x, y: (x + sign * y).bitwiseAND(F.lit((1 << 32) - 1))).alias("e"), F.zip_with(a["s"], b["s"], lambda x, y: x + sign * y).alias("s"), (a["n"] + sign * b["n"]).alias("n"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, its edited text and its next document, with their likeness."""
    spark = docs.sparkSession
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    ranges = max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = src.select(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else None
    dealt = src.withColumn("part", _bound_range(F.col("doc_id"), sorted(set(got or []))))
    # At most one row for each range from here to ``heads``.
    tops = dealt.groupBy("part").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy(F.desc("part"))
    tops = tops.withColumns({"to": F.lag("part").over(order), "last": F.min("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    tops = tops.select("part", "top", F.coalesce("to", "last").alias("to"))
    heads = dealt.alias("d").join(F.broadcast(tops.alias("t")), (F.col("d.part") == F.col("t.part")) & F.col("d.doc_id").eqNullSafe(F.col("t.top"))).groupBy(F.col("t.to").alias("part"), F.col("t.top").alias("doc_id")).agg(F.min("text").alias("text"))
    every = dealt.withColumn("extra", F.lit(False)).unionByName(heads.select("doc_id", "text", "part", F.lit(True).alias("extra")))
    w = Window.partitionBy("part").orderBy("extra", F.desc_nulls_last("doc_id"), "text")
    rows = every.select("part", "doc_id", "extra", "text", F.row_number().over(w).alias("at"), F.lead("text").over(w).alias("after"), F.length("text").cast("long").alias("n_chars"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 3) as int))"), F.substring(F.coalesce("after", F.lit("")), F.lit(1), third))
    versions = F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("t")), F.struct(F.lit(1).alias("version"), edited.alias("t")))
    both = rows.select("part", "at", "doc_id", "extra", "n_chars", F.explode(F.when(F.col("extra"), F.slice(versions, 1, 1)).otherwise(versions)).alias("x"))
    both = both.select("part", "at", "doc_id", "extra", "n_chars", "x.version", F.when(F.col("x.version") == 1, F.sha2(F.col("x.t").cast("binary"), 256)).alias("sha"), F.explode_outer(units(F.col("x.t"))).alias("unit"))
    keys = ["part", "at", "version", "doc_id", "extra", "n_chars", "sha"]
    vectors = _hashed(both, "unit").groupBy(*keys).agg(*_vector_sums("unit")).select(*keys, _as_vector().alias("v"))
    o = Window.partitionBy("part").orderBy("at", "version")
    lined = vectors.select("part", "version", "extra", "doc_id", "n_chars", F.col("v").alias("own"), F.lead("sha").over(o).alias("edited_sha256"), F.lead("v").over(o).alias("edited"), F.lead("v", 2).over(o).alias("next"))
    out = lined.where("version = 0 and not extra")
    return out.select("doc_id", "n_chars", "edited_sha256", _printed(F.col("own")).alias("fingerprint"), _printed(F.col("edited")).alias("edited_fingerprint"), F.round(_likeness(F.col("own"), F.col("edited")), 6).alias("near_edited"), F.round(_likeness(F.col("own"), F.col("next")), 6).alias("near_next"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(documents(spark, sf_dir))
