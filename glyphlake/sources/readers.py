"""Sources and sinks: text files, symbol tables, arcs, lexicons, archives of audio paths, hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.functions.text import lines, nfc


def json_text(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """(doc_id, line_no, line) of JSON-lines files (compressed or not), with written-out line ends expanded.

    The id sorts as the input does: the file's path, where its piece of the file begins and the record's number in the piece; equal records have ids of their own.
    """
    raw = spark.read.schema(f"`{field}` string").json(path).select(F.col(field).alias("text"), "_metadata.file_path", "_metadata.file_block_start")
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    key = F.concat_ws(":", "file_path", F.lpad(F.col("file_block_start").cast("string"), 16, "0"), F.lpad(number.cast("string"), 10, "0"))
    return lines(raw.select(key.alias("doc_id"), "text"), escapes=True)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))


def int_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``utt 3 1 2`` lines to (utt_id, syms)."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("utt_id"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.cast("int")).alias("syms"))


def merges(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(rank, lft, rgt) of a merge file; a version header is skipped, the first of equal pairs counts, other lines must have two fields."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    parts = F.split("line", " ")
    rows = raw.where("line <> '' and not (at = 0 and startswith(line, '#version'))").select("at", F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("not a pair: "), "line"))).alias("p"))
    ranked = rows.groupBy(F.col("p")[0].alias("lft"), F.col("p")[1].alias("rgt")).agg(F.min("at").alias("at")).select((F.row_number().over(Window.orderBy("at")) - 1).alias("rank"), "lft", "rgt")
    return ranked if limit is None else ranked.where(F.col("rank") < limit)


def vocabulary(spark: SparkSession, path: str, threshold: int = 0) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("word"), parts[1].cast("long").alias("freq")).where(F.col("freq") >= threshold)


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word prob phones…`` lines to (word in NFC, prob, phones)."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(nfc(parts[0]).alias("word"), parts[1].cast("double").alias("prob"), F.slice(parts, F.lit(3), F.size(parts)).alias("phones"))


def arcs(spark: SparkSession, path: str) -> DataFrame:
    """``src dst in out [cost]`` lines; a missing cost is 0, shorter lines (final states) are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    i = lambda k: F.get(parts, F.lit(k)).cast("int")
    rows = spark.read.text(path).where(F.size(parts) >= 4)
    return rows.select(i(0).alias("src"), i(1).alias("dst"), i(2).alias("isym"), i(3).alias("osym"), F.coalesce(F.get(parts, F.lit(4)).cast("double"), F.lit(0.0)).alias("cost"))


def symbols(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("sym"), parts[1].cast("int").alias("id"))


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """(utt_id, path) of the WAV files in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("utt_id"), "path")


def encode(rows: DataFrame, table: DataFrame, col: str = "syms") -> DataFrame:
    """Symbol names to ids; an unknown one is an error. The table is an alphabet; Catalyst broadcasts it while it is small."""
    flat = rows.select(*[c for c in rows.columns if c != col], F.posexplode_outer(col).alias("_at", "sym")).join(table, "sym", "left")
    checked = F.when(F.col("id").isNull() & F.col("sym").isNotNull(), F.raise_error(F.concat(F.lit("unknown symbol: "), "sym"))).otherwise(F.col("id"))
    kept = [c for c in rows.columns if c != col]
    grouped = flat.withColumn("id", checked).groupBy(*kept).agg(F.sort_array(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "id")))).alias("_x"))
    return grouped.select(*kept, F.transform("_x", lambda x: x["id"]).alias(col))


def durations(frames: DataFrame, shift: float = 0.02) -> DataFrame:
    return frames.withColumn("dur", F.round(F.col("num_frames") * shift, 2))


def write_hypotheses(found: DataFrame, path: str, utterances: DataFrame | None = None) -> None:
    """Decoded rows; with ``utterances``, those without a result get an empty one."""
    out = found if utterances is None else utterances.select("utt_id").join(found, "utt_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<int>")))
    out.write.mode("overwrite").parquet(path)


# --- archives of graphs ---------------------------------------------------------

ARC = "src\tdst\tisym\tosym\tcost"


def graph_archive(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, arcs, finals) of a text archive: a key, a line for each arc (four fields or five) or final state (one or two), a blank line."""
    rows = spark.read.text(path, lineSep="\n\n").select(F.filter(F.split(F.regexp_replace("value", "^\n+", ""), "\n"), lambda x: F.trim(x) != "").alias("l")).where(F.size("l") > 0)
    body = F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x: F.split(F.trim(x), r"\s+"))
    num = lambda x, k, to: F.get(x, F.lit(k)).cast(to)
    arc = lambda x: F.struct(num(x, 0, "int").alias("src"), num(x, 1, "int").alias("dst"), num(x, 2, "int").alias("isym"), num(x, 3, "int").alias("osym"), F.coalesce(num(x, 4, "double"), F.lit(0.0)).alias("cost"))
    end = lambda x: F.struct(num(x, 0, "int").alias("state"), F.coalesce(num(x, 1, "double"), F.lit(0.0)).alias("cost"))
    return rows.select(F.trim(F.col("l")[0]).alias("utt_id"), F.transform(F.filter(body, lambda x: F.size(x) >= 4), arc).alias("arcs"), F.transform(F.filter(body, lambda x: F.size(x) < 4), end).alias("finals"))


def write_graph_archive(graphs: DataFrame, path: str) -> None:
    """The text archive that ``graph_archive`` reads; one file for each partition."""
    line = F.transform("arcs", lambda x: F.concat_ws("\t", *[x[c].cast("string") for c in ARC.split("\t")]))
    ends = F.transform("finals", lambda x: F.concat_ws("\t", x["state"].cast("string"), x["cost"].cast("string")))
    graphs.select(F.array_join(F.concat(F.array("utt_id"), line, ends), "\n").alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def posteriors(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, slots) of ``utt slot sym posterior`` lines: alternatives of each slot from the likeliest, ties by symbol, as costs. Lattices are accepted in this form."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("utt_id"), parts[1].cast("int").alias("slot"), parts[2].cast("int").alias("sym"), parts[3].cast("double").alias("post"))
    alts = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("post")).alias("o"), "sym"))), lambda x: F.struct(x["sym"].alias("sym"), (-F.ln(-x["o"])).alias("cost")))
    slots = rows.groupBy("utt_id", "slot").agg(alts.alias("alts"))
    return slots.groupBy("utt_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "alts"))), lambda x: x["alts"]).alias("slots"))


# --- segments, models ---------------------------------------------------------------

def segments(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, rec_id, start, end) of ``utt rec start end`` lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("utt_id"), parts[1].alias("rec_id"), parts[2].cast("double").alias("start"), parts[3].cast("double").alias("end"))


def segmented(files: DataFrame, parts: DataFrame | None, durations: DataFrame | None = None) -> DataFrame:
    """(utt_id, path, start, end) of recordings (utt_id, path) cut by segments; without segments each recording is one utterance.

    With ``durations`` (utt_id, dur of a recording), segments that begin after its end are dropped and the others end with it.
    """
    if parts is None:
        return files.select("utt_id", "path", F.lit(0.0).alias("start"), F.lit(None).cast("double").alias("end"))
    rows = parts.where("end > start").join(files.select(F.col("utt_id").alias("rec_id"), "path"), "rec_id")
    if durations is not None:
        rows = rows.join(durations.select(F.col("utt_id").alias("rec_id"), "dur"), "rec_id").where("start < dur").withColumn("end", F.least("end", "dur"))
    return rows.select("utt_id", "path", "start", "end")


def write_arcs(arcs: DataFrame, path: str) -> None:
    """A model's arcs (src, dst, isym, osym, cost) as text, which ``arcs`` reads back; the cost is always written."""
    arcs.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ARC.split("\t")]).alias("value")).write.mode("overwrite").text(path)


def combined(tables: list[DataFrame], order: list[str]) -> DataFrame:
    """Shards as one table in the order of their names, which stands in a column of its own, then of ``order``."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("shard", F.lit(k))
        out = t if out is None else out.unionByName(t)
    return out.orderBy("shard", *order)
