"""Subtitles: cues timed by characters over chunks of known duration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.sources.sinks import placed

# Longest sentence of a cue, longest and shortest cue, and the text a cue must have to be split.
MAX_CHARS, MAX_SECONDS, MIN_SECONDS, SPLIT_CHARS = 90, 7.0, 0.6, 40


def split_sentences(text: Column) -> Column:
    """Sentences of a text; those over MAX_CHARS are packed anew from their clauses."""
    parts = F.filter(F.transform(F.split(strip(text), r"(?U)(?<=[.!?])\s+", -1), strip), lambda p: p != "")

    def pack(p: Column) -> Column:
        def put(state: Column, piece: Column) -> Column:
            longer = strip(F.concat(state["buf"], F.lit(" "), piece))
            full = (state["buf"] != "") & (F.length(longer) > MAX_CHARS)
            return F.struct(F.when(full, F.concat(state["out"], F.array(state["buf"]))).otherwise(state["out"]).alias("out"), F.when(full, piece).otherwise(longer).alias("buf"))

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))
        packed = F.aggregate(F.split(p, r"(?U)(?<=[,;:])\s+", -1), start, put, lambda s: F.concat(s["out"], F.filter(F.array(s["buf"]), lambda b: b != "")))
        return F.when(F.length(p) <= MAX_CHARS, F.array(p)).otherwise(packed)

    return F.flatten(F.transform(parts, pack))


def clock(chunks: DataFrame) -> DataFrame:
    """Adds start to (job_id, index, text, duration): the time before each chunk."""
    before = Window.partitionBy("job_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("start", F.coalesce(F.sum(F.greatest("duration", F.lit(0.0))).over(before), F.lit(0.0)))


def spans(timed: DataFrame) -> DataFrame:
    """(job_id, index, k, start, end, text): sentences of each chunk with a share of its time by length."""
    rows = timed.where((F.col("duration") > 0) & (strip(F.col("text")) != "")).select("job_id", "index", "start", "duration", F.posexplode(split_sentences(F.col("text"))).alias("k", "text"))
    chunk = Window.partitionBy("job_id", "index")
    upto = chunk.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"chars": F.sum(F.length("text")).over(upto), "total": F.sum(F.length("text")).over(chunk), "n": F.count("*").over(chunk), "own": F.length("text")})
    end = F.when(F.col("k") == F.col("n") - 1, F.col("start") + F.col("duration")).otherwise(F.col("start") + F.col("duration") * (F.col("chars") / F.col("total")))
    begin = F.col("start") + F.col("duration") * ((F.col("chars") - F.col("own")) / F.col("total"))
    return rows.select("job_id", "index", "k", begin.alias("start"), end.alias("end"), "text")


def merge_short(cues: DataFrame) -> DataFrame:
    """(job_id, g, start, end, text): spans under MIN_SECONDS join the one before them; the first never does."""
    order = Window.partitionBy("job_id").orderBy("index", "k")
    opens = (F.row_number().over(order) == 1) | (F.col("end") - F.col("start") >= MIN_SECONDS)
    grouped = cues.withColumn("opens", opens.cast("int")).withColumn("g", F.sum("opens").over(order))
    texts = F.array_sort(F.collect_list(F.struct("index", "k", "text")))
    return grouped.groupBy("job_id", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), strip(F.array_join(F.transform(texts, lambda x: x["text"]), " ")).alias("text"))


def split_long(cues: DataFrame) -> DataFrame:
    """(job_id, g, part, start, end, text): cues over MAX_SECONDS are cut into even times and even numbers of words."""
    span = F.col("end") - F.col("start")
    long = (span > MAX_SECONDS) & (F.length("text") > SPLIT_CHARS)
    rows = cues.withColumn("parts", F.when(long, F.greatest(F.lit(2), F.floor(span / MAX_SECONDS).cast("int") + 1)).otherwise(1))
    rows = rows.withColumn("words", F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).withColumn("per", F.greatest(F.lit(1), F.floor(F.size("words") / F.col("parts")).cast("int")))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    last = F.col("part") == F.col("parts") - 1
    piece = F.array_join(F.slice("words", F.col("part") * F.col("per") + 1, F.when(last, F.size("words")).otherwise(F.col("per"))), " ")
    step = span / F.col("parts")
    one = F.col("parts") == 1
    out = rows.select("job_id", "g", "part", F.when(one, F.col("start")).otherwise(F.col("start") + F.col("part") * step).alias("start"), F.when(one, F.col("end")).otherwise(F.col("start") + (F.col("part") + 1) * step).alias("end"), F.when(one, F.col("text")).otherwise(piece).alias("text"))
    return out.where("text <> ''")


def build_cues(chunks: DataFrame) -> DataFrame:
    """(job_id, cue_index, start, end, text) from job_id, index, text, duration."""
    cues = split_long(merge_short(spans(clock(chunks))))
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("g", "part"))
    return cues.select("job_id", number.alias("cue_index"), "start", "end", "text")


def stamp(seconds: Column, separator: str = ",") -> Column:
    """hh:mm:ss,mmm; milliseconds half to even, at most 999."""
    s = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(s)
    ms = F.least(F.rint((s - whole) * 1000), F.lit(999.0)).cast("int")
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, ms)


def _times(separator: str) -> Column:
    return F.concat(stamp(F.col("start"), separator), F.lit(" --> "), stamp(F.col("end"), separator))


def _srt_block() -> Column:
    return F.concat_ws("\n", F.col("cue_index").cast("string"), _times(","), F.col("text"))


def _vtt_block() -> Column:
    return F.concat_ws("\n", _times("."), F.col("text"))


def subtitle_blocks(cues: DataFrame, name: Column, vtt: bool = False) -> DataFrame:
    """(name, at, content): the cues (job_id, cue_index from 1, start, end, text) of each job as blocks of its file, for ``sinks.write_files``.

    ``name`` is the file's name, the same for all cues of a job.  Joined by ``at`` they are the documents of ``to_srt`` or ``to_vtt``.
    """
    first = F.when(F.col("cue_index") == 1, "WEBVTT\n\n" if vtt else "").otherwise("\n")
    return placed(cues.withColumn("name", name), "cue_index", F.concat(first, _vtt_block() if vtt else _srt_block(), F.lit("\n")))


def _document(cues: DataFrame, block: Column, head: str, tail: str) -> DataFrame:
    blocks = F.array_sort(F.collect_list(F.struct("cue_index", block.alias("b"))))
    return cues.groupBy("job_id").agg(F.concat(F.lit(head), F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n"), F.lit(tail)).alias("document"))


def to_srt(cues: DataFrame) -> DataFrame:
    """(job_id, document): SubRip."""
    return _document(cues, _srt_block(), "", "\n")


def to_vtt(cues: DataFrame) -> DataFrame:
    """(job_id, document): WebVTT."""
    return _document(cues, _vtt_block(), "WEBVTT\n\n", "\n")
