"""A/B runs: variants, measurements, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import fixed
from lectern.sources.sinks import placed

REPEAT_SEED = 7919
CSV_DIGITS = {"wer": 6, "cer": 6, "score": 6, "similarity": 6, "duration": 3, "seconds": 3}


def build_variants(voices: DataFrame, sweeps: DataFrame) -> DataFrame:
    """(voice, param, value): every voice with every swept value, one parameter at a time.

    The sweeps are settings of a run, few enough for one row; repeated ones count once.  A forced speaker of 1.0 or less sets no parameter.
    """
    values = F.array_sort(F.collect_list(F.struct("param", "value")))
    rows = voices.join(sweeps.distinct().agg(values.alias("sweep")), F.lit(True)).select("voice", F.explode("sweep").alias("s")).select("voice", "s.*")
    off = (F.col("param") == "speaker_force") & (F.col("value") <= 1.0)
    return rows.select("voice", F.when(~off, F.col("param")).alias("param"), F.when(~off, F.col("value")).alias("value"))


def summarize(rows: DataFrame) -> DataFrame:
    """Per variant: n, means of wer, cer, score and known similarities, worst wer, audio and seconds."""
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.avg("wer").alias("wer"), F.avg("cer").alias("cer"), F.avg("score").alias("score"), F.avg("similarity").alias("similarity"), F.max("wer").alias("worst_wer"), F.sum("duration").alias("audio"), F.sum("seconds").alias("seconds"))


def mark_best(summary: DataFrame) -> DataFrame:
    """Adds best (least mean wer) and xrt (seconds per second of audio, 0 without audio)."""
    least = summary.agg(F.min("wer").alias("least"))  # one row
    return summary.join(least, F.lit(True)).withColumns({"best": F.col("wer") == F.col("least"), "xrt": F.when(F.col("audio") > 0, F.col("seconds") / F.col("audio")).otherwise(0.0)}).drop("least")


def spread_time(runs: DataFrame) -> DataFrame:
    """Adds seconds (elapsed over n_chunks, evenly) and seed (shifted by repeat) to base_seed, repeat, elapsed, n_chunks."""
    return runs.withColumns({"seconds": F.col("elapsed") / F.greatest("n_chunks", F.lit(1)), "seed": F.col("base_seed") + REPEAT_SEED * F.col("repeat")})


def csv_columns(rows: DataFrame) -> DataFrame:
    """Measurements as the strings of the CSV file; null is empty."""
    return rows.select(*[_field(c).alias(c) for c in rows.columns])


def _field(c: str) -> Column:
    text = fixed(F.col(c).cast("double"), CSV_DIGITS[c]) if c in CSV_DIGITS else F.col(c).cast("string")
    return F.when(F.col(c).isNull(), "").otherwise(text)


def csv_blocks(rows: DataFrame, name: Column, order: str, drop: list[str] | None = None) -> DataFrame:
    """(name, at, content): measurements as the lines of CSV files, a header first, for ``sinks.write_files``.

    Lines stand by ``order`` (whole numbers from 0, no two alike in a file), which like ``drop`` is no column of the file.  Fields with commas, quotes or
    line ends are quoted; lines end with CR LF.
    """
    columns = [c for c in rows.columns if c not in (order, *(drop or []))]
    text = rows.select(name.alias("_name"), F.col(order).cast("long").alias("_at"), *[_field(c).alias(c) for c in columns])
    quoted = lambda c: F.when(F.col(c).rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    lines = text.select(F.col("_name").alias("name"), F.col("_at").alias("i"), F.concat(F.concat_ws(",", *map(quoted, columns)), F.lit("\r\n")).alias("line"))
    heads = lines.select("name").distinct().select("name", F.lit(-1).cast("long").alias("i"), F.lit(",".join(columns) + "\r\n").alias("line"))
    return placed(lines.unionByName(heads), "i", F.col("line"))
