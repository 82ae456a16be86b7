"""Voices as keyed state: additions, removals, renames, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.settings import voice_name


def add(voices: DataFrame, new: DataFrame) -> DataFrame:
    """Voices with new names added; names already there stay as they are."""
    return voices.unionByName(new.dropDuplicates(["name"]).join(voices, "name", "left_anti").select(*voices.columns))


def remove(voices: DataFrame, names: DataFrame) -> DataFrame:
    return voices.join(names, "name", "left_anti")


def rename_status(voices: DataFrame, requests: DataFrame) -> DataFrame:
    """(old, new, status) for each request (old, new): renamed, missing (no such voice) or taken (the new name exists, or an earlier request by name wants it).

    Of several requests for one voice that of the least new name counts.
    """
    have = voices.select("name").distinct()
    asked = requests.select("old", "new").distinct()
    rows = asked.join(have.select(F.col("name").alias("old"), F.lit(True).alias("there")), "old", "left").join(have.select(F.col("name").alias("new"), F.lit(True).alias("used")), "new", "left")
    able = F.col("there").isNotNull() & F.col("used").isNull()
    first = rows.where(able).groupBy("old").agg(F.min("new").alias("new")).groupBy("new").agg(F.min("old").alias("old")).select("old", "new", F.lit(True).alias("first"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("used").isNotNull() | F.col("first").isNull(), "taken").otherwise("renamed")
    return rows.join(first, ["old", "new"], "left").select("old", "new", status.alias("status"))


def rename(voices: DataFrame, requests: DataFrame) -> DataFrame:
    """Voices with those of the requests (old, new) renamed that ``rename_status`` lets through."""
    done = rename_status(voices, requests).where("status = 'renamed'").select(F.col("old").alias("name"), "new")
    return voices.join(done, "name", "left").withColumn("name", F.coalesce("new", "name")).drop("new").select(*voices.columns)


def info(voices: DataFrame, durations: DataFrame) -> DataFrame:
    """Names with their durations, null where unknown."""
    return voices.select("name").join(durations, "name", "left")


def lookup(requests: DataFrame, voices: DataFrame, files: DataFrame) -> DataFrame:
    """(request, name, path): path where the voice is loaded and its file exists, else null."""
    there = voices.select("name").join(files, "name")
    return requests.join(there, "name", "left")


def current(events: DataFrame) -> DataFrame:
    """Names that exist after all events (ts, type, voice, old, new): the last word on each decides."""
    told = events.select("ts", F.explode(F.when(F.col("type") == "renamed", F.array(F.struct(F.col("old").alias("name"), F.lit(False).alias("here")), F.struct(F.col("new").alias("name"), F.lit(True).alias("here")))).otherwise(F.array(F.struct(F.col("voice").alias("name"), F.when(F.col("type") == "ready", True).when(F.col("type") == "removed", False).alias("here"))))).alias("x")).select("ts", "x.*").where("here is not null")
    return told.groupBy("name").agg(F.max_by("here", "ts").alias("here")).where("here").select("name")


MAX_UPLOAD = 50 * 1024 * 1024


def favourites_first(voices: DataFrame, favourites: list[str], collation: str = "UNICODE") -> DataFrame:
    """(name, favourite), favourites before the others, each in the order of their names that readers expect: accents and case decide last.

    ``collation`` is one of Spark's, as UNICODE, de or UTF8_BINARY.
    """
    rows = voices.select("name", F.col("name").isin(favourites).alias("favourite"))
    return rows.orderBy(F.desc("favourite"), F.collate("name", collation), "name")


def accept_recordings(uploads: DataFrame, voices: DataFrame) -> DataFrame:
    """Uploads (filename, size and more) that are .wav files of a size within bounds, with the name made of theirs, not empty and new."""
    named = uploads.withColumn("name", voice_name(F.col("filename")))
    fit = named.where(F.lower("filename").endswith(".wav") & F.col("size").between(1, MAX_UPLOAD) & (F.col("name") != ""))
    return fit.join(voices.select("name"), "name", "left_anti")


def chunk_audio(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks with the content of their file, null where it is missing."""
    return chunks.join(files, ["job_id", "index"], "left")
