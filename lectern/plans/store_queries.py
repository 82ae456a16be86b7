"""Queries over streams with state, tables of commits and files that are written, with DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.operators import abtest, audio, commits, subtitles
from lectern.plans.cleaning_queries import SQL
from lectern.plans.job_queries import _CHUNKS, _SESSION, _WAV, _chunks, _event_stream, _simple_cues, _t, query
from lectern.sources import sinks, watch
from lectern.streaming import events as streams
from lectern.streaming import generations


def _folder(spark, name: str) -> str:
    return streams.shared_folder(spark, f"{name}-{uuid.uuid4().hex}")


def _run(stream, folder: str) -> None:
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()


@query(SQL["e06_still_wanted"])
def e06_stream_state(spark, sf_dir):
    """Chunks of generations that nothing has ended, from a stream with state; a marker after its end moves the watermark past the last event."""
    folder = _folder(spark, "generations")
    events = _event_stream(spark, sf_dir).selectExpr(*_SESSION.replace("//", "div").split(", ")).withColumnRenamed("event_id", "id")
    events = events.select(F.col("session").cast("long").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "type", F.col("generation").cast("long").alias("generation"), "id")
    marker = spark.range(1).select(F.lit(-1).cast("long").alias("session"), F.lit("2200-01-01").cast("timestamp").alias("ts"), F.lit("end").alias("type"), F.lit(0).cast("long").alias("generation"), F.lit(None).cast("long").alias("id"))
    marker.where("false").write.parquet(f"{folder}/end")
    wanted = lambda: generations.still_wanted(events.unionByName(spark.readStream.schema(events.schema).parquet(f"{folder}/end")), "1 hour", keep_seconds=10**9)
    with generations.state_store(spark):
        _run(wanted(), folder)
        marker.write.mode("append").parquet(f"{folder}/end")
        _run(wanted(), folder)
    return spark.read.schema("session long, id long").parquet(f"{folder}/rows").select("session", F.col("id").alias("event_id"))


@query(SQL["e01_settled"])
def e01_settled_stream(spark, sf_dir):
    """Bursts that a stream settles as its watermark passes them; a marker after its end closes the last."""
    folder = _folder(spark, "settled")
    events = _event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string"), F.lit(".wav")).alias("path"))
    marker = spark.range(1).select(F.lit("2200-01-01").cast("timestamp").alias("ts"), F.lit("end.wav").alias("path"))
    marker.where("false").write.parquet(f"{folder}/end")
    bursts = lambda: streams.settled(events.unionByName(spark.readStream.schema(events.schema).parquet(f"{folder}/end")), "1 hour", late="1 hour")
    _run(bursts(), folder)
    marker.write.mode("append").parquet(f"{folder}/end")
    _run(bursts(), folder)
    return spark.read.schema("path string, settled_at timestamp, n long").parquet(f"{folder}/rows").select("path", F.col("settled_at").cast("timestamp_ntz").alias("settled_at"), "n")


@query(SQL["e03_fan_out"])
def e03_broadcast(spark, sf_dir):
    """Two subscribers to one reading of a stream."""
    events = _event_stream(spark, sf_dir)
    sender = streams.Broadcast(spark, _folder(spark, "broadcast"))
    heard = {"clicks": "event_type = 'click'", "even": "user_id % 2 = 0"}
    for name, condition in heard.items():
        sender.subscribe(name, condition)
    sender.start(events, availableNow=True).awaitTermination()
    clicks, even = (sender.heard(n, events.schema).select("event_id", F.lit(n).alias("subscriber")) for n in heard)
    return clicks.unionByName(even)


@query("""SELECT 'created' AS type, 'v' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.wav' ELSE '.WAV' END AS name, CAST(length(s_name) AS BIGINT) AS size, CAST(1 AS BIGINT) AS look FROM supplier
UNION ALL SELECT 'deleted', 'v' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.wav' ELSE '.WAV' END, length(s_name), 2 FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'changed', 'v' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.wav' ELSE '.WAV' END, 3 + length(s_name), 2 FROM supplier WHERE s_suppkey % 3 = 1""")
def s10_watch(spark, sf_dir):
    """What a watched folder shows after files came, and after a third of them went and a third changed."""
    folder = _folder(spark, "watched")
    name = F.expr("'v' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.wav' ELSE '.WAV' END")
    files = _t(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"), F.encode("s_name", "UTF-8").alias("content"))
    sinks.write_files(files, f"{folder}/voices")
    look = lambda: _run(watch.watch(spark, f"{folder}/voices", f"{folder}/snapshots"), folder)
    look()
    gone = files.where("s_suppkey % 3 = 0").select(F.concat(F.lit(f"{folder}/voices/"), "name").alias("path"))
    sinks.delete_files(gone).where("not deleted").count()
    sinks.write_files(files.where("s_suppkey % 3 = 1").withColumn("content", F.concat(F.lit("new").cast("binary"), "content")), f"{folder}/voices", replace=True)
    look()
    seen = spark.read.schema(watch.SCHEMA).parquet(f"{folder}/rows")
    first = seen.agg(F.min("ts").alias("first"))  # one row
    return seen.join(first, F.lit(True)).select("type", F.regexp_replace("path", ".*/", "").alias("name"), "size", F.when(F.col("ts") == F.col("first"), 1).otherwise(2).cast("long").alias("look"))


@query(f"WITH c AS ({_CHUNKS}) SELECT job_id, index, status, duration FROM c UNION ALL SELECT o_orderkey, 99, 'pending', NULL FROM orders")
def k02_recorded(spark, sf_dir):
    """Chunks that are pending, then recorded one batch after the other, one of them twice: the table of the last commit."""
    table = commits.Table(spark, _folder(spark, "recorded"))
    chunks = _chunks(spark, sf_dir).select("job_id", "index", "status", "duration")
    pending = chunks.withColumns({"status": F.lit("pending"), "duration": F.lit(None).cast("double")})
    more = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit(99).alias("index"), F.lit("pending").alias("status"), F.lit(None).cast("double").alias("duration"))
    for batch, rows in enumerate((pending.unionByName(more), chunks.where("index % 2 = 0"), chunks.where("index % 2 = 1"), chunks.where("index % 2 = 0"))):
        table.merge(rows, ["job_id", "index"], source="recorder", batch=min(batch, 2))
    return table.read()


def _written(spark, blocks, name: str):
    """(name, content): the files that the blocks make, read back."""
    folder = _folder(spark, name)
    sinks.write_files(blocks, folder)
    return spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", ".*/", "").alias("name"), "content")


@query(SQL["k04_srt"].replace("SELECT job_id, string_agg", "SELECT 'job-' || job_id || '.srt' AS name, string_agg"))
def k04_srt_files(spark, sf_dir):
    files = _written(spark, subtitles.subtitle_blocks(_simple_cues(spark, sf_dir), F.format_string("job-%d.srt", "job_id")), "srt")
    return files.select("name", F.decode("content", "UTF-8").alias("document"))


@query(SQL["k05_vtt"].replace("SELECT job_id, 'WEBVTT'", "SELECT 'job-' || job_id || '.vtt' AS name, 'WEBVTT'"))
def k05_vtt_files(spark, sf_dir):
    files = _written(spark, subtitles.subtitle_blocks(_simple_cues(spark, sf_dir), F.format_string("job-%d.vtt", "job_id"), vtt=True), "vtt")
    return files.select("name", F.decode("content", "UTF-8").alias("document"))


@query("""SELECT 'run-' || doc_id // 100 || '.csv' AS name, 'doc_id,wer,similarity,seconds' || chr(13) || chr(10) || string_agg(doc_id || ',' || printf('%.6f', (doc_id % 17) / cast(100 as double)) || ',' || CASE WHEN doc_id % 4 > 0 THEN printf('%.6f', (doc_id % 7) / cast(8 as double)) ELSE '' END || ',' || printf('%.3f', (doc_id % 19) / cast(4 as double)) || chr(13) || chr(10), '' ORDER BY doc_id) AS document
FROM documents GROUP BY doc_id // 100""")
def k06_csv_files(spark, sf_dir):
    """A CSV file for each run of a hundred documents."""
    rows = _t(spark, sf_dir, "documents").selectExpr("doc_id div 100 AS run", "doc_id AS line", "doc_id", "(doc_id % 17) / 100D AS wer", "CASE WHEN doc_id % 4 > 0 THEN (doc_id % 7) / 8D END AS similarity", "(doc_id % 19) / 4D AS seconds")
    blocks = abtest.csv_blocks(rows, F.format_string("run-%d.csv", "run"), "line", drop=["run"])
    return _written(spark, blocks, "csv").select("name", F.decode("content", "UTF-8").alias("document"))


@query(_WAV.split("w AS (")[0].rstrip().rstrip(",") + f""", j AS (SELECT vec_id // 16 AS job, CAST(sum(n) AS BIGINT) AS n, string_agg(pcm, '' ORDER BY vec_id) AS pcm FROM q GROUP BY vec_id // 16)
SELECT 'job-' || job || '.wav' AS name, '52494646' || {{le36}} || '57415645666D7420' || '10000000' || '0100' || '0100' || '44AC0000' || '88580100' || '0200' || '1000' || '64617461' || {{le}} || pcm AS wav FROM j""".format(le36=" || ".join(f"printf('%02X', ((n + 36) >> {8 * i}) & 255)" for i in range(4)), le=" || ".join(f"printf('%02X', (n >> {8 * i}) & 255)" for i in range(4))))
def j07_wav_files(spark, sf_dir):
    """The audio of each job, sixteen vectors as its chunks, as one WAV file; in hexadecimal digits."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 8)
    chunks = _t(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 16).alias("index"), x.alias("samples"))
    blocks = audio.wav_blocks(chunks, F.concat(F.lit("job-"), F.expr("cast(vec_id div 16 as string)"), F.lit(".wav")))
    return _written(spark, blocks, "wav").select("name", F.hex("content").alias("wav"))
