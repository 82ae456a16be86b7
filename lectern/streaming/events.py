"""Streams: file events that settle, remaining time per job, fan-out."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settled(events: DataFrame, quiet: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(path, settled_at): one row for each burst of create events (path, ts) of a .wav file, once it is quiet."""
    wav = events.where(F.lower("path").endswith(".wav"))
    if events.isStreaming:
        wav = wav.withWatermark("ts", late)
    return wav.groupBy(F.session_window("ts", quiet).alias("w"), "path").agg(F.count("*").alias("n")).select("path", F.col("w.end").alias("settled_at"), "n")


def dropped_late(query) -> int:
    """How many rows a streaming query has dropped because they came behind its watermark, as far as its progress is kept."""
    return sum(s["numRowsDroppedByWatermark"] for p in map(json.loads, (p.json for p in query.recentProgress)) for s in p["stateOperators"])


def deletions(events: DataFrame) -> DataFrame:
    return events.where((F.col("type") == "deleted") & F.lower("path").endswith(".wav"))


def progress(events: DataFrame, window: int = 5) -> DataFrame:
    """(job_id, index, done, total, eta) after each chunk of a stream of (job_id, index, total, seconds), with the last ``window`` times as state.

    Chunks of a job that come in one batch are taken in the order of their index, whatever order a shuffle gave them; across batches
    the order of arrival counts.
    """
    import pandas as pd

    def update(key, batches, state):
        done, times = state.get if state.exists else (0, [])
        times, out = list(times), []
        rows = pd.concat(list(batches)).sort_values("index", kind="stable")
        for index, total, seconds in zip(rows["index"], rows["total"], rows["seconds"], strict=True):
            done += 1
            times = [*times, max(0.0, float(seconds))][-window:]
            left = int(total) - done
            out.append((key[0], index, done, int(total), sum(times) / len(times) * left if left > 0 else None))
        state.update((done, times))
        yield pd.DataFrame(out, columns=["job_id", "index", "done", "total", "eta"])

    return events.groupBy("job_id").applyInPandasWithState(update, "job_id long, index long, done int, total int, eta double", "done int, times array<double>", "append", "NoTimeout")


def shared_folder(spark, name: str) -> str:
    """A folder of this name where spark.checkpoint.dir says; a temporary one only where the session names none and runs in one process."""
    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="streams-")
    return f"{where}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of Parquet files in the shared folder, for what is read several times."""
    path = shared_folder(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream has now, through Parquet files in ``folder``."""
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def fan_out(events: DataFrame, subscribers: dict[str, str], folder: str) -> list:
    """One query on the same stream for each subscriber (name and the condition on what it hears), into Parquet files at ``folder``/name.

    A subscriber hears what comes after its query started, and each at its own pace.
    """
    return [events.where(cond).writeStream.format("parquet").option("path", f"{folder}/{name}").queryName(name).option("checkpointLocation", f"{folder}/_{name}").outputMode("append").start() for name, cond in subscribers.items()]


class Broadcast:
    """One reading of a stream for any number of subscribers, who come and go while it runs.

    A subscriber is a file in ``folder``/subscribers that holds what it hears (a condition) and the batch it hears from.  Each batch is read once and kept until it
    is written for all, to ``folder``/name/batch=number, in place of what an earlier try of the batch left there.
    """

    def __init__(self, spark, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def subscribe(self, name: str, condition: str = "true", first_batch: int = 0) -> None:
        """From ``first_batch`` on, and not from batches that are done, ``name`` hears the rows that meet ``condition``."""
        files, path = self._path(f"subscribers/{name}")
        out = files.create(path, True)
        out.write(json.dumps({"condition": condition, "first": first_batch}).encode())
        out.close()

    def unsubscribe(self, name: str) -> None:
        files, path = self._path(f"subscribers/{name}")
        files.delete(path, False)

    def subscribers(self) -> dict[str, dict]:
        files, path = self._path("subscribers")
        found = files.listStatus(path) if files.exists(path) else []
        names = sorted(s.getPath().getName() for s in found)
        return {n: json.loads(self.spark.read.text(f"{self.folder}/subscribers/{n}", wholetext=True).first()[0]) for n in names if not n.startswith((".", "_"))}

    def _send(self, rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            for name, who in self.subscribers().items():
                if batch >= who["first"]:
                    rows.where(who["condition"]).write.mode("overwrite").parquet(f"{self.folder}/heard/{name}/batch={batch}")
        finally:
            rows.unpersist()

    def start(self, events: DataFrame, **trigger):
        """A query that sends ``events`` to all subscribers; it goes on after a stop where it was."""
        return events.writeStream.foreachBatch(self._send).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**trigger).start()

    def heard(self, name: str, schema) -> DataFrame:
        """What a subscriber has heard so far, with the batch it came in."""
        files, path = self._path(f"heard/{name}")
        if not files.exists(path):
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/heard/{name}").parquet(f"{self.folder}/heard/{name}/batch=*")


def arrivals(spark, folder: str, glob: str = "*.wav", per_batch: int = 1000) -> DataFrame:
    """A stream of the files that come into a folder: (path, modificationTime, length); their contents are not read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(folder).select("path", "modificationTime", "length")


def still_wanted(events: DataFrame) -> DataFrame:
    """Chunks that may still be worked on, of (session, ts, type, generation and more), type being start, stop or chunk.

    A stop ends all generations of its session up to its own, a start all before its own; a chunk counts only if nothing at its
    time or before ended its generation.
    """
    ended = F.when(F.col("type") == "stop", F.col("generation")).when(F.col("type") == "start", F.col("generation") - 1)
    so_far = F.max(ended).over(Window.partitionBy("session").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("ended", so_far).where((F.col("type") == "chunk") & (F.coalesce(F.col("ended") < F.col("generation"), F.lit(True)))).drop("ended")
