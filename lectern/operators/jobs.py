"""Jobs and their chunks: latest state, summaries, resuming, remaining time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JOB_ID = r"\A[0-9]{8}-[0-9]{6}-[0-9a-f]{6}\z"
ETA_WINDOW = 5


def is_job_id(c: Column) -> Column:
    return c.rlike(JOB_ID)


def latest_chunks(events: DataFrame, order: str = "ts") -> DataFrame:
    """The last record of each (job_id, index): the state after keyed upserts."""
    last = Window.partitionBy("job_id", "index").orderBy(F.desc(order))
    return events.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def summarize(chunks: DataFrame) -> DataFrame:
    """(job_id, done, total, audio_duration, complete, resume_index) from job_id, index, status, duration."""
    done = F.col("status") == "done"
    out = chunks.groupBy("job_id").agg(
        F.count_if(done).alias("done"),
        F.count("*").alias("total"),
        F.sum(F.when(done, F.coalesce("duration", F.lit(0.0))).otherwise(0.0)).alias("audio_duration"),
        F.coalesce(F.min(F.when(~done, F.col("index"))).cast("long"), F.count("*")).alias("resume_index"),
    )
    return out.withColumn("complete", F.col("done") == F.col("total"))


def list_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest jobs with a valid id."""
    return jobs.where(is_job_id(F.col("job_id"))).orderBy(F.desc("created_at")).limit(limit)


def done_with_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Finished chunks whose file (job_id, index) exists."""
    return chunks.where("status = 'done'").join(files, ["job_id", "index"], "left_semi")


def eta(history: DataFrame, window: int = ETA_WINDOW) -> DataFrame:
    """Adds pace and eta to (job_id, index, seconds, total): mean of the trailing chunks times the chunks left, null if none are left."""
    trailing = Window.partitionBy("job_id").orderBy("index").rowsBetween(1 - window, 0)
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("index"))
    rows = history.withColumns({"pace": F.avg(F.greatest("seconds", F.lit(0.0))).over(trailing), "left": F.col("total") - n})
    return rows.withColumn("eta", F.when(F.col("left") > 0, F.col("pace") * F.col("left")))


def delete_jobs(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs or chunks without those of the jobs deleted (job_id)."""
    return rows.join(ids, "job_id", "left_anti")


def finish_jobs(jobs: DataFrame, ended: DataFrame) -> DataFrame:
    """Jobs with the status of those that ended (job_id, ended_as)."""
    return jobs.join(ended, "job_id", "left").withColumn("status", F.coalesce("ended_as", "status")).drop("ended_as")


def create(requests: DataFrame, key: str = "request") -> DataFrame:
    """``requests`` (created_at in seconds, ``key`` that tells them apart) with job_id, YYYYMMDD-HHMMSS- and six hexadecimal digits of the key, and status running."""
    when = F.date_format(F.timestamp_seconds(F.floor("created_at")), "yyyyMMdd-HHmmss")
    return requests.withColumns({"job_id": F.concat(when, F.lit("-"), F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 6)), "status": F.lit("running")})


def track(history: DataFrame, window: int = ETA_WINDOW) -> DataFrame:
    """As ``eta`` for jobs that were resumed: (job_id, index, seconds, total, resumed); adds done, which starts at ``resumed``."""
    trailing = Window.partitionBy("job_id").orderBy("index").rowsBetween(1 - window, 0)
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("index"))
    rows = history.withColumns({"pace": F.avg(F.greatest("seconds", F.lit(0.0))).over(trailing), "done": F.col("resumed") + n})
    left = F.col("total") - F.col("done")
    return rows.withColumn("eta", F.when(left > 0, F.col("pace") * left))


def detail_json(summary: DataFrame) -> DataFrame:
    """(job_id, detail): the rows of ``summarize`` as JSON, keys in this order."""
    return summary.select("job_id", F.to_json(F.struct("job_id", "done", "total", "audio_duration", "resume_index", "complete")).alias("detail"))
