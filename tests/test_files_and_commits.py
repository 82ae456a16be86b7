"""Files that are written whole or not at all, and tables that change by commits, with stops at every step."""

import csv
import io
import os
import wave

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import fixed
from lectern.operators import abtest, audio, commits, subtitles
from lectern.sources import sinks


def names(folder):
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def content(folder):
    return {n: open(f"{folder}/{n}", "rb").read() for n in names(folder)}


def test_one_file_a_name(spark, tmp_path):
    rows = [("a.srt", 0, b"one "), ("a.srt", 4, b"two"), ("b.srt", 0, None), ("c.srt", 0, b"x" * 100_000)] + [(f"f{i}.srt", 0, str(i).encode()) for i in range(40)]
    df = spark.createDataFrame(rows[::-1], sinks.SCHEMA).repartition(5)
    sinks.write_files(df, str(tmp_path / "out"))
    want = {"a.srt": b"one two", "b.srt": b"", "c.srt": b"x" * 100_000} | {f"f{i}.srt": str(i).encode() for i in range(40)}
    assert content(tmp_path / "out") == want
    with pytest.raises(Exception, match="there already"):
        sinks.write_files(spark.createDataFrame([("a.srt", b"new"), ("z.srt", b"z")], "name string, content binary"), str(tmp_path / "out"))
    assert content(tmp_path / "out") == want
    sinks.write_files(spark.createDataFrame([("a.srt", b"new")], "name string, content binary"), str(tmp_path / "out"), replace=True)
    assert content(tmp_path / "out") == want | {"a.srt": b"new"}
    sinks.write_files(df.limit(0), str(tmp_path / "none"))
    assert names(tmp_path / "none") == []


@pytest.mark.parametrize("bad", [("x.srt", 5, b"gap"), (None, 0, b""), ("../x", 0, b""), ("a/b", 0, b""), ("", 0, b""), ("..", 0, b"")])
def test_a_task_that_fails_leaves_nothing(spark, tmp_path, bad):
    rows = [(f"f{i}.srt", 0, b"fine") for i in range(40)] + [bad]
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_files(spark.createDataFrame(rows, sinks.SCHEMA), str(tmp_path / "out"))
    assert names(tmp_path / "out") == []


def test_attempts_that_repeat_count_once(tmp_path):
    """A speculative attempt writes the same file beside the one that counts; one that fails half way leaves a part: neither is seen."""
    writer = sinks._Writer({"path": str(tmp_path)}, False)
    first = writer.write(iter([("a.wav", 0, b"whole"), ("b.wav", 0, b"b")]))
    writer.write(iter([("a.wav", 0, b"whole"), ("b.wav", 0, b"b")]))

    def half():
        yield "a.wav", 0, b"who"
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(half())
    assert all(n.startswith("_staging-") for n in names(tmp_path))
    writer.commit([first, writer.write(iter([]))])
    assert content(tmp_path) == {"a.wav": b"whole", "b.wav": b"b"}
    other = sinks._Writer({"path": str(tmp_path)}, True)
    one, two = other.write(iter([("c.wav", 0, b"1")])), other.write(iter([("c.wav", 0, b"2")]))
    with pytest.raises(ValueError):
        other.commit([one, two])
    other.abort([one, two])
    assert names(tmp_path) == ["a.wav", "b.wav"]


def test_files_are_deleted_where_their_rows_are(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n)
    paths = spark.createDataFrame([(f"{tmp_path}/a",), (f"{tmp_path}/x",), (f"{tmp_path}/c",), (None,)], "path string")
    assert {(r.path and r.path[-1], r.deleted) for r in sinks.delete_files(paths).collect()} == {("a", True), ("x", False), ("c", True), (None, False)}
    assert names(tmp_path) == ["b"]


def test_subtitles_as_files(spark, tmp_path):
    """Byte for byte the documents of the jobs, across blocks of sums."""
    cues = spark.createDataFrame([(j, i + 1, i * 2.0, i * 2 + 1.5, f"Zeile {i} é") for j, n in ((1, 1), (2, 3000), (3, 2)) for i in range(n)], "job_id long, cue_index int, start double, end double, text string").repartition(4)
    for vtt, make in ((False, subtitles.to_srt), (True, subtitles.to_vtt)):
        folder = tmp_path / str(vtt)
        sinks.write_files(subtitles.subtitle_blocks(cues, F.format_string("%d", "job_id"), vtt), str(folder))
        assert content(folder) == {str(r.job_id): r.document.encode() for r in make(cues).collect()}


def test_wav_files_equal_joined_chunks(spark, tmp_path):
    """One job holds a third of all rows; empty and missing samples; blocks of a job are made by many tasks."""
    rows = [("big", i, [((i * 7 + k) % 41 - 20) / 15 for k in range(i % 5)] if i != 3 else None) for i in range(1500)] + [(f"j{j}", i, [0.25] * (j % 3)) for j in range(300) for i in range(10)]
    chunks = spark.createDataFrame(rows, "job_id string, index int, samples array<double>").repartition(4)
    blocks = audio.wav_blocks(chunks, F.col("job_id"), rate=8000)
    spread = blocks.where("name = 'big'").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 1400
    sinks.write_files(blocks, str(tmp_path / "out"))
    small = audio.join_chunks(chunks.where("samples is not null"))
    assert content(tmp_path / "out") == {r.job_id: bytes(r.w) for r in small.select("job_id", audio.wav_bytes(F.col("samples"), 8000).alias("w")).collect()}
    with wave.open(str(tmp_path / "out" / "big")) as f:
        assert f.getnframes() == sum(len(s or []) for j, _, s in rows if j == "big") and f.getframerate() == 8000


def test_csv_files_as_the_csv_module_writes_them(spark, tmp_path):
    rows = [("x", 0, 'say "hi", you', 0.5, None), ("x", 1, "two\nlines", 1 / 3, 2.0), ("y", 0, "", 0.0000005, 1.23456), ("y", 2, "plain", 2.0, 0.0005)]
    df = spark.createDataFrame(rows, "run string, line int, voice string, wer double, seconds double")
    sinks.write_files(abtest.csv_blocks(df, F.col("run"), "line", drop=["run"]), str(tmp_path / "out"))
    for run in "xy":
        out = io.StringIO(newline="")
        w = csv.writer(out)
        w.writerow(["voice", "wer", "seconds"])
        for r, _, voice, wer, seconds in sorted(rows):
            if r == run:
                w.writerow([voice, f"{wer:.6f}", "" if seconds is None else f"{seconds:.3f}"])
        assert (tmp_path / "out" / run).read_bytes() == out.getvalue().encode()


def test_digits_as_the_exact_value_has_them(spark):
    values = [0.0005, 0.0015, 1.0005, 2.5, -0.0005, -0.0001, 0.125, 0.375, 1e-9, 123456.7895, 0.0] + [k / 16 for k in range(40)] + [(2 * k + 1) / 2000 for k in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3, 6):
        assert [r[0] for r in df.select(fixed(F.col("v"), digits)).collect()] == [f"{v:.{digits}f}" for v in values]


# --- commits ------------------------------------------------------------------------------------
class Stop(Exception):
    pass


class Stopping(commits.Table):
    at = None

    def _step(self, name):
        if name == self.at:
            raise Stop(name)


SCHEMA = "job long, i long, status string"


def rows_of(table, number=None):
    return sorted(tuple(r) for r in table.read(number).select("job", "i", "status").collect())


@pytest.mark.parametrize("step", ["data written", "entry written", "entry renamed"])
@pytest.mark.parametrize("merge", [True, False])
def test_a_stop_at_any_step_leaves_the_old_table_or_the_new(spark, tmp_path, step, merge):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    table, stopping = commits.Table(spark, str(tmp_path)), Stopping(spark, str(tmp_path))
    change = (lambda t, rows: t.merge(make(rows), ["job", "i"], batch=len(rows))) if merge else (lambda t, rows: t.replace(make(rows)))
    old, more = [(1, 0, "pending")], [(1, 0, "done"), (2, 0, "pending")]
    change(table, old)
    stopping.at = step
    with pytest.raises(Stop):
        change(stopping, more)
    assert rows_of(table) == (more if step == "entry renamed" else old)
    table.vacuum()
    assert rows_of(table) == (more if step == "entry renamed" else old)
    change(table, more)
    assert rows_of(table) == more and len(os.listdir(tmp_path / "log")) == len([n for n in os.listdir(tmp_path / "log") if not n.startswith(".")]) * (2 if any(n.endswith(".crc") for n in os.listdir(tmp_path / "log")) else 1)


def test_merges_touch_their_buckets_and_batches_count_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "BUCKETS", 8)
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    table = commits.Table(spark, str(tmp_path))
    with pytest.raises(ValueError):
        table.read()
    all_ = {(j, i): "pending" for j in (*range(20), None) for i in range(3)}
    assert table.merge(make([(*k, v) for k, v in all_.items()]), ["job", "i"], source="s", batch=0) == 1
    pinned = table.read()
    first = table.version()
    change = {(4, 1): "done", (None, 2): "done", (99, 0): "new"}
    assert table.merge(make([(*k, v) for k, v in change.items()]), ["job", "i"], source="s", batch=1) == 2
    second = table.version()
    same = [b for b in first.folders if first.folders[b] == second.folders.get(b)]
    assert 8 - 3 <= len(same) < 8
    all_ |= change
    expect = sorted(((*k, v) for k, v in all_.items()), key=str)
    assert sorted(map(tuple, table.read().collect()), key=str) == expect
    for batch in (0, 1):  # replayed
        assert table.merge(make([(4, 1, "wrong")]), ["job", "i"], source="s", batch=batch) is None
    assert table.merge(make([(4, 1, "other")]), ["job", "i"], source="t", batch=0) == 3
    assert pinned.where("status <> 'pending'").count() == 0 and pinned.count() == 63  # its files, whatever came after
    assert table.read(2).where("job = 4 and i = 1").first().status == "done"
    with pytest.raises(ValueError):
        table.merge(make([(1, 1, "x")]), ["job"])
    assert table.vacuum(keep=1) == 0 and table.versions() == [3] and table.read().count() == 64  # each folder still has buckets in use
    table.merge(table.read(), ["job", "i"])
    assert table.vacuum(keep=1) == 3 and table.versions() == [4] and table.read().count() == 64
    with pytest.raises(ValueError):
        table.read(1)


def test_the_last_of_equal_keys_counts_and_conflicts_are_made_again(spark, tmp_path, monkeypatch):
    table, other = commits.Table(spark, str(tmp_path)), commits.Table(spark, str(tmp_path))
    df = spark.createDataFrame([(1, 0, "old", 1), (1, 0, "new", 2), (2, 0, "only", 0)], SCHEMA + ", ts int")
    table.merge(df, ["job", "i"], order="ts")
    assert rows_of(table) == [(1, 0, "new"), (2, 0, "only")]

    real, raced = table._commit, []

    def late(v):
        if not raced:
            raced.append(other.merge(spark.createDataFrame([(3, 0, "other's", 5)], SCHEMA + ", ts int"), ["job", "i"]))
        return real(v)

    monkeypatch.setattr(table, "_commit", late)
    assert table.merge(spark.createDataFrame([(2, 0, "mine", 9)], SCHEMA + ", ts int"), ["job", "i"]) == 3 and raced == [2]
    assert rows_of(table) == [(1, 0, "new"), (2, 0, "mine"), (3, 0, "other's")]
    table.replace(table.read().where("job = 3"))  # read from the table that it replaces
    assert rows_of(table) == [(3, 0, "other's")] and rows_of(table, 1) == [(1, 0, "new"), (2, 0, "only")]
    table.replace(table.read().limit(0))
    assert rows_of(table) == []


def test_a_stream_that_stops_after_its_commit_is_not_counted_twice(spark, tmp_path):
    source, table = str(tmp_path / "in"), commits.Table(spark, str(tmp_path / "table"))
    schema = SCHEMA + ", n int"

    def run(t):
        t.merge_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), ["job", "i"], "n", "recorder", str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()

    spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2)], schema).coalesce(1).write.mode("append").parquet(source)
    run(table)
    spark.createDataFrame([(1, 0, "c", 3), (2, 0, "d", 1)], schema).coalesce(1).write.mode("append").parquet(source)
    stopping = Stopping(spark, str(tmp_path / "table"))
    stopping.at = "entry renamed"
    with pytest.raises(Exception):  # noqa: B017
        run(stopping)
    assert table.version().batches == {"recorder": 1}
    run(table)
    assert rows_of(table) == [(1, 0, "c"), (2, 0, "d")] and table.versions() == [1, 2]
