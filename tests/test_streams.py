"""Streams with state of their own, restarted in the middle."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.sources import watch
from lectern.streaming import events, generations


def drain(stream, folder):
    """Runs all that is there from the last checkpoint on."""
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_changes_between_listings():
    old = {"a": [1, 1], "b": [2, 2], "c": [3, 3], "d": [4, 4], "e": [4, 4]}
    new = {"a": [1, 1], "b": [2, 9], "x": [3, 3], "y": [4, 4], "z": [5, 5]}
    assert watch.changes(old, new) == [("changed", "b", None), ("deleted", "d", None), ("deleted", "e", None), ("renamed", "x", "c"), ("created", "y", None), ("created", "z", None)]
    assert watch.changes({}, {}) == [] and watch.changes(old, old) == []


def test_a_folder_is_watched_across_restarts(spark, tmp_path, monkeypatch):
    """Each run sees what changed since the one before, once; a stop between snapshot and batch loses nothing."""
    folder = tmp_path / "voices"
    stream = lambda: watch.watch(spark, str(folder), str(tmp_path / "snapshots")).select("type", F.regexp_replace("path", ".*/", "").alias("name"), F.regexp_replace("before", ".*/", "").alias("before"), "size")
    seen = []

    def news():
        drain(stream(), str(tmp_path / "out"))
        rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()]
        new = sorted(set(rows) - set(seen))
        assert len(rows) == len(set(rows)) == len(seen) + len(new)
        seen.extend(new)
        return new

    def put(name, text):
        (folder / name).write_text(text)

    stream().writeStream  # a folder that is not there yet has no files
    folder.mkdir()
    put("a.wav", "1")
    put("B.WAV", "22")
    put("c.txt", "no audio")
    (folder / "d.wav").mkdir()
    assert news() == [("created", "B.WAV", None, 2), ("created", "a.wav", None, 1)]
    assert news() == []
    put("e.wav", "333")
    # a reader that took a snapshot and was stopped before its batch
    reader = watch._Reader({"path": str(folder), "state": str(tmp_path / "snapshots")})
    taken = reader.latestOffset()
    assert reader.latestOffset() == taken
    (folder / "a.wav").unlink()
    os.rename(folder / "B.WAV", folder / "b.wav")
    assert news() == [("created", "e.wav", None, 3), ("deleted", "a.wav", None, 1), ("renamed", "b.wav", "B.WAV", 2)]
    put("e.wav", "4444")
    assert news() == [("changed", "e.wav", None, 4)]
    for name in ("b.wav", "e.wav"):
        (folder / name).unlink()
    assert news() == [("deleted", "b.wav", None, 2), ("deleted", "e.wav", None, 4)]
    assert len(os.listdir(tmp_path / "snapshots")) <= 3


def wanted(events):
    """Ids of the chunks that nothing at their time or before has ended."""
    out = set()
    for session, ts, kind, generation, id_ in events:
        if kind == "chunk":
            ended = [g if k == "stop" else g - 1 for s, t, k, g, _ in events if s == session and t <= ts and k in ("stop", "start")]
            if not ended or max(ended) < generation:
                out.add((session, id_))
    return out


SCHEMA = "session long, ts timestamp, type string, generation long, id long"


def test_generations_end_whatever_the_order_of_arrival(spark, tmp_path):
    """Three files, out of order within the lateness, with a restart after each, give the batch answer."""
    rng = random.Random(6)
    events = []
    for i in range(300):
        kind = rng.choice(["start", "stop", "chunk", "chunk", "chunk"])
        events.append((rng.randrange(4), i // 2 * 500_000 + rng.choice([0, 1]), kind, max(1, i // 60 + rng.choice([-1, 0, 0, 1])), i))
    source = str(tmp_path / "in")
    stamp = lambda rows: spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_micros("ts")).coalesce(1)
    parts = [events[:100], events[100:200], events[200:]]
    for a, b in ((0, 1), (1, 2)):  # neighbours swap some rows; none is later than 30 seconds
        for i in range(20):
            parts[a][-1 - i], parts[b][i] = parts[b][i], parts[a][-1 - i]
    with generations.state_store(spark):
        for part in [*parts, [(0, 10**12, "end", 0, 0)]]:
            stamp(part).write.mode("append").parquet(source)
            drain(generations.still_wanted(spark.readStream.schema(SCHEMA).parquet(source), "60 seconds"), str(tmp_path / "out"))
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted(events) and 0 < len(got) < 180


def test_quiet_sessions_are_forgotten_and_late_rows_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    steps = [[(1, 10, "stop", 5, 0), (1, 11, "chunk", 4, 1)], [(2, 100, "chunk", 1, 2)], [(2, 500, "chunk", 1, 3), (1, 501, "chunk", 4, 4)], [(1, 20, "chunk", 9, 5), (3, 900, "chunk", 1, 6)]]
    with generations.state_store(spark):
        for rows in steps:
            spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(source)
            drain(generations.still_wanted(spark.readStream.schema(SCHEMA).parquet(source), "1 second", keep_seconds=60), str(tmp_path / "out"))
    # 4 comes after its session was forgotten; 5 is late; 6 waits for the watermark
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()) == [2, 3, 4]


@pytest.mark.parametrize("name", ["e06_stream_state", "s10_watch"])
def test_registered(name):
    from lectern.plans import queries

    assert name in queries.QUERIES and name in queries.SQL


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """Three files, the last with a burst that is late: the batch answer less the late rows, which are told."""
    source, schema = str(tmp_path / "in"), "ts timestamp, path string"
    first = [(100, "a.wav"), (101, "a.wav"), (100, "b.WAV"), (103, "n.txt")]
    second = [(300, "a.wav"), (301, "c.wav")]
    late = [(105, "late.wav"), (106, "late.wav"), (150, "late.wav")]
    third = [*late, (600, "d.wav")]
    dropped = 0
    for rows in (first, second, third, [(9999, "end.wav")]):
        put(spark, source, rows, schema)
        stream = events.settled(spark.readStream.schema(schema).parquet(source), "2 seconds", late="10 seconds")
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        dropped += events.dropped_late(query)
    plain = lambda df: sorted((r.path, r.settled_at, r.n) for r in df.collect())
    batch = events.settled(spark.read.schema(schema).parquet(source).where("not (path = 'late.wav') and path <> 'end.wav'"), "2 seconds")
    assert plain(spark.read.parquet(f"{tmp_path}/rows")) == plain(batch) and dropped == len(late)


def test_one_reading_for_all_subscribers(spark, tmp_path):
    """Rows are read once, a batch that is run again counts once, and a late subscriber hears only what comes after."""
    source, schema = str(tmp_path / "in"), "ts timestamp, kind string"
    sender = events.Broadcast(spark, str(tmp_path / "out"))
    sender.subscribe("all")
    sender.subscribe("clicks", "kind = 'click'")
    read = 0

    def run(rows):
        nonlocal read
        put(spark, source, rows, schema)
        query = sender.start(spark.readStream.schema(schema).parquet(source), availableNow=True)
        query.awaitTermination()
        read += sum(p.numInputRows for p in query.recentProgress)

    heard = lambda name: sorted((r.kind, r.batch) for r in sender.heard(name, schema).collect())
    run([(1, "click"), (2, "view")])
    sender.subscribe("late", "kind <> 'view'", first_batch=1)
    run([(3, "click"), (4, "key"), (5, "view")])
    sender.unsubscribe("clicks")
    run([(6, "click")])
    assert read == 6
    assert heard("all") == [("click", 0), ("click", 1), ("click", 2), ("key", 1), ("view", 0), ("view", 1)]
    assert heard("clicks") == [("click", 0), ("click", 1)] and heard("late") == [("click", 1), ("click", 2), ("key", 1)] and heard("nobody") == []
    sender._send(spark.createDataFrame([(6, "click")], "ts long, kind string").withColumn("ts", F.timestamp_seconds("ts")), 2)  # run again
    assert len(heard("all")) == 6


def test_calls_to_the_state_follow_the_batches(monkeypatch):
    """Twenty thousand events of one session cost a call a batch, and come out as a restart in the middle would have them."""
    import numpy as np
    import pandas as pd

    calls, timers = [], set()

    class State:
        def __init__(self, many):
            self.many, self.v = many, None

        def __getattr__(self, name):
            calls.append(name)
            return {"exists": lambda: self.v is not None, "get": lambda: iter(self.v) if self.many else self.v, "clear": lambda: setattr(self, "v", None), "update": lambda v: setattr(self, "v", v), "put": lambda v: setattr(self, "v", list(v)), "appendValue": lambda v: setattr(self, "v", [*(self.v or []), v])}[name]

    class Handle:
        getValueState = lambda self, *a: State(False)
        getListState = lambda self, *a: State(True)
        registerTimer = lambda self, at: timers.add(at)

    class At(int):
        getCurrentWatermarkInMs = getExpiryTimeInMs = int.__int__

    rng = np.random.default_rng(3)
    n = 20_000
    kind, generation, at = rng.integers(0, 40, n), rng.integers(0, 5, n) + np.arange(n) // 2000, rng.permutation(n) // 3 + 1
    rows = pd.DataFrame({"at": at, "time": at * 1000 - 1, "ends": pd.array(np.where(kind == 0, generation, None), "Int64"), "generation": generation, "id": pd.array(np.where(kind > 0, np.arange(n), None), "Int64")})
    one = generations.Wanted(10**9)
    one.init(Handle())
    out = list(one.handleInputRows((1,), iter([rows[:10_000], rows[10_000:]]), None))
    for watermark in (2000, 5000, 10_000):
        assert min(timers) <= watermark
        out += one.handleExpiredTimer((1,), At(watermark), At(min(timers)))
        timers -= {t for t in timers if t <= watermark}
    ends = rows[rows["ends"].notna()].groupby("at")["ends"].max().cummax().reindex(range(0, n), method="ffill")
    want = rows[rows["id"].notna()]
    so_far = ends.loc[want["at"]].to_numpy()
    want = want[[e is pd.NA or pd.isna(e) or e < g for e, g in zip(so_far, want["generation"])]]
    got = [i for o in out for i in o["id"]]
    assert len(got) == len(set(got)) and set(got) == set(want["id"]) and len(calls) < 40
