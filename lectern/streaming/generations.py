"""Generations that end, as state of a stream."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for a null session, as state has no null keys.
_NONE = -(2**63)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in the store that timers and several state variables need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Wanted(StatefulProcessor):
    """Of one session: the generation up to which all has ended, and what came at times that the watermark has not passed.

    What comes waits in packed blocks, an Arrow batch each.  A session has a timer for the first time that waits; when it fires no event up to
    the watermark can come any more, so all of these are taken at once in the order of their times, whatever order they arrived in.
    Calls to the state so follow the batches and not the events.  ``keep_ms`` after its last event a session's state is freed.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ended = handle.getValueState("ended", "generation long, last long, frees long")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            pdf = pdf[pdf["ends"].notna() | pdf["id"].notna()]  # a filter on the stream would be moved below the watermark
            if len(pdf):
                self.waiting.appendValue((_packed(pdf).tobytes(),))
                first = int(pdf["at"].min()) if first is None else min(first, int(pdf["at"].min()))
        if first is not None:
            self.handle.registerTimer(first)
        yield pd.DataFrame({"session": [], "id": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        import numpy as np

        passed = max(int(timerValues.getCurrentWatermarkInMs()), int(expiredTimerInfo.getExpiryTimeInMs()))
        generation, last, frees = self.ended.get() if self.ended.exists() else (None, None, None)
        held = [np.frombuffer(bytes(r[0]), np.int64).reshape(-1, 5) for r in self.waiting.get()] if self.waiting.exists() else []
        out = np.empty(0, np.int64)
        if held:
            events = np.concatenate(held)
            now, later = events[events[:, 0] <= passed], events[events[:, 0] > passed]
            if len(now):
                generation, last, out = _taken(now, generation, last, self.keep_ms)
                self.waiting.clear()
                if len(later):
                    self.waiting.put([(later[i : i + _BLOCK].tobytes(),) for i in range(0, len(later), _BLOCK)])
            if len(later):
                self.handle.registerTimer(int(later[:, 0].min()))
        if last is not None:
            if last + self.keep_ms <= passed:
                self.ended.clear()
            else:
                if frees is None or frees <= passed:
                    frees = last + self.keep_ms
                    self.handle.registerTimer(frees)
                self.ended.update((generation, last, frees))
        session = None if key[0] == _NONE else key[0]
        yield pd.DataFrame({"session": pd.array([session] * len(out), "Int64"), "id": out})

    def close(self) -> None:
        pass


#: Most events of a block that is written back.
_BLOCK = 10_000
_ENDS, _CHUNK, _ANY = 0, 1, 2


def _packed(pdf: pd.DataFrame):
    """Rows as numbers: at, time, what it is (an end, a chunk or a chunk of no generation), the generation it ends or is of, id."""
    import numpy as np

    ends, own, id_ = pdf["ends"].astype("Int64"), pdf["generation"].astype("Int64"), pdf["id"].astype("Int64")
    kind = np.where(ends.notna(), _ENDS, np.where(own.notna(), _CHUNK, _ANY))
    columns = [pdf["at"], pdf["time"], kind, ends.fillna(own).fillna(0), id_.fillna(0)]
    return np.column_stack([np.asarray(c, np.int64) for c in columns])


def _taken(events, generation: int | None, last: int | None, keep_ms: int):
    """(generation, last, ids): what has ended after ``events``, when the last of them was, and the chunks that nothing had ended."""
    import numpy as np

    # at one time what ends generations counts before chunks
    events = events[np.lexsort((events[:, 2], events[:, 1]))]
    at, _, kind, value, id_ = events.T
    ended = np.where(kind == _ENDS, value, _NONE)
    # a longer silence forgets what came before it
    starts = np.flatnonzero(np.diff(at, prepend=at[0] if last is None else last) > keep_ms).tolist()
    so_far = _NONE if generation is None else generation
    for a, b in zip([0, *starts], [*starts, len(at)], strict=True):
        if b > a:
            ended[a] = max(int(ended[a]), so_far if a == 0 and 0 not in starts[:1] else _NONE)
            ended[a:b] = np.maximum.accumulate(ended[a:b])
    wanted = (kind == _ANY) | ((kind == _CHUNK) & ((ended == _NONE) | (ended < value)))
    return (None if ended[-1] == _NONE else int(ended[-1])), int(at[-1]), id_[wanted]


def still_wanted(events: DataFrame, late: str = "10 seconds", keep_seconds: int = 86_400) -> DataFrame:
    """(session, id): chunks of a stream that no stop and no later start had ended when they came.

    ``events`` has session, ts, type (start, stop, chunk; others only move the watermark), generation and id, all long but ts and type.  A stop ends its
    generation and all before it, a start all before its own.  Rows that come more
    than ``late`` behind the newest are dropped by the watermark; a chunk comes out once the watermark has passed its time.  A session that is quiet for
    ``keep_seconds`` of event time is forgotten; null is a session like others.  State holds three numbers a session that is alive, and what came within ``late``, forty bytes an event.
    """
    time = F.col("ts").cast("timestamp")
    ends = F.when(F.col("type") == "stop", F.col("generation")).when(F.col("type") == "start", F.col("generation") - 1)
    rows = events.withColumn("ts", time).withWatermark("ts", late)
    # a timer fires for whole milliseconds that have passed
    rows = rows.select(F.coalesce("session", F.lit(_NONE)).alias("session"), "ts", F.unix_micros("ts").alias("time"), (F.unix_millis("ts") + 1).alias("at"), ends.alias("ends"), "generation", F.when(F.col("type") == "chunk", F.col("id")).alias("id"))
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=Wanted(keep_seconds * 1000), outputStructType="session long, id long", outputMode="Append", timeMode="EventTime")
