"""Substring dedup: Rabin-Karp hashes of every window of 50 words, counted in Spark.

Each task hashes the windows of its documents, keeps one of equal windows and sends the rest, packed by
hash range, to the tasks that own the ranges.  These find the smallest document of each hash over all tasks and
send back the windows that a smaller document has.  Marked windows merge into maximal intervals of words.

A window has two hashes of different bases.  32 bits of each are compared, other bits of both choose the range, so
windows are told apart by 64 bits within a range of about a million windows: n windows give n * 2^20 / 2^65 false
matches, 0.3 in the 10^13 windows of 100 TB.  Batches are cut from sorted partitions, so a task that runs again
after a lost executor makes the same ones, in whatever order its input arrives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import read, shuffle_partitions, text_key, whole_id

WINDOW = 50
#: Windows that a task hashes and sorts at once, about 60 bytes each.
BATCH_WINDOWS = 2_000_000
#: Windows of a hash range, about; their task holds them all, about 60 bytes each.  A row of the shuffle holds BATCH_WINDOWS *
#: RANGE_WINDOWS / n of n windows, so for 10^13 windows both should be 16 million on executors with 2 GB a task.
RANGE_WINDOWS = 1_000_000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_CACHE_WORDS = 250_000


class _WordHash(dict):
    """64-bit hashes of words (bytes), kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_word_hash = _WordHash()
_powers = [np.ones(1, np.uint64) for _ in _BASES]
_inverse = [np.ones(1, np.uint64) for _ in _BASES]


def _grow(n: int) -> None:
    """Powers of the bases and of their inverses modulo 2^64, n of each at least."""
    if len(_powers[0]) < n:
        n = 1 << n.bit_length()
        for i, base in enumerate(_BASES):
            _powers[i] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)
            _inverse[i] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(base, -1, 1 << 64), np.uint64)], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolled(codes: np.ndarray, size: int, which: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2^64 of all windows of ``size`` codes, by the base ``which``, mixed so that their bits are even."""
    n = len(codes) - size + 1
    total = np.r_[np.uint64(0), np.cumsum(codes * _powers[which][: len(codes)], dtype=np.uint64)]
    return _mixed((total[size:] - total[:-size]) * _inverse[which][:n])


def window_hashes(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of ``size`` codes: 64 bits to compare, half of either hash, and 32 others of both that choose the range."""
    if len(codes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    _grow(len(codes) + 1)
    a, b = rolled(codes, size, 0), rolled(_mixed(codes ^ np.uint64(_BASES[1])), size, 1)
    return (a & np.uint64(0xFFFFFFFF00000000)) | (b >> np.uint64(32)), (a ^ (b << np.uint64(7))).astype(np.uint32)


def _packed(x: np.ndarray) -> bytes:
    """A rising array of int64 as its first value, the size of its steps and the steps."""
    steps = np.diff(x).astype(np.uint64)
    kind = np.min_scalar_type(steps.max()) if len(steps) else np.dtype(np.uint8)
    return x[:1].astype(np.int64).tobytes() + bytes([kind.itemsize]) + steps.astype(kind).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    first = np.frombuffer(b, np.int64, 1)
    steps = np.frombuffer(b, np.dtype(f"u{b[8]}"), offset=9).astype(np.uint64)
    return np.cumsum(np.r_[first.astype(np.uint64), steps], dtype=np.uint64).view(np.int64)


class _Batch:
    """Documents of one task whose windows are hashed and sorted together."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.keys: list[int] = []
        self.hashes: list[tuple[np.ndarray, np.ndarray]] = []
        self.windows = 0

    def add(self, doc_id: int, key: int, hashes: tuple[np.ndarray, np.ndarray]) -> None:
        self.ids.append(doc_id)
        self.keys.append(key)
        self.hashes.append(hashes)
        self.windows += len(hashes[0])

    def rows(self, name: str, ranges: int) -> Iterator[dict]:
        """One row with the documents and the windows marked here, and one for each hash range with the rest.

        Documents come in the order of their ids.
        """
        ids, keys = np.array(self.ids, np.int64), np.array(self.keys, np.int64)
        sizes = np.array([len(h) for h, _ in self.hashes], np.int64)
        h = np.concatenate([h for h, _ in self.hashes])
        which = ((np.concatenate([r for _, r in self.hashes]).astype(np.uint64) * np.uint64(ranges)) >> np.uint64(32)).astype(np.uint16 if ranges <= 1 << 16 else np.uint32)
        self.__init__()
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        order = np.argsort(h, kind="stable").astype(np.int32)  # equal windows stay in the order of their documents
        hs, ws, owner = h[order], which[order], ids[doc[order]]
        first = np.r_[True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])]
        least = owner[first][np.cumsum(first) - 1]
        here = np.zeros(len(h), bool)
        here[order[owner > least]] = True
        del hs, ws, owner, least, first, order
        marked, rest = np.flatnonzero(here), np.flatnonzero(~here)
        own = int(xxhash.xxh32_intdigest(name) % ranges)
        yield {"range": own, "batch": name, "hashes": None, "at": _packed(marked) if len(marked) else None, "ids": ids.tobytes(), "keys": keys.tobytes(), "sizes": sizes.tobytes()}
        rest = rest[np.argsort(which[rest], kind="stable")]  # by range, and within one in order
        edges = np.flatnonzero(np.diff(which[rest], prepend=which[rest[:1]] + 1))
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(rest)], strict=True):
            at = rest[lo:hi]
            yield {"range": int(which[at[0]]), "batch": name, "hashes": h[at].tobytes(), "at": _packed(at), "ids": _packed(ids[doc[at]]), "keys": None, "sizes": None}


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, tkey, spans): the word intervals [start, end) to remove, as little-endian int64 pairs.

    Only documents that lose words have a row, and one for each (doc_id, text).
    """
    spark = docs.sparkSession
    rows = docs.select(whole_id(docs, id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(shuffle_partitions(spark), n_bytes // (6 * RANGE_WINDOWS))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, n, task = _Batch(), 0, TaskContext.get().partitionId()
        for pdf in batches:
            for doc_id, key, text in zip(pdf["doc_id"], pdf["tkey"], pdf["text"], strict=True):
                words = text.encode().split()
                if len(words) < window:
                    continue
                batch.add(doc_id, key, window_hashes(np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words)), window))
                if batch.windows >= BATCH_WINDOWS:
                    yield pd.DataFrame(list(batch.rows(f"{task}-{n}", ranges)))
                    n += 1
        if batch.windows:
            yield pd.DataFrame(list(batch.rows(f"{task}-{n}", ranges)))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All windows of a hash range: marks those whose hash a smaller document has."""
        kept = []
        for pdf in batches:
            tables = pdf["hashes"].isna()
            if tables.any():
                yield pdf.loc[tables, ["batch", "at", "ids", "keys", "sizes"]]
            kept.append(pdf.loc[~tables, ["range", "batch", "hashes", "at", "ids"]])
        if not kept or not len(rest := pd.concat(kept)):
            return
        for _, pdf in rest.groupby("range", sort=False):
            hs = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["hashes"]])
            ids = np.concatenate([_unpacked(b) for b in pdf["ids"]])
            order = np.argsort(hs)
            first = np.flatnonzero(np.r_[True, hs[order][1:] != hs[order][:-1]])
            least = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.r_[first, len(hs)]))
            mark = np.zeros(len(hs), bool)
            mark[order] = ids[order] > least
            done, out = 0, []
            for name, packed in zip(pdf["batch"], pdf["at"], strict=True):
                at = _unpacked(packed)
                hit = at[mark[done : done + len(at)]]
                done += len(at)
                if len(hit):
                    out.append({"batch": name, "at": _packed(hit), "ids": None, "keys": None, "sizes": None})
            if out:
                yield pd.DataFrame(out)

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        """One batch: its marked windows as intervals of words of its documents."""
        table = pdf[pdf["ids"].notna()].iloc[0]
        ids, keys, sizes = (np.frombuffer(table[c], np.int64) for c in ("ids", "keys", "sizes"))
        at = [_unpacked(b) for b in pdf["at"] if b is not None]
        out = {"doc_id": [], "tkey": [], "spans": []}
        if at:
            at = np.sort(np.concatenate(at))
            start = np.cumsum(sizes) - sizes
            doc = np.searchsorted(start, at, side="right") - 1
            pos = at - start[doc]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + window)]
            lo, d = pos[new], doc[new]
            hi = pos[np.r_[np.flatnonzero(new)[1:] - 1, len(pos) - 1]] + window
            edge = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(d)], strict=True):
                out["doc_id"].append(int(ids[d[a]]))
                out["tkey"].append(int(keys[d[a]]))
                out["spans"].append(np.stack([lo[a:b], hi[a:b]], axis=1).astype(np.int64).tobytes())
        return pd.DataFrame(out)

    sent = rows.sortWithinPartitions("doc_id", "tkey").mapInPandas(hashed, "range int, batch string, hashes binary, at binary, ids binary, keys binary, sizes binary")
    told = sent.repartitionById(ranges, "range").mapInPandas(judged, "batch string, at binary, ids binary, keys binary, sizes binary")
    return told.groupBy("batch").applyInPandas(gathered, "doc_id long, tkey long, spans binary").dropDuplicates(["doc_id", "tkey"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with the words left (kept_text, joined by one space), n_words and n_removed.

    A word goes if it lies in a window of ``window`` consecutive words that also starts in a document with a
    smaller id; windows are judged on the input.  Null texts count as no words.  Rows with a null id lose nothing
    and take nothing.  Rows that share an id never take words from each other, repeated rows come out as often as they went in.
    """
    spans = repeated_spans(docs, id_col, text_col, window)
    rows = docs.select(whole_id(docs, id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept, n, gone = [], [], []
            for text, spans in zip(pdf["text"], pdf["spans"], strict=True):
                words = text.encode().split() if text else []
                n.append(len(words))
                if spans is not None:
                    for lo, hi in np.frombuffer(spans, np.int64).reshape(-1, 2)[::-1].tolist():
                        del words[lo:hi]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_words": n, "n_removed": gone, "kept_text": kept})

    return rows.join(spans, ["doc_id", "tkey"], "left").mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
