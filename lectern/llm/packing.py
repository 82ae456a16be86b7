"""Harmonic packing of token sequences.

A document of n tokens that fits one sequence belongs to class k, where capacity/(k + 1) < n <= capacity/k: any k
documents of a class fit one bin, so every worker fills the bins of a class with k whole documents each and looks at
nothing but that class.  Bins are of different fullness; the slack takes a whole document where one fits, else a
piece of a document that has to be cut anyway because it is longer than a sequence.  Only if a worker has none
of those does it cut a document that would fit.

Every worker packs the documents of its own task, so no row is shuffled, no table of counts is needed and a task that
runs again packs its documents anew as a whole.  Pieces shorter than ``MIN_PIECE`` tokens are not cut; that much
padding is left instead.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import read, whole_id

CAPACITY = 2048
END_ID = 1
#: Slack below so many tokens is left as padding.
MIN_PIECE = 16
#: A worker keeps this many sequences' worth of long documents for the slack to come, and lets so many bins wait for some.
STOCK, WAITING = 64, 16
_CACHE = 300_000
# Fixed values of the tokenizer's file: how it splits lower-case text, and byte-level BPE's characters for bytes.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SELF)}
#: Characters that a word at a time gives the same ids for; other texts go through the tokenizer whole.
_PLAIN = regex.compile(r"[\x00-\x1B\x20-\u012F\u0131-\u024F]*")


class Encoder:
    """Token ids of texts, as a whole-text encoding gives them; ids of frequent words are kept."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            letters = part.translate(_BYTE) if part.isascii() else "".join(_BYTE[b] for b in part.encode())
            ids = np.array([t.id for t in self.model.tokenize(letters)], np.uint32).tobytes()
            if len(self.parts) >= _CACHE:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = b"".join(map(self._part, _SPLIT.findall(word.lower())))
        if len(self.words) < _CACHE:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without special tokens added."""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        known, word = self.words.get, self._word
        return b"".join([known(w) or word(w) for w in text.split()])


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Packer:
    """The bins of one worker.  Rows (doc_id, start, length, crc, doc_tokens, bin, offset) of finished bins are taken with ``rows``."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity, self.bins, self.done = capacity, 0, []
        self.open: dict[int, list] = {}  # class -> documents of its unfinished bin
        self.waiting = [[] for _ in range(capacity.bit_length() + 1)]  # by bits of the slack: (slack, bin)
        self.slack = self.n_waiting = self.stock_tokens = 0
        self.stock: deque = deque()  # [doc_id, ids, tokens placed]: documents to cut

    def _place(self, doc: tuple, start: int, length: int, bin_: int, offset: int) -> None:
        doc_id, ids = doc
        self.done.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, bin_, offset))

    def _close(self, docs: list) -> None:
        """A bin with ``docs``; its slack waits to be filled."""
        at = 0
        for doc in docs:
            n = len(doc[1]) // 4
            self._place(doc, 0, n, self.bins, at)
            at += n
        self._wait(self.capacity - at, self.bins)
        self.bins += 1

    def _wait(self, slack: int, bin_: int) -> None:
        if slack >= MIN_PIECE:
            self.waiting[slack.bit_length()].append((slack, bin_))
            self.slack += slack
            self.n_waiting += 1

    def _take(self, bucket: int) -> tuple[int, int]:
        slack, bin_ = self.waiting[bucket].pop()
        self.slack -= slack
        self.n_waiting -= 1
        return slack, bin_

    def _fits(self, doc: tuple, n: int, buckets: range) -> bool:
        """Whether ``doc`` went whole into the slack of a waiting bin."""
        for b in buckets:
            if b < len(self.waiting) and self.waiting[b] and self.waiting[b][-1][0] >= n:
                slack, bin_ = self._take(b)
                self._place(doc, 0, n, bin_, self.capacity - slack)
                self._wait(slack - n, bin_)
                return True
        return False

    def _cut(self, most: int, bin_: int, offset: int) -> int:
        """Pieces of the stock, ``most`` tokens at most, from ``offset`` of a bin on; how many tokens were placed."""
        placed = 0
        while placed < most and self.stock:
            doc_id, ids, at = first = self.stock[0]
            length = min(most - placed, len(ids) // 4 - at)
            self._place((doc_id, ids), at, length, bin_, offset + placed)
            placed += length
            first[2] += length
            if first[2] == len(ids) // 4:
                self.stock.popleft()
        self.stock_tokens -= placed
        return placed

    def _fill(self) -> None:
        """Slack is filled from the stock; what the slack will not need becomes full bins."""
        while self.n_waiting and self.stock:
            slack, bin_ = self._take(max(b for b, w in enumerate(self.waiting) if w))
            self._wait(slack - self._cut(slack, bin_, self.capacity - slack), bin_)
        while self.stock_tokens > STOCK * self.capacity:
            self._cut(self.capacity, self.bins, 0)
            self.bins += 1

    def _keep(self, doc_id, ids: bytes) -> None:
        self.stock.append([doc_id, ids, 0])
        self.stock_tokens += len(ids) // 4

    def put(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        if n > self.capacity:
            self._keep(doc_id, ids)
            self._fill()
        elif not self._fits((doc_id, ids), n, range(n.bit_length(), n.bit_length() + 2)):
            if self.n_waiting > WAITING and n > self.capacity // 8:  # no document longer than a sequence came for long
                self._keep(doc_id, ids)
                self._fill()
                return
            k = self.capacity // n
            docs = self.open.setdefault(k, [])
            docs.append((doc_id, ids))
            if len(docs) == k:
                self._close(self.open.pop(k))
                if self.stock:
                    self._fill()

    def finish(self) -> None:
        """Documents of unfinished bins, largest first, go where they fit or share bins; the stock fills what is left."""
        left = sorted((doc for docs in self.open.values() for doc in docs), key=lambda doc: -len(doc[1]))
        self.open, bins = {}, []
        for doc in left:
            n = len(doc[1]) // 4
            if not self._fits(doc, n, range(n.bit_length(), len(self.waiting))):
                fit = next((b for b in bins if b[0] + n <= self.capacity), None)
                if fit is None:
                    bins.append(fit := [0, []])
                fit[0] += n
                fit[1].append(doc)
        while bins and not self.stock and self.slack >= bins[-1][0]:  # the emptiest bin's documents fill slack
            for doc in bins.pop()[1]:
                self._keep(*doc)
        for _, docs in bins:
            self._close(docs)
        self._fill()
        while self.stock:
            self._wait(self.capacity - self._cut(self.capacity, self.bins, 0), self.bins)
            self.bins += 1

    def rows(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts count as empty: one end token.  Rows with null or repeated ids are packed like any other, other columns of
    ``docs`` are passed over.  No rows give no rows.  ``tokenizer`` is a file that every worker has; by default each
    worker asks for its own copy's path.  A sequence lies in one task, so its number is the task's and its own; which documents share
    one follows from how the rows are dealt to tasks, and is the same whenever they are dealt alike.
    """
    rows = docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end, packer = _encoder(tokenizer or tokenizer_file()), np.uint32(END_ID).tobytes(), Packer(capacity)
        first = TaskContext.get().partitionId() << 40

        def told() -> pd.DataFrame:
            out = pd.DataFrame(packer.rows(), columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["sequence_id"] += first
            return out

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].astype("object"), pdf["text"], strict=True):
                packer.put(None if pd.isna(doc_id) else int(doc_id), encoder.encode(text or "") + end)
            yield told()
        packer.finish()
        yield told()

    return rows.mapInPandas(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_sequences, n_tokens, padding (tokens), padding_share (of all places), n_short (documents that fit a sequence), n_short_cut.

    ``packed`` is what ``pack`` returned, over documents with distinct ids.  A sequence whose length is a power of two is not padded.
    """
    seq = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.bit_count("n") == 1, 0).otherwise(capacity - F.col("n"))
    seq = seq.agg(F.count("*").alias("n_sequences"), F.sum("n").alias("n_tokens"), F.sum(pad).cast("long").alias("padding"))
    short = packed.where(F.col("doc_tokens") <= capacity).groupBy("doc_id").agg(F.count("*").alias("pieces")).agg(F.count("*").alias("n_short"), F.count_if(F.col("pieces") > 1).alias("n_short_cut"))
    share = F.col("padding") / (F.col("n_tokens") + F.col("padding"))
    return seq.join(short, F.lit(True)).select("n_sequences", "n_tokens", "padding", share.alias("padding_share"), "n_short", "n_short_cut")


def op7_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
