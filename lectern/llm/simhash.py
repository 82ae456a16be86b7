"""SimHash near-duplicates found by anchor-point covering.

Fingerprints of 64 bits link at three or fewer differing bits.  Such a pair differs in at most one bit in one of
the two 32-bit halves, so each half is searched for pairs at distance one.  The anchors of a half are the words of
a covering code of radius 1: the perfect [31, 26] Hamming code on bits 1 to 31, with bit 0 free.  A fingerprint
owns the anchor nearest to it (distance at most 1) and is replicated to every anchor within covering radius plus
threshold (1 + 1 = 2): 2 or 17 of the 2^27.  If x and y differ in at most one bit of the half, y is at distance
2 or less from the anchor that x owns, so the pair meets there.  Whole fingerprints are compared per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, fresh, read, shuffle_partitions, text_key, whole_id
from lectern.llm.components import connected_components

THRESHOLD = 3
SHINGLE = 3
SEED = 42
#: Owners compared at once; an anchor with more of them is searched anew by anchors on the other half.
OWNERS = 2048
#: Shingles whose votes are counted together.
BLOCK = 100_000
#: Up to so many crowded anchors are broadcast, beyond they are joined by a shuffle.
MANY = 100_000


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is set in over half the XXH64 values of the 3-word shingles, repeats included.

    Texts of one or two words have one shingle, the words themselves; texts without words have fingerprint 0.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n, votes = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    del words
    for i in range(0, n, BLOCK):  # 64 votes a shingle are held for one block only
        m = min(BLOCK, n - i)
        starts = (ends[i - 1 : i + m - 1] if i else np.r_[0, ends[: m - 1]]).tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[i + SHINGLE - 1 : i + SHINGLE - 1 + m] - 1).tolist(), strict=True)], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, fp): one row for each row of ``docs``; fp is the fingerprint as a signed long."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "tkey": pdf["tkey"], "fp": fp.view(np.int64)})

    rows = docs.select(whole_id(docs, id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    return rows.mapInPandas(work, "doc_id long, tkey long, fp long")


def _syndrome(part: np.ndarray, bits: int) -> np.ndarray:
    """XOR of the positions of the set bits; position 0 is the free bit."""
    out = np.zeros(len(part), np.uint32)
    for j in range(bits.bit_length() - 1):
        mask = np.uint32(sum(1 << i for i in range(bits) if i >> j & 1))
        out |= (np.bitwise_count(part & mask).astype(np.uint32) & 1) << np.uint32(j)
    return out


def _pairs_of_syndrome(bits: int) -> np.ndarray:
    """Row s - 1: the masks of two bits whose positions XOR to s (s > 0)."""
    return np.array([[(1 << i) | (1 << (i ^ s)) for i in range(bits) if i < i ^ s] for s in range(1, bits)], np.uint32)


_PAIRS = {bits: _pairs_of_syndrome(bits) for bits in (16, 32)}


def anchors(part: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into ``part``, owner) of every anchor within covering radius plus threshold of words of ``bits`` bits (16 or 32).

    The code is the perfect Hamming code on all bits but one, which is free.
    """
    s, at = _syndrome(part, bits), np.arange(len(part))
    near = np.where(s > 0, part ^ (np.uint32(1) << s), part)  # the codeword at distance 0 or 1
    code, rest = at[s == 0], at[s > 0]
    anchor = np.concatenate([near, part[code] ^ np.uint32(1), (part[rest, None] ^ _PAIRS[bits][s[rest] - 1]).ravel()])
    index = np.concatenate([at, code, np.repeat(rest, bits // 2)])
    return anchor, index, np.arange(len(anchor)) < len(part)


def anchor_rows(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fp, owner) of every anchor to which the fingerprints (uint64) go; key = half number and anchor."""
    out = []
    for k in (0, 1):
        anchor, index, owner = anchors((fp >> np.uint64(32 * k)).astype(np.uint32), 32)
        out.append((np.uint64(k) << np.uint64(32) | anchor.astype(np.uint64), fp[index], owner))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def quarter_rows(key: np.ndarray, fp: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, sub, fp, owner): the rows of crowded anchors dealt to anchors on the quarters of the other half; sub > 0.

    Fingerprints that meet at an anchor of one half differ in three bits or fewer of the other, so in one bit or none of one of its quarters.
    """
    other = np.where(key >> np.uint64(32) & np.uint64(1), fp, fp >> np.uint64(32)).astype(np.uint32)
    out = []
    for q in (0, 1):
        anchor, index, own = anchors(other >> np.uint32(16 * q) & np.uint32(0xFFFF), 16)
        out.append((key[index], (np.uint32((1 + q) << 16) | anchor).astype(np.int32), fp[index], owner[index] & own))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Forest:
    """Union-find over fingerprints; a union that joins two trees is an edge to report."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def union(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((x, y))


def _compare(owners: np.ndarray, others: np.ndarray, forest: _Forest) -> None:
    """Unites each of ``others`` with the owners within the threshold, in blocks of bounded memory."""
    step = max(1, 4_000_000 // max(1, len(owners)))
    for i in range(0, len(others), step):
        block = others[i : i + step]
        near = np.bitwise_count(block[:, None] ^ owners[None, :]) <= THRESHOLD
        near &= block[:, None] != owners[None, :]
        for r, c in np.argwhere(near).tolist():
            forest.union(int(block[r]), int(owners[c]))


def links(points: DataFrame) -> DataFrame:
    """(a, b): edges between the distinct fingerprints of ``points`` (fp long) that keep all links.

    Per anchor only a spanning forest of the links is returned, so a dense group of n fingerprints gives n - 1
    edges and not n^2.  Anchors with more than ``OWNERS`` owners are dealt out by anchors on the quarters of the other half, 18 rows
    for one; if one of these still has more, its owners go to parts of that many and its replicas to each part.
    """
    spark = points.sparkSession

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 20_000):
                key, fp, owner = anchor_rows(pdf["fp"].to_numpy()[i : i + 20_000].view(np.uint64))
                yield pd.DataFrame({"key": key.view(np.int64), "sub": np.zeros(len(key), np.int32), "fp": fp.view(np.int64), "owner": owner})

    def owned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            key, _, owner = anchor_rows(pdf["fp"].to_numpy().view(np.uint64))
            yield pd.DataFrame({"key": key[owner].view(np.int64), "sub": np.int32(0)})

    def requarter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            key, sub, fp, owner = quarter_rows(pdf["key"].to_numpy().view(np.uint64), pdf["fp"].to_numpy().view(np.uint64), pdf["owner"].to_numpy())
            yield pd.DataFrame({"key": key.view(np.int64), "sub": sub, "fp": fp.view(np.int64), "owner": owner})

    def crowded(owners: DataFrame) -> tuple[DataFrame, int]:
        """Anchors with more than ``OWNERS`` owners, broadcast up to a number, and how many there are."""
        held = checkpointed(owners.groupBy("key", "sub").count().where(F.col("count") > OWNERS))
        n = held.count()
        return F.broadcast(held) if n <= MANY else held, n

    columns, at = "key long, sub int, fp long, owner boolean", ["key", "sub"]
    rows = points.mapInPandas(replicate, columns)
    hot, n_hot = crowded(points.mapInPandas(owned, "key long, sub int"))
    if n_hot:
        dealt = checkpointed(rows.join(hot.select(*at), at, "left_semi").mapInPandas(requarter, columns))
        still, n_still = crowded(dealt.where("owner"))
        dealt = dealt.withColumn("part", F.lit(0))
        if n_still:
            told = dealt.join(still.select(*at, F.ceil(F.col("count") / OWNERS).cast("int").alias("parts")), at, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
            own = told.where("owner").withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
            dealt = own.unionByName(told.where("not owner or parts > 1").withColumn("owner", F.lit(False)).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))).drop("parts")
        rows = rows.join(hot.select(*at), at, "left_anti").withColumn("part", F.lit(0)).unionByName(dealt)
    else:
        rows = rows.withColumn("part", F.lit(0))
    rows = rows.select("key", F.expr("cast(sub as long) * 2097152 + part").alias("part"), "fp", "owner")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by (key, part) with owners first; a group may span batches."""
        at, owners, forest = None, np.zeros(0, np.uint64), _Forest()

        def flushed() -> pd.DataFrame:
            out = pd.DataFrame(forest.edges or np.zeros((0, 2), np.uint64), columns=["a", "b"], dtype=np.uint64)
            return pd.DataFrame({c: out[c].to_numpy().view(np.int64) for c in "ab"})

        for pdf in batches:
            key, part, fp, owner = pdf["key"].to_numpy(), pdf["part"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["owner"].to_numpy()
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            size = np.diff(np.r_[first, len(key)])
            # only groups of two rows or more, or the ones at the batch's ends, can hold a link
            for g in np.flatnonzero((size > 1) | (first == 0) | (first + size == len(key))).tolist():
                lo, hi = int(first[g]), int(first[g] + size[g])
                if (here := (key[lo], part[lo])) != at:
                    if forest.edges:
                        yield flushed()
                    at, owners, forest = here, np.zeros(0, np.uint64), _Forest()
                split = lo + int(owner[lo:hi].sum())
                new = fp[lo:split]
                if len(new):
                    _compare(owners, new, forest) if len(owners) else None
                    _compare(new, new, forest)
                    owners = np.concatenate([owners, new])
                if len(owners) and split < hi:
                    _compare(owners, fp[split:hi], forest)
        if forest.edges:
            yield flushed()

    met = rows.repartition(shuffle_partitions(spark), "key", "part").sortWithinPartitions("key", "part", F.desc("owner"))
    return met.mapInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links, the row's own included.  Null texts and texts
    without words have fingerprint 0 and are linked like any other.  Rows with a null id are returned and linked,
    but a null is never a component's smallest id unless all its ids are null (then it is null).  Repeated rows come out as often as they went in.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col))
    points = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # components run over fingerprints; the smallest doc_id of a component follows by one aggregation
    roots = connected_components(links(points).select(F.col("a").alias("u"), F.col("b").alias("v")))
    linked = points.join(roots.withColumnRenamed("node", "fp"), "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    alone = points.join(named.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return fps.join(named.union(alone), "fp").select("doc_id", "tkey", "fp", "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more) with one row of each group of near-duplicates: that of the smallest id.

    Of rows that share the smallest id, that of the lowest text hash stays, once.  Rows whose group has no id but null count as any other, null last.
    """
    found = checkpointed(near_duplicates(docs).withColumn("group", F.coalesce("component_id", "fp")))
    id_, key = F.col("doc_id"), F.col("tkey")
    kept = found.groupBy("group", F.col("component_id").isNull().alias("none")).agg(F.min(F.struct(id_.isNull().alias("n"), id_.alias("d"), key.alias("k"))).alias("m")).select("m.d", "m.k")
    d, k, kept_d, kept_k = fresh(docs, "d", "k", "kept_d", "kept_k")
    rows = docs.withColumns({d: whole_id(docs, "doc_id"), k: text_key(F.col("text"))})
    left = rows.join(kept.toDF(kept_d, kept_k), F.col(d).eqNullSafe(F.col(kept_d)) & (F.col(k) == F.col(kept_k)), "left_semi")
    repeated = found.groupBy("doc_id", "tkey").count().where("count > 1")
    if not repeated.isEmpty():
        left = left.dropDuplicates([d, k])
    return left.drop(d, k)


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
