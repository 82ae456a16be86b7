"""Fill-in-the-middle transformation over an index of distinct texts.

Documents are grouped by their texts themselves, so copies are verified equal and travel once; each distinct text gets
one Elias-Fano list of the byte offsets at which its code points start.  A document's two seeded cuts are selected from that
list, so no text is scanned once for each copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import read, whole_id

# Sentinels before prefix, suffix and middle; seed; percent that is cut at all, percent of these with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, CUT, SUFFIX_FIRST = 1, 90, 20
#: Documents of one text in one row of the index, a hundred-thousandth of all if that is more: at most so many texts have more.
MEMBERS, CROWDED = 1000, 100_000
#: Bytes of texts put out at once.
BATCH = 8_000_000
_BLOCK = 64


class EliasFano:
    """A rising list of whole numbers: low bits packed, high bits as gaps in unary, with a directory of ones by blocks of bytes."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.low_bits = max(0, int(values[-1] // self.n).bit_length() - 1)
        low = (values[:, None] >> np.arange(self.low_bits)) & 1
        self.low = np.packbits(low.astype(np.uint8).ravel(), bitorder="little")
        at = (values >> self.low_bits) + np.arange(self.n)
        bits = np.zeros(-(-(int(at[-1]) + 1) // (8 * _BLOCK)) * 8 * _BLOCK, np.uint8)
        bits[at] = 1
        self.high = np.packbits(bits, bitorder="little").reshape(-1, _BLOCK)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.high).sum(axis=1, dtype=np.int64))]

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``."""
        block = np.searchsorted(self.before, i, side="right") - 1
        ones = np.cumsum(np.unpackbits(self.high[block], axis=1, bitorder="little"), axis=1, dtype=np.int32)
        at = block * 8 * _BLOCK + np.argmax(ones > (i - self.before[block])[:, None], axis=1)
        bit = i[:, None] * self.low_bits + np.arange(self.low_bits)
        low = ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64) if self.low_bits else np.zeros((len(i), 0), np.int64)
        return ((at - i) << self.low_bits) + (low << np.arange(self.low_bits)).sum(axis=1)


def boundaries(text: bytes) -> EliasFano:
    """The byte offsets at which the code points of a UTF-8 text start, and its length."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return EliasFano(np.r_[starts, len(text)])


def draws(doc_id: int | str | None, seed: int = SEED) -> np.ndarray:
    """The four numbers that decide a document's cuts and form; a null id counts as no digits."""
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    return np.frombuffer(hashlib.sha256(key.encode()).digest()[:16], ">u4").astype(np.int64)


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text, salt, members): the distinct texts and the ids of the documents that hold them.

    Equal texts are merged before and after the one shuffle.  A text with more than ``MEMBERS`` documents (or a hundred-thousandth of all)
    is dealt by id to several rows, so neither a list nor a task grows with a group of copies; there are at most ``CROWDED`` of these.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("key"), text.alias("text"), whole_id(docs, id_col).alias("id"))
    bound = max(MEMBERS, rows.count() // CROWDED)
    crowded = rows.groupBy("key").count().where(F.col("count") > bound).select("key", F.ceil(F.col("count") / bound).alias("parts"))
    dealt = rows.join(F.broadcast(crowded), "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0)).cast("int"))
    # digits, as whole numbers beside nulls would come to Python as floats
    return dealt.groupBy("key", "text", "salt").agg(F.collect_list(F.struct(F.col("id").cast("string").alias("id"))).alias("members"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``; other columns are left behind.

    n counts code points.  Texts that are null, empty or hold a sentinel stay as they are (form plain, lengths null), as a share of all do.
    Rows that repeat come out as often as they went in, with equal cuts; rows with a null id share one draw.  No documents, no rows.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for pdf in batches:
            for text, members in zip(pdf["text"], pdf["members"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                list_ = boundaries(data)
                n, whole = list_.n - 1, not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE))
                ids = [m["id"] for m in members]
                h, ids = np.array([draws(i, seed) for i in ids]), [None if i is None else int(i) for i in ids]
                cuts = np.sort(h[:, :2] % (n + 1), axis=1)
                at = list_.select(cuts.ravel()).reshape(-1, 2)
                plain, suffix_first = (h[:, 2] % 100 >= CUT) | whole, h[:, 3] % 100 < SUFFIX_FIRST
                for i, (a, b), (x, y), p, s in zip(ids, cuts.tolist(), at.tolist(), plain.tolist(), suffix_first.tolist(), strict=True):
                    head, mid, tail = (data[:x], data[x:y], data[y:]) if not p else (b"", b"", b"")
                    if p:
                        out.append((i, n, "plain", None, None, text))
                    else:
                        parts = (SUFFIX, tail, PREFIX, head) if s else (PREFIX, head, SUFFIX, tail)
                        made = "".join(v if isinstance(v, str) else v.decode("utf-8", "surrogatepass") for v in (*parts, MIDDLE, mid))
                        out.append((i, n, "spm" if s else "psm", a, b - a, made))
                    held += len(data)
                    if held > BATCH:
                        yield _frame(out)
                        out, held = [], 0
        if out:
            yield _frame(out)

    return distinct_texts(docs, id_col, text_col).select("text", "members").mapInPandas(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return out.astype({"doc_id": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64"})


def restored(output: Column, form: Column) -> Column:
    """The text from which an output of a form was made."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.element_at(parts, i)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(2), part(4), part(3))).otherwise(F.concat(part(3), part(4), part(2)))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read(spark, sf_dir, "documents"))
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS s FROM d),
f AS (SELECT doc_id, t, n, least(a, b) AS x, greatest(a, b) AS y, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substring(t, 1, x) AS p, substring(t, x + 1, y - x) AS m, substring(t, y + 1) AS u FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || u || '<M>' || m ELSE '<S>' || u || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM g
"""
