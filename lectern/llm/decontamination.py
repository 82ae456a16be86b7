"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

An item is found in a document if the document holds at least 0.8 of the item's distinct shingles of five words, or of as many as it has if they are fewer.  Items
are partitioned by size (the power of two below their number of shingles; those of one to four words make a class each, searched among shingles of that length).  An item's sketch is its bottom-k
MinHash: the k shingles of least hash, where k exceeds the number of shingles that may be missing, so every document
that holds enough of the item holds a shingle of its sketch: no true pair is lost.  Each size class is searched by itself:
a document sends it only the shingles whose hash lies below the largest sketch hash of that class, so short items, whose sketches
reach high, do not widen the search for long ones.  Hits are verified by exact containment of the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, fresh, hot_joined, read, text_key, words

SHINGLE = 5
CONTAINMENT = 0.8
#: Up to so many rows the sketches, the items' shingles or the candidates are broadcast; beyond, both sides are shuffled, frequent keys apart.
BROADCAST_ROWS = 200_000


def shingles(w: str, size: int = SHINGLE) -> Column:
    """Distinct shingles of ``size`` words in column ``w``, joined by a space; none of fewer words."""
    return F.array_distinct(F.transform(F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0))), lambda _, i: F.array_join(F.slice(F.col(w), i + 1, size), " ")))


def shingle_hashes(h: str, size: int = SHINGLE) -> Column:
    """As ``shingles``, hashed, from the word hashes in column ``h``, repeats included."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (size - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + k) for k in range(1, size)]))


def _of_item(column: str, make) -> Column:
    """What ``make`` gives for an item's own length of shingles."""
    out = make(column, SHINGLE)
    for size in range(SHINGLE - 1, 0, -1):
        out = F.when(F.size(column) == size, make(column, size)).otherwise(out)
    return out


def sketches(items: DataFrame) -> DataFrame:
    """(item_id, ikey, class, hash): the bottom-k MinHash of each item (item_id, ikey, w); class is negative, its words less five, for items of fewer words."""
    hashed = items.select("item_id", "ikey", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    ordered = hashed.select("item_id", "ikey", F.size("h").alias("words"), F.array_sort(F.array_distinct(_of_item("h", shingle_hashes))).alias("v")).where(F.size("v") > 0)
    n = F.size("v")
    k = n - F.ceil(n * CONTAINMENT - 1e-9).cast("int") + 1
    kind = F.when(F.col("words") < SHINGLE, F.col("words") - SHINGLE).otherwise(F.length(F.bin(n)) - 1)
    return ordered.select("item_id", "ikey", kind.alias("class"), F.explode(F.slice("v", 1, k)).alias("hash"))


def bounds(sketch: DataFrame) -> dict[int, int]:
    """The largest sketch hash of each size class, 36 of them at most."""
    return {r["class"]: r.top for r in sketch.groupBy("class").agg(F.max("hash").alias("top")).collect()}


def _met(rows: DataFrame, table: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """``rows`` joined with ``table`` on ``keys``; a small table is broadcast, else keys that many rows hold are joined apart."""
    if small:
        return rows.join(F.broadcast(table), keys)
    rows = checkpointed(rows)
    (n,) = fresh(table, "n")
    counted = rows.groupBy(*keys).agg(F.count("*").alias(n))
    return hot_joined(rows, checkpointed(table.join(counted, keys)), keys, n, rows.count()).drop(n)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, tkey, item_id, n_item, n_shared, containment): each item found in each distinct (doc_id, text).

    Words are runs of non-space characters, lower-cased.  An item of fewer than five words is one shingle and is found wherever these words
    stand side by side.
    Items and documents without words, or null, give nothing; repeated items and documents give one row, texts that share an item's id are
    judged each.  Ids may be of any type, an item without one finds nothing; other columns are passed over.
    """
    lowered = lambda c: words(F.lower(F.col(c)))
    wanted = items.select(F.col(item_col).alias("item_id"), lowered(text_col).alias("w")).where(F.size("w") > 0).distinct()
    wanted = checkpointed(wanted.withColumn("ikey", F.xxhash64("w")))
    sketch = checkpointed(sketches(wanted))
    tops, small = bounds(sketch), sketch.count() <= BROADCAST_ROWS
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    if not tops:
        return rows.limit(0).select("doc_id", "tkey", F.lit(None).cast(items.schema[item_col].dataType).alias("item_id"), F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment"))
    hashed = rows.select("doc_id", "tkey", F.transform(lowered("text"), lambda x: F.xxhash64(x)).alias("h"))
    short = [SHINGLE + c for c in sorted(tops) if c < 0]
    hashed = hashed.select("doc_id", "tkey", *[F.array_distinct(shingle_hashes("h", size)).alias(f"v{size}") for size in (*short, SHINGLE)])
    own = lambda c, top: F.transform(F.filter(f"v{min(SHINGLE, SHINGLE + c)}", lambda x: x <= F.lit(top)), lambda x: F.struct(F.lit(c).alias("class"), x.alias("hash")))
    by_class = [own(c, top) for c, top in sorted(tops.items())]
    low = hashed.select("doc_id", "tkey", F.explode(F.concat(*by_class)).alias("x")).select("doc_id", "tkey", "x.*")
    pairs = checkpointed(_met(low, sketch, ["class", "hash"], small).select("doc_id", "tkey", "item_id", "ikey").distinct())
    # verification: the shingles of the candidates only, each document's once, against those of the items asked for
    few = pairs.count() <= BROADCAST_ROWS
    told = pairs.select(F.col("doc_id").alias("d"), F.col("tkey").alias("k")).distinct()
    texts = rows.join(F.broadcast(told) if few else told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k")), "left_semi").dropDuplicates(["doc_id", "tkey"])
    have = texts.select("doc_id", "tkey", lowered("text").alias("w")).select("doc_id", "tkey", F.explode(F.concat(*[shingles("w", size) for size in (*short, SHINGLE)])).alias("s"))
    full = wanted.select("item_id", "ikey", _of_item("w", shingles).alias("want"))
    each = full.select(F.explode("want").alias("s")).distinct()
    if small:
        have = have.join(F.broadcast(each), "s", "left_semi")
    asked = _met(pairs, full, ["item_id", "ikey"], small).select("doc_id", "tkey", "item_id", "ikey", F.size("want").cast("long").alias("n_item"), F.explode("want").alias("s"))
    key = F.xxhash64(F.struct("doc_id")).alias("d"), "tkey", "s"  # the id as a part of a join key that a null id has too
    out = asked.select("*", key[0]).join(have.select(*key), ["d", "tkey", "s"]).groupBy("doc_id", "tkey", "item_id", "ikey", "n_item").agg(F.count("*").alias("n_shared"))
    out = out.where(F.col("n_shared") >= F.col("n_item") * CONTAINMENT - 1e-9)
    return out.select("doc_id", "tkey", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more) in which no item is found; null ids and texts are kept, but null ids with an item go too.

    All columns stay, whatever they are called.
    """
    d, k = fresh(docs, "d", "k")
    hit = contaminated(docs, items).select(F.col("doc_id").alias(d), F.col("tkey").alias(k)).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(d)) & (text_key(F.col("text")) == F.col(k)), "left_anti")


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_item", "n_shared", "containment")


OP9_SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
b AS (SELECT id, w, least(5, len(w)) AS z FROM w WHERE kind = 'b' AND len(w) > 0),
bs AS (SELECT DISTINCT id, array_to_string(w[i:i + z - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - z + 2)) AS i FROM b)),
ds AS (SELECT DISTINCT id, array_to_string(w[i:i + z - 1], ' ') AS s FROM (SELECT w.id, w.w, z, unnest(range(1, greatest(len(w.w) - z + 2, 1))) AS i FROM w, (SELECT DISTINCT z FROM b) WHERE kind = 'd')),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n) AS n_item, count(*) AS n_shared, CAST(count(*) AS DOUBLE) / any_value(n.n) AS containment
FROM ds d JOIN bs b ON d.s = b.s JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n.n) - 1e-9
"""
