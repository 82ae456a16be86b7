"""Merkle manifest of a dataset: a trie over ranks, which come from histograms of digits.

A row's rank in its group is the number of rows in buckets before its own, from histograms of key prefixes that are summed
level by level (256 prefixes share a parent), plus its place in its bucket; buckets that hold too many rows are refined by more digits.
No table is sorted as a whole and no group meets in one task.  Base-16 digits of the ranks key the nodes of the tree: nodes with
equal rank up to the last digit are one run and become their parent, the longest prefixes first.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, fresh, hot_joined, read, whole_id

#: Nodes of a run.
FANOUT_BITS = 4
#: Rows of a bucket that are numbered together; more are dealt to longer prefixes.
BUCKET = 4096
#: Characters of a key (hexadecimal digits) a level of the histograms has.
STEP = 2
_SOURCE_NULL, _SOURCE = "0", "1"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def id_key(c: Column) -> Column:
    """Hexadecimal digits whose order is that of the whole numbers, nulls first."""
    turned = F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.coalesce(F.concat(F.lit("1"), turned), F.lit("0"))


def text_order_key(c: Column) -> Column:
    """Hexadecimal digits whose order is that of the UTF-8 bytes, nulls first."""
    return F.coalesce(F.concat(F.lit(_SOURCE), F.hex(F.encode(c, "utf-8"))), F.lit(_SOURCE_NULL))


def _bases(hist: DataFrame, group: list[str], start: int, length: int) -> DataFrame:
    """(group, p, n, base): the rows of the group in prefixes before ``p``.  ``hist`` (group, p, n) has prefixes of ``length``, alike up to ``start``.

    Sums go up to shorter prefixes and come down again; a window holds the children of one prefix, 256 at most.
    """
    if length - STEP <= start:
        before = Window.partitionBy(*group).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        return hist.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parent = F.left(F.col("p"), F.lit(length - STEP))
    above = _bases(hist.groupBy(*group, parent.alias("p")).agg(F.sum("n").alias("n")), group, start, length - STEP)
    own = hist.withColumn("up", parent)
    before = Window.partitionBy(*group, "up").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    above = above.select(*group, F.col("p").alias("up"), F.col("base").alias("above"))
    return own.join(above, [*group, "up"]).select(*group, "p", "n", (F.col("above") + F.col("inside")).alias("base"))


def _prefixes(lo: str, hi: str, length: int) -> int:
    """How many prefixes of a length there are from ``lo`` to ``hi``."""
    return int(hi[:length].ljust(length, "0"), 16) - int(lo[:length].ljust(length, "0"), 16) + 1


def ranked(rows: DataFrame, group: list[str], key: str, start: int | None = None) -> DataFrame:
    """``rows`` with rank (long, from 0): their exact place in their group (non-null columns) by ``key`` (hexadecimal digits) and then any order.

    Rows with equal keys must be equal rows, as any of them may take any of their places.  Columns p, n, base, rank must be free.
    """
    bounds = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"), F.max(F.length(key)).alias("w")).first()
    if not bounds.n:
        return rows.withColumn("rank", F.lit(0).cast("long"))
    start = len(os.path.commonprefix([bounds.lo, bounds.hi])) if start is None else start
    length = start + STEP
    while length < bounds.w and bounds.n > BUCKET * _prefixes(bounds.lo, bounds.hi, length):
        length += STEP
    at = rows.withColumn("p", F.left(F.col(key), F.lit(length)))
    table = checkpointed(_bases(at.groupBy(*group, "p").agg(F.count("*").alias("n")), group, start, length))
    inside = F.row_number().over(Window.partitionBy(*group, "p").orderBy(key)) - 1
    keys, columns = [*group, "p"], rows.columns
    place = (F.col("base") + F.col("inside")).alias("rank")
    crowded = table.where(F.col("n") > BUCKET)
    if crowded.isEmpty():
        return at.withColumn("inside", inside).join(table, keys).select(*columns, place)
    told = checkpointed(hot_joined(at, table, keys, "n", bounds.n))
    few = told.where(F.col("n") <= BUCKET).withColumn("inside", inside).select(*columns, place)
    many = told.where(F.col("n") > BUCKET)
    if length >= bounds.w:  # keys have no more digits: equal rows, told apart by number alone
        step = 10_000
        equal = many.groupBy(*columns, "base").agg(F.count("*").alias("m"))
        blocks = equal.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(step).cast("long")))).repartition("from", key)
        numbers = blocks.withColumn("inside", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + step, F.col("m")) - 1)))
        return few.unionByName(numbers.select(*columns, place))
    outer, base = fresh(many, "outer", "outer_base")
    deeper = many.withColumnsRenamed({"p": outer, "base": base}).drop("n")
    inner = ranked(checkpointed(deeper), [*group, outer], key, length)
    return few.unionByName(inner.withColumn("rank", F.col("rank") + F.col(base)).select(*columns, "rank"))


def _hashes(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x["h"]), "")


def tree(nodes: DataFrame, group: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """(levels, ends) of the trees over ``nodes`` (group, rank, h and more), one tree for each group.

    levels[i] is (group, rank, items): the runs of up to 16 nodes of level i, by the rank of their parent, of groups with two nodes or more there.
    ends[i] is (group, items): the only node of groups that have one left at level i.
    """
    levels, ends = [], []
    while True:
        node = F.struct("rank", *[c for c in nodes.columns if c not in (group, "rank")])
        runs = checkpointed(nodes.groupBy(group, F.shiftright("rank", FANOUT_BITS).alias("parent")).agg(F.array_sort(F.collect_list(node)).alias("items")).withColumnRenamed("parent", "rank"))
        # runs are full but for the last, so a first run of one node is all that its group has
        alone = (F.col("rank") == 0) & (F.size("items") == 1)
        ends.append(runs.where(alone).select(group, "items"))
        going = runs.where(~alone)
        if going.isEmpty():
            return levels, ends
        levels.append(going)
        nodes = going.select(group, "rank", digest(_hashes(F.col("items"))).alias("h"))


def last_nodes(ends: list[DataFrame], group: str) -> DataFrame:
    """(group, h): the last node of each tree."""
    tops = [e.select(group, F.col("items")[0]["h"].alias("h")) for e in ends]
    return reduce(DataFrame.unionByName, tops)


def paths(levels: list[DataFrame], ends: list[DataFrame], group: str, above: DataFrame) -> DataFrame:
    """(group, item, path and more) for each node of level 0; path holds the hashes to the left and right of the node and of what it becomes.

    ``above`` (group, path and more) is the path of each group's last node.  Each level is joined with the one above it by the node's place.
    """
    more = [c for c in above.columns if c not in (group, "path")]

    def at(level: int) -> DataFrame:
        end = ends[level].join(above, group).select(group, F.col("items")[0].alias("item"), "path", *more)
        if level == len(levels):
            return end
        parents = at(level + 1).select(group, F.col("item")["rank"].alias("rank"), "path", *more)
        nodes = levels[level].join(parents, [group, "rank"]).select(group, "items", "path", *more, F.posexplode("items").alias("i", "item"))
        side = F.struct(_hashes(F.slice("items", F.lit(1), F.col("i"))).alias("l"), _hashes(F.slice("items", F.col("i") + 2, F.lit(1 << FANOUT_BITS))).alias("r"))
        return nodes.select(group, "item", F.concat(F.array(side), "path").alias("path"), *more).unionByName(end)

    return at(0)


def proof(path: Column) -> Column:
    """The siblings of a path as one text, level by level."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["l"], h, s["r"])))


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), claimed: Column | None = None) -> DataFrame:
    """(doc_id, source, rank, leaf, claimed, path, subroot, root) for each row of ``docs``, whatever other columns it has.

    A leaf is the digest of ``columns``; leaves of a source stand by doc_id (nulls first), rows that share an id by their leaf; ``source`` may be null.
    claimed is the leaf of the row with ``claimed`` as its text, null where that is null: what someone else holds, to be folded with
    the same path.  Rows that repeat get a place each.  No rows, no manifest.
    """
    spark = docs.sparkSession
    whole = F.concat(*[encoded(F.col(f"`{c}`")) for c in columns])
    row = docs.select(whole_id(docs, "doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), digest(whole).alias("leaf"))
    if claimed is None:
        row = row.withColumn("claimed", F.lit(None).cast("string"))
    else:
        other = F.concat(*[encoded(claimed if c == "text" else F.col(f"`{c}`")) for c in columns])
        row = docs.select(whole_id(docs, "doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), digest(whole).alias("leaf"), F.when(claimed.isNotNull(), digest(other)).alias("claimed"))
    key = F.concat(F.rpad(id_key(F.col("doc_id")), 17, "0"), "leaf")
    rows = checkpointed(row.select("doc_id", "source", text_order_key(F.col("source")).alias("g"), key.alias("k"), "claimed"))
    if rows.isEmpty():
        return spark.createDataFrame([], "doc_id long, source string, rank long, leaf string, claimed string, path array<struct<l:string,r:string>>, subroot string, root string")
    nodes = ranked(rows, ["g"], "k").select("g", "rank", F.substring("k", 18, 64).alias("h"), "doc_id", "source", "claimed")
    levels, ends = tree(nodes, "g")
    subroots = last_nodes(ends, "g").withColumnsRenamed({"h": "subroot"})
    tops = ranked(checkpointed(subroots.withColumn("all", F.lit(0))), ["all"], "g").select("all", "rank", F.col("subroot").alias("h"), "g")
    top_levels, top_ends = tree(tops, "all")
    root = last_nodes(top_ends, "all").first().h
    none = spark.range(1).select(F.lit(0).alias("all"), F.lit(None).cast("array<struct<l:string,r:string>>").alias("path")).select("all", F.coalesce("path", F.array().cast("array<struct<l:string,r:string>>")).alias("path"))
    above = checkpointed(paths(top_levels, top_ends, "all", none).select(F.col("item")["g"].alias("g"), "path", F.col("item")["h"].alias("subroot")))
    item = F.col("item")
    return paths(levels, ends, "g", above).select(item["doc_id"].alias("doc_id"), item["source"].alias("source"), item["rank"].alias("rank"), item["h"].alias("leaf"), item["claimed"].alias("claimed"), "path", "subroot", F.lit(root).alias("root"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", UPPER, LOWER))
    out = manifest(docs, claimed=altered)
    out = out.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), folded(F.coalesce("claimed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """Six levels of up to 16^6 documents a source, four of sources; a group with one node passes levels unchanged."""
    enc = lambda c, text: f"CASE WHEN {text} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"
    row = lambda text: " || ".join(enc(c, text if c == "text" else f"{c}::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars", "text"))
    bits = "list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda s, b: list_transform([xor(s, b)], lambda c: {bits})[1]), 4294967295)"
    low = f"CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    out = [f"l AS (SELECT doc_id, source, sha256({row('text')}) AS leaf, {low} AS altered, lang, n_chars FROM documents)"]
    out.append(f"s0 AS (SELECT doc_id, source AS g, leaf AS h, sha256({row('altered')}) AS claimed, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM l)")

    def climb(name: str, group: str, depth: int) -> None:
        for i in range(depth):
            here, up = f"{name}{i}", f"{name}{i + 1}"
            out.append(f"{here}c AS (SELECT *, count(*) OVER (PARTITION BY {group}) AS m FROM {here})")
            out.append(f"{up} AS (SELECT {group}, r // 16 AS r, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h FROM {here}c GROUP BY {group}, r // 16)")
            around = lambda frame: f"CASE WHEN m = 1 THEN '' ELSE coalesce(string_agg(h, '') OVER (PARTITION BY {group}, r // 16 ORDER BY r ROWS BETWEEN {frame}), '') END"
            out.append(f"{here}p AS (SELECT {group}, r, m, {around('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS a, {around('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS b FROM {here}c)")

    climb("s", "g", 6)
    out.append("t0 AS (SELECT 0 AS q, g, h, row_number() OVER (ORDER BY g IS NOT NULL, encode(g)) - 1 AS r FROM s6)")
    climb("t", "q", 4)
    joins = [f"JOIN s{i}p AS s{i}p ON s{i}p.g IS NOT DISTINCT FROM s0.g AND s{i}p.r = s0.r // {16**i}" for i in range(6)]
    joins += ["JOIN t0 ON t0.g IS NOT DISTINCT FROM s0.g", *[f"JOIN t{i}p AS t{i}p ON t{i}p.r = t0.r // {16**i}" for i in range(4)], "CROSS JOIN t4"]
    steps = [*[f"s{i}p" for i in range(6)], *[f"t{i}p" for i in range(4)]]
    chain = f"f AS (SELECT s0.doc_id, s0.h AS leaf, s0.claimed, t0.h AS subroot, t4.h AS root, {', '.join(f'{s}.m AS m{i}, {s}.a AS a{i}, {s}.b AS b{i}' for i, s in enumerate(steps))} FROM s0 {' '.join(joins)})"
    out.append(chain)
    for i in range(len(steps)):
        out.append(f"f{i} AS (SELECT * EXCLUDE (claimed), CASE WHEN m{i} = 1 THEN claimed ELSE sha256(a{i} || claimed || b{i}) END AS claimed FROM {'f' if not i else f'f{i - 1}'})")
    every = " || ".join(f"a{i} || b{i}" for i in range(len(steps)))
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256({every}) AS proof_sha256, claimed AS folded_root, claimed = root AS verified FROM f{len(steps) - 1}"


OP11_SQL = _sql()
