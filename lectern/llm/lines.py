"""Line dedup by a suffix array over line-ID sequences, in DataFrame functions only.

Every line is an id, every document a sequence of ids, every place in it a suffix.  Prefix doubling names the
suffixes by their first 1, 2, 4, ... lines: the name at depth 2h is the rank of the pair (name of the suffix,
name of the suffix h lines on) among all such pairs in sorted order, equal pairs sharing one rank.  Suffixes that share a name at depth d
are an interval of the suffix array whose common prefix is d lines or more.  A suffix whose pair is
unique is settled and leaves; the rounds end when none is left, so they follow the repeated runs and not the corpus.

In each interval the first suffix in the order of (doc_id, line) is the source of the others.  How far a suffix has an earlier copy, its
longest common prefix with any suffix before it, lies between two depths; it is found by descent: each interval is split by the
names of half the lines further on, then of a quarter and so on, down to one line, and a suffix that is still not the first has so many lines more.
Of these repeated runs those that lie in another are dropped, and the maximal ones left are deleted.  With ``min_words``
a single line of so many words is a run too, if it has an earlier copy.

A line's id is a pair of 64-bit hashes, so that distinct lines of the largest corpora stay distinct; names are ranks and exact.
A suffix is its place, one number that rises with (doc_id, line) and goes on by one from line to line; the number after a document's last line is nobody's,
so what is looked up so many lines further on is never of another document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import FEW_ROWS, checkpointed, fresh, hot_joined, loop_tables, read, text_key

MIN_LINES = 2
#: A repeated line of fewer words, alone, is a heading or a phrase of its own kind and stays.
MIN_WORDS = 10
WORD = r"[^\x20\x09-\x0D]"
_PLACE = ("doc_id", "tkey", "i")
_DOC = ("doc_id", "tkey")


def _has_words(n: int) -> str:
    """Pattern of lines with ``n`` words or more; it gives up or stops at the n-th."""
    gap = r"[\x20\x09-\x0D]"
    return rf"^{gap}*+{WORD}++(?:{gap}++{WORD}++){{{n - 1}}}"


def _suffixes(docs: DataFrame, id_col: str, text_col: str, min_words: int | None = None) -> DataFrame:
    """(place, end, doc_id, tkey, i, lines, alone, h1, h2): one row per line with a word, i its place among these, alone whether it is a run by itself.

    ``end`` is the place after the document's last line.  Places are given as the rows are worked out, so these have to be written once and read from there.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    alone = F.lit(False) if min_words is None else F.lit(True)
    told = lambda x: F.struct((alone & x.rlike(_has_words(min_words or 1))).alias("alone"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))
    seq = rows.select(*_DOC, F.transform(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)), told).alias("seq")).where(F.size("seq") > 0)
    seq = checkpointed(seq)
    # rows equal in id and text count once
    if not seq.groupBy(*_DOC).count().where("count > 1").isEmpty():
        seq = seq.dropDuplicates(list(_DOC))
    out = seq.orderBy(*_DOC).select(*_DOC, F.size("seq").alias("lines"), F.posexplode(F.concat("seq", F.array(F.lit(None)))).alias("i", "x"))
    out = out.withColumn("place", F.monotonically_increasing_id()).where("x is not null")
    return out.select("place", (F.col("place") - F.col("i") + F.col("lines")).alias("end"), *_PLACE, "lines", "x.*")


def _named(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int, int]:
    """(keys, name, n, first) of the ``keys`` that occur more than once in ``rows`` (keys, place), ranked in sorted order; the sum and the largest of n.

    ``n`` counts a key's places, ``first`` is the least of them.  The sort is by range over distinct keys; a rank rises with the key and need not be dense.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
    table = checkpointed(counted.orderBy(*keys).select(*keys, F.monotonically_increasing_id().alias("name"), "n", "first"))
    return table, *table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()


def suffix_names(suffixes: DataFrame, written) -> list[DataFrame]:
    """For the depths 1, 2, 4, ... the (place, name, first) of suffixes with so many lines that occur more than once; first is the first of the interval.

    Those of depth 1 have their end and alone too.
    """
    # Depth 1: lines that occur once are settled at once.
    ids = ["h1", "h2"]
    table, total, most = _named(suffixes, ids)
    out, depth = [written(hot_joined(suffixes.select("place", "end", "alone", *ids), table, ids, "n", total, most).select("place", "end", "alone", "name", "first"))], 1
    while total:
        # one whose continuation is settled or ends before is settled too
        live = out[-1]
        pairs = live.select("place", F.col("name").alias("a")).join(live.select((F.col("place") - depth).alias("place"), F.col("name").alias("b")), "place")
        pairs = written(pairs)
        table, total, most = _named(pairs, ["a", "b"])
        if total:
            out.append(written(hot_joined(pairs, table, ["a", "b"], "n", total, most).select("place", "name", "first")))
        depth *= 2
    return out


def _descended(names: list[DataFrame], written) -> DataFrame:
    """(place, length, first) of each suffix that has an earlier copy: the lines of the longest, and the first place of these lines.

    A row of the loop is a suffix that may share more than ``length`` lines with an earlier one, and less than twice the step more.  ``length`` and ``first``,
    the first place of these lines, are its interval.  Others of the interval are not looked at, but for the first: the first place of any more lines that a suffix shares
    either has no earlier copy of ``length`` lines, and is ``first``, or its longest one lies within the same bounds, and it is a row itself.
    """
    # a copy asks from its greatest depth on; first rises with the depth
    every = reduce(DataFrame.unionByName, [n.where("place > first").select("place", F.lit(1 << k).cast("long").alias("length"), "first") for k, n in enumerate(names)])
    asking = written(every.groupBy("place").agg(F.max("length").alias("length"), F.max("first").alias("first")))
    total, top = asking.count(), len(names) - 1
    rows = asking.where(F.col("length") == 1 << top)
    for k in range(top, 0, -1):
        step = 1 << (k - 1)
        firsts = rows.select(F.col("first").alias("place"), "length", "first").distinct()
        half = names[k - 1].select(F.col("place").alias("at"), F.col("name").alias("b"))
        ahead = rows.unionByName(firsts).withColumn("at", F.col("place") + F.col("length")).join(half, "at", "left").drop("at")
        ahead = written(ahead)
        parts = written(ahead.where("b is not null").groupBy("length", "first", "b").agg(F.count("*").alias("n"), F.min("place").alias("lead")))
        asks = ahead.where("place > first")
        most = 2 * total if 2 * total <= FEW_ROWS else parts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        told = hot_joined(asks.where("b is not null"), parts, ["length", "first", "b"], "n", total, most)
        more = F.col("place") > F.col("lead")
        told = told.select("place", F.when(more, F.col("length") + step).otherwise(F.col("length")).alias("length"), F.when(more, F.col("lead")).otherwise(F.col("first")).alias("first"))
        # those that share one line with an earlier suffix and no two have nothing to ask
        rows = written(told.unionByName(asks.where("b is null").drop("b")).unionByName(asking.where(F.col("length") == step)))
    return rows


def copied_suffixes(suffixes: DataFrame) -> DataFrame:
    """(doc_id, tkey, i, length, src_doc, src_tkey, src_i): each suffix that has an earlier copy of a line or more, with the exact length of the longest.

    src is the first place of these lines in the order of (doc_id, tkey, line).
    """
    with loop_tables(suffixes.sparkSession, keep=True) as written:
        suffixes = written(suffixes)
        found = _descended(suffix_names(suffixes, written), written)
        return checkpointed(_sources(found.join(suffixes.select("place", *_PLACE), "place"), suffixes, "src_i").select(*_PLACE, "length", "src_doc", "src_tkey", "src_i"))


def _sources(rows: DataFrame, suffixes: DataFrame, at: str) -> DataFrame:
    """``rows`` with src_doc, src_tkey and ``at``, the document and line of the place ``first``."""
    return rows.join(suffixes.select(F.col("place").alias("first"), F.col("doc_id").alias("src_doc"), F.col("tkey").alias("src_tkey"), F.col("i").alias(at)), "first")


def _maximal(docs: DataFrame, min_lines: int, id_col: str, text_col: str, min_words: int | None, sources: bool) -> DataFrame:
    """(doc_id, tkey, start, end) of ``repeated_runs``, and with ``sources`` its other columns."""
    with loop_tables(docs.sparkSession, keep=True) as written:
        suffixes = written(_suffixes(docs, id_col, text_col, min_words))
        names = suffix_names(suffixes, written)
        long = F.col("length") >= min_lines
        runs = _descended(names, written).join(names[0].select("place", "end", "alone"), "place").where(long | F.col("alone"))
        runs = runs.withColumnRenamed("end", "doc_end").withColumn("stop", F.col("place") + F.when(long, F.col("length")).otherwise(1))
        reach = F.max("stop").over(Window.partitionBy("doc_end").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
        runs = runs.withColumn("reach", reach).where("reach is null or stop > reach")
        runs = runs.join(suffixes.where("i = 0").select(F.col("end").alias("doc_end"), F.col("place").alias("doc_start"), *_DOC), "doc_end")
        out = [*_DOC, *[(F.col(c) - F.col("doc_start")).cast("int").alias(name) for c, name in (("place", "start"), ("stop", "end"))]]
        return checkpointed(_sources(runs, suffixes, "src_start").select(*out, "src_doc", "src_tkey", "src_start") if sources else runs.select(*out))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """(doc_id, tkey, start, end, src_doc, src_tkey, src_start): the maximal later copies of stretches of lines.

    Lines are counted from 0 over those with a word; ``end`` is exclusive.  A run is ``min_lines`` lines or more, or with ``min_words``
    a line of so many words.  All its lines stand in the same order from src_start on in src_doc, which is
    smaller, or before it in the same document; one line more has no earlier copy.  A run that lies in another of the document is left out; two may overlap.
    """
    return _maximal(docs, min_lines, id_col, text_col, min_words, sources=True)


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None, told: tuple[str, str, str] = ("_n_lines", "_n_removed", "_longest_run")) -> DataFrame:
    """``docs`` with the runs of ``repeated_runs`` deleted from its text, and three columns, named by ``told``, added.

    These are the number of lines, of deleted lines, and of lines in the longest run (0 if none).  Columns of these names
    in ``docs`` are replaced, all others stay, whatever they are called.  Lines are compared whole; lines without a word
    are passed over and stay.  Of equal lines that go, the first in the order of (doc_id, line) stays; where copies of a
    run overlap in one document (A A A), what stays is shorter than the run.  Null texts stay null and
    have 0 lines; rows with a null id lose nothing and take nothing.  Rows equal in id and text count as one and are all cut alike.
    """
    docs = docs.drop(*told)
    id_, key, runs, lines, filled, kept = fresh(docs, "_doc", "_tkey", "_runs", "_lines", "_filled", "_kept")
    found = _maximal(docs, min_lines, id_col, text_col, min_words, sources=False).groupBy(*_DOC).agg(F.collect_list(F.struct("start", "end")).alias(runs))
    text, at = F.col(text_col), F.col(runs)
    rows = docs.withColumns({id_: F.col(id_col), key: text_key(text)}).join(found.withColumnsRenamed({"doc_id": id_, "tkey": key}), [id_, key], "left").drop(id_, key)
    # Each step refers to the columns of the one before more than once, so that none is worked out again for each line.
    rows = rows.withColumn(lines, F.when(at.isNotNull(), F.split(text, "\n", -1)))
    rows = rows.withColumn(filled, F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull()))
    gone = F.flatten(F.transform(at, lambda r: F.sequence(r["start"], r["end"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(filled) - 1), gone)
    rows = rows.withColumn(kept, left)
    blank = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(filled))
    places = F.array_sort(F.concat(blank, F.transform(kept, lambda i: F.get(F.col(filled), i))))
    text_left = F.array_join(F.transform(places, lambda i: F.get(F.col(lines), i)), "\n")
    n = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    longest = F.array_max(F.transform(at, lambda r: r["end"] - r["start"]))
    out = {told[0]: n, told[1]: F.size(filled) - F.size(kept), told[2]: longest}
    rows = rows.withColumns({text_col: F.when(at.isNull(), text).otherwise(text_left)} | {c: F.when(at.isNull() & (c != told[0]), 0).otherwise(x).cast("long") for c, x in out.items()})
    return rows.drop(runs, lines, filled, kept)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Later copies of runs of MIN_LINES lines, or of one line of MIN_WORDS words, are deleted from the documents."""
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_words=MIN_WORDS)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_longest_run").alias("longest_run"), F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = rf"""
WITH l AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
f AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
s AS (SELECT doc_id, list(line ORDER BY i) AS ls FROM f GROUP BY doc_id),
q AS (SELECT doc_id, i, ls, regexp_matches(ls[i + 1], '^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+([\x20\x09-\x0D]+[^\x20\x09-\x0D]+){{{MIN_WORDS - 1}}}') AS alone FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM s)),
-- every suffix with every earlier one that starts with the same line: the lines that both go on with
p AS (SELECT a.doc_id, a.i, a.alone, a.ls[a.i + 1:] AS x, b.ls[b.i + 1:] AS y FROM q a JOIN q b ON a.ls[a.i + 1] = b.ls[b.i + 1] AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.i < a.i))),
z AS (SELECT doc_id, i, alone, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda k: x[k] = y[k]), false) - 1, least(len(x), len(y))) AS n FROM p),
g AS (SELECT doc_id, i, alone, max(n) AS n FROM z GROUP BY doc_id, i, alone),
r AS (SELECT doc_id, i AS a, i + CASE WHEN n >= {MIN_LINES} THEN n ELSE 1 END AS b FROM g WHERE n >= {MIN_LINES} OR alone),
c AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS i FROM r),
m AS (SELECT doc_id, max(b - a) AS longest FROM r GROUP BY doc_id),
x AS (SELECT l.doc_id, l.n, l.pos, l.line, c.i IS NOT NULL AS gone FROM l LEFT JOIN f USING (doc_id, pos) LEFT JOIN c ON c.doc_id = f.doc_id AND c.i = f.i)
SELECT x.doc_id, CAST(any_value(x.n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  CAST(coalesce(any_value(m.longest), 0) AS BIGINT) AS longest_run, sha256(coalesce(string_agg(x.line, chr(10) ORDER BY x.pos) FILTER (NOT gone), '')) AS kept_sha256
FROM x LEFT JOIN m USING (doc_id) GROUP BY x.doc_id
"""
