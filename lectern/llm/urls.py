"""URL filters as a sort-merge range join.

A host reads backwards as a key (``a.example.com`` becomes ``com.example.a.``), so a rule for a host and all its
subdomains covers one interval of keys.  Intervals of two rules nest or are disjoint.  Urls and rules are cut at the
same boundaries and sorted by key and path; one sweep over a part keeps the hosts whose intervals are open on a stack.
A host's own rules are intervals too, of paths: sorted, each knows the shorter rule that encloses it, so the longest
one that fits a path is found from its place among them and not by trying all.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import read, shuffle_partitions

#: Keys looked at for each boundary between parts; the driver sees so many for each part, and a part has about ROWS_PER_PART urls.
KEYS_PER_PART = 16
ROWS_PER_PART = 1_000_000


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels of a host in reverse order, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _after(key: Column) -> Column:
    """The least key after all keys that start with ``key``: its final dot becomes the next character."""
    return F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))


class PathRules:
    """The rules of one host, added in the order of their paths (code points); a rule's interval lies in that of the rule before it or of one that encloses that."""

    def __init__(self, host: str) -> None:
        self.host, self.paths, self.verdicts, self.around = host, [], [], []

    def add(self, path: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:
            self.verdicts[-1] = "block" if "block" in (verdict, self.verdicts[-1]) else max(verdict, self.verdicts[-1])
            return
        above = len(self.paths) - 1
        while above >= 0 and not path.startswith(self.paths[above]):
            above = self.around[above]
        self.paths.append(path)
        self.verdicts.append(verdict)
        self.around.append(above)

    def longest(self, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest path that ``path`` starts with."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.around[at]
        return None if at < 0 else (self.host + self.paths[at], self.verdicts[at])


def match_rules(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``urls``.

    ``rules``: host, path, verdict.  A rule fits its host and all subdomains if the url's path starts with the
    rule's.  The rule of the longest host wins, then that of the longest path, then ``block`` over ``allow``.
    Without a rule, rule is null and verdict ``default``.  Null urls and urls without :// have an empty host and path;
    only a rule for the empty host fits them.  A rule's host is lower-cased; null fields of a rule read as empty.
    """
    spark = urls.sparkSession
    rows = urls.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rows = rows.withColumns({"key": host_key(F.col("host")), "salt": F.xxhash64("path", "id")})
    lower = F.lower(F.coalesce("host", F.lit("")))
    cover = rules.select(lower.alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("verdict", F.lit(default)).alias("verdict")).distinct().withColumn("key", host_key(F.col("host")))

    # Boundaries come from a sample, of a fixed number of keys a part; they decide where rows are judged, never how.
    # The salt cuts the rows of one hot host into several parts.
    total = rows.count()
    n = max(2, shuffle_partitions(spark), total // ROWS_PER_PART)
    share = min(1.0, n * KEYS_PER_PART / max(total, 1))
    least = -(2**63)
    some = rows.where(F.xxhash64("id", "salt") <= F.lit(int(least + share * (2**64 - 1025))))
    sample = sorted((r.key, r.salt) for r in some.select("key", "salt").collect())
    step = max(1, len(sample) // n)
    bounds = sorted(set(sample[step::step]))

    def part_of(keys: pd.Series, salts: pd.Series | None = None) -> np.ndarray:
        return np.array([bisect_right(bounds, x) for x in zip(keys, salts if salts is not None else [least] * len(keys), strict=True)], np.int32)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(part=part_of(pdf["key"], pdf["salt"]))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A rule goes to every part that its interval meets; at a boundary that is one chain of nested rules."""
        for pdf in batches:
            lo, hi = part_of(pdf["key"]), part_of(pdf["after"])
            times = hi - lo + 1
            out = pdf.drop(columns="after").loc[pdf.index.repeat(times)]
            yield out.assign(part=np.repeat(lo, times) + np.concatenate([np.arange(t) for t in times]).astype(np.int32))

    cast_id = rows.schema["id"].dataType.simpleString()
    pages = rows.mapInPandas(placed, f"id {cast_id}, host string, path string, key string, salt long, part int")
    sent = cover.withColumn("after", _after(F.col("key"))).mapInPandas(spread, "host string, path string, verdict string, key string, part int")
    events = sent.select("part", "key", F.lit(0).alias("kind"), F.lit(None).cast(cast_id).alias("id"), "host", "path", "verdict").unionByName(
        pages.select("part", "key", F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    )

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, stack = None, []  # of (key, the host's rules)
        for pdf in batches:
            hit, verdicts = [], []
            for at, key, kind, path_, verdict, host_ in zip(pdf["part"], pdf["key"], pdf["kind"], pdf["path"], pdf["verdict"], pdf["host"], strict=True):
                if at != part:
                    part, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                found = (None, default)
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, PathRules(host_)))
                    stack[-1][1].add(path_, verdict)
                else:
                    for _, rules_ in reversed(stack):
                        if (rule := rules_.longest(path_)) is not None:
                            found = rule
                            break
                hit.append(found[0])
                verdicts.append(found[1])
            out = pd.DataFrame({"id": pdf["id"], "host": pdf["host"], "path": pdf["path"], "rule": hit, "verdict": verdicts})
            yield out[pdf["kind"] == 1]

    swept = events.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "key", "kind", "path")
    return swept.mapInPandas(sweep, f"id {cast_id}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


#: The rules of the query: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(h, p, v) for v, h, p in RULES], "host string, path string, verdict string")
    return match_rules(read(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP2_SQL = """
WITH rules(host, path, verdict) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in RULES) + """),
u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
m AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.host) DESC, length(r.path) DESC) AS rn
  FROM u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE rn = 1
"""
