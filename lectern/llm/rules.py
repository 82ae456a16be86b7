"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document; the ledger holds the measurements and one failure bit a rule.  Policies
are versioned sets of rules, so a policy is applied, compared or ablated by bitwise operations on the ledger alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD_GAP, read, words

SPAN = 8
#: Name of each rule and the condition that fails a document, in the order of their bits.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "stutter": "10 * n_stutter > 3 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 25 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_words")
#: Version of a policy and the rules that it applies.
POLICIES = {1: BASE, 2: (*BASE, "symbols"), 3: tuple(RULES)}
CURRENT = 3


def mask(policy: int = CURRENT) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of every row of ``docs``; null texts measure as empty ones.

    Windows of ``SPAN`` words are compared by 64-bit hashes within their document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), words(text).alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.regexp_replace(x, WORD_GAP, "")) > 0)
    df = df.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("l"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    # hashes of all windows, in order
    starts = F.slice("h", 1, F.greatest(F.size("h") - (SPAN - 1), F.lit(0)))
    window = F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(F.col("h"), i + k) for k in range(1, SPAN)]))
    stutter = F.size(F.filter("h", lambda x, i: (i > 0) & (x == F.get(F.col("h"), i - 1))))
    df = df.select("doc_id", "n_words", "word_chars", "n_symbols", F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), stutter.cast("long").alias("n_stutter"), window.alias("v"))
    # only documents with an equal pair of windows sort theirs; equal hashes then stand side by side
    pairs = F.when(F.size(F.array_distinct("v")) < F.size("v"), F.sort_array(F.transform("v", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.withColumn("s", pairs).drop("v")
    same = lambda x, i, k: F.coalesce(F.get(F.col("s"), i + k)["h"] == x["h"], F.lit(False))
    hits = F.sort_array(F.transform(F.filter("s", lambda x, i: ((i > 0) & same(x, i, -1)) | same(x, i, 1)), lambda x: x["i"]))
    covered = F.aggregate(
        hits,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-SPAN).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(SPAN), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", covered).drop("s")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of every row of ``docs`` and fail_bits (long): bit i is set if rule i fails.

    Every row of the input has a row, repeated ids and null ids too; texts without words fail the rule on few words.
    """
    bits = " | ".join(f"(case when {cond} then {BIT[name]}L else 0L end)" for name, cond in RULES.items())
    return measurements(docs, id_col, text_col).withColumn("fail_bits", F.expr(bits))


def passes(policy: int = CURRENT, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(ledger: DataFrame, policy: int = CURRENT) -> DataFrame:
    """For each rule of a policy: rule, bit, n_failed, n_failed_alone (documents that only this rule drops), n_kept_without.

    One pass over the ledger's bits; the documents are not read again.
    """
    at = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    patterns = ledger.groupBy(at.alias("bits")).agg(F.count("*").alias("n"))
    rules = ledger.sparkSession.createDataFrame([(r, BIT[r]) for r in POLICIES[policy]], "rule string, bit long")
    both = rules.join(patterns, F.lit(True), "left")  # a row a rule and pattern, 2^rules at most
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return both.groupBy("rule", "bit").agg(total(hit).alias("n_failed"), total(hit & (rest == 0)).alias("n_failed_alone"), total(rest == 0).alias("n_kept_without"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = ledger(read(spark, sf_dir, "documents"))
    base = F.col("fail_bits").bitwiseAND(F.lit(sum(BIT[r] for r in BASE)).cast("long")) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes().alias("kept"), "fail_bits")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM v) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
  FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, """ + " | ".join(f"(CASE WHEN {cond} THEN {BIT[name]} ELSE 0 END)" for name, cond in RULES.items()) + f""" AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
  fail_bits & {mask()} = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits
FROM b
"""
