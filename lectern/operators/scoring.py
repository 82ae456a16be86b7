"""Scores of takes against their reference text: tokens, word and character errors, repetition, truncation, penalties."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import spell_below_thousand

# Fillers, weights of errors and penalties, rate of speech.
FILLERS = ["uh", "um", "erm", "mm", "hmm", "ah", "eh", "er"]
SUBSTITUTION, DELETION, INSERTION = 1.0, 1.5, 1.25
CER_WEIGHT, REPETITION_WEIGHT, TRUNCATION_WEIGHT = 0.25, 0.4, 0.3
DURATION_WEIGHT, DURATION_SLACK, SPEAKER_WEIGHT = 0.5, 0.35, 0.5
CHARS_PER_SECOND, LEAST_SECONDS = 13.0, 0.5
GRAM, REPEATS, TAIL = 3, 3, 4
_ERRORS = ["substitutions", "deletions", "insertions", "hits", "reference_length"]


def spell_integer(n: Column) -> Column:
    """0 to 999 999 999 999 in words."""
    parts = []
    for size, name in ((10**9, "billion"), (10**6, "million"), (10**3, "thousand")):
        group = (F.floor(n / size) % 1000).cast("int")
        parts.append(F.when(group > 0, F.concat(spell_below_thousand(group), F.lit(f" {name}"))))
    low = (n % 1000).cast("int")
    parts.append(F.when((low > 0) | (n == 0), spell_below_thousand(low)))
    return F.concat_ws(" ", *parts)


def expand_numbers(c: Column) -> Column:
    """Digits, commas aside, in words."""
    pieces = F.split(c, r"(?<![\d,])(?=\d)|(?<=[\d,])(?![\d,])", -1)

    def spelt(x: Column) -> Column:
        n = F.replace(x, F.lit(","), F.lit("")).try_cast("bigint")
        return F.when(x.rlike(r"\A\d[\d,]*\z") & n.isNotNull(), spell_integer(n)).otherwise(x)

    return F.array_join(F.transform(pieces, spelt), "")


def score_tokens(text: Column) -> Column:
    """The words that count, alike for references and transcripts."""
    t = F.coalesce(text, F.lit(""))
    for pattern in (r"(?Uiu)\[\s*S\d+\s*\]", r"\([^)]*\)", r"\[[^\]]*\]"):
        t = F.regexp_replace(t, pattern, " ")
    t = F.replace(expand_numbers(F.lower(t)), F.lit("-"), F.lit(" "))
    t = F.regexp_replace(t, r"(?U)[^\w\s']", " ")
    return F.filter(F.split(F.regexp_replace(t, r"(?U)\s+", " "), " "), lambda w: (w != "") & ~w.isin(*FILLERS))


#: Cells of a band that are kept for the way back; longer tables are filled with counts instead.
BAND_CELLS = 20_000_000


def _band(a, b, k: int):
    """Costs of the cells within ``k`` of the main diagonal, one row a word of ``a``: column c of row i is for i - k + c words of ``b``.

    Costs up to ``k`` are exact, as no path that leaves the band has one; others are too high or exact.
    """
    import numpy as np

    n, m, wide = len(a), len(b), 2 * k + 1
    far = np.int32(n + m + 1)
    rows = np.full((n + 1, wide), far, np.int32)
    at = np.arange(wide, dtype=np.int32)
    rows[0, k : k + m + 1] = np.arange(min(m, k) + 1)
    padded = np.full(m + wide + k + 1, -1, np.int64)  # word j of b stands at j + k
    padded[k : k + m] = b
    for i in range(1, n + 1):
        before, row = rows[i - 1], rows[i]
        lo, hi = max(0, k - i), min(wide, m - i + k + 1)  # columns that are cells of the table
        if lo >= hi:
            continue
        row[lo:hi] = before[lo:hi] + (padded[i - 1 + lo : i - 1 + hi] != a[i - 1])  # word j - 1 of b, j = i - k + c
        upto = min(hi, wide - 1)
        np.minimum(row[lo:upto], before[lo + 1 : upto + 1] + 1, out=row[lo:upto])
        if i <= k:
            row[k - i] = i
        row[lo:hi] = np.minimum.accumulate(row[lo:hi] - at[lo:hi]) + at[lo:hi]
    return rows


def _way_back(a, b, rows, k: int) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) by the costs of a band: equal words align, else a substitution goes before a deletion, a deletion before an insertion."""
    i, j, s, d = len(a), len(b), 0, 0
    far = len(a) + len(b) + 1
    cost = lambda i, j: int(rows[i, j - i + k]) if -k <= j - i <= k else far
    inserted = 0
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            continue
        diag, left, up = cost(i - 1, j - 1), cost(i - 1, j), cost(i, j - 1)
        best = min(diag, left, up)
        if diag == best:
            i, j, s = i - 1, j - 1, s + 1
        elif left == best:
            i, d = i - 1, d + 1
        else:
            j, inserted = j - 1, inserted + 1
    return s, d + i, inserted + j


def _counted(a, b) -> tuple[int, int, int]:
    """As ``_way_back`` from the whole table, of which three anti-diagonals are kept, each cell with the counts that led to it."""
    import numpy as np

    deletion, substitution = 1 << 21, 1 << 42  # a cell's counts share one integer
    n, m, back = len(a), len(b), b[::-1]
    cost = [np.zeros(n + 1, np.int64) for _ in range(3)]  # of this diagonal and the two before, by reference word
    counts = [np.zeros(n + 1, np.int64) for _ in range(3)]
    for t in range(1, n + m + 1):
        cost, counts = [cost[2], *cost[:2]], [counts[2], *counts[:2]]
        if t <= m:
            cost[0][0], counts[0][0] = t, t
        if t <= n:
            cost[0][t], counts[0][t] = t, t * deletion
        lo, hi = max(1, t - m), min(n, t - 1)
        if lo > hi:
            continue
        diag, left, up = cost[2][lo - 1 : hi], cost[1][lo - 1 : hi], cost[1][lo : hi + 1]
        same = a[lo - 1 : hi] == back[m - t + lo : m - t + hi + 1]
        best = np.minimum(np.minimum(diag, left), up)
        before = counts[2][lo - 1 : hi]
        edit = np.where(diag == best, before + substitution, np.where(left == best, counts[1][lo - 1 : hi] + deletion, counts[1][lo : hi + 1] + 1))
        cost[0][lo : hi + 1] = np.where(same, diag, best + 1)
        counts[0][lo : hi + 1] = np.where(same, before, edit)
    end = int(counts[0][n])
    return end >> 42, end >> 21 & deletion - 1, end & deletion - 1


def edit_script(a, b) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) that turn one array of word numbers into another.

    The band around the main diagonal grows fourfold until the distance lies in it, so time follows the length times the distance.  All cells on the way back have costs
    within the band and see their equals there, so ties fall as in the whole table.
    """
    n, m = len(a), len(b)
    k = max(16, abs(n - m))
    while (n + 1) * (2 * k + 1) <= BAND_CELLS:
        k = min(k, max(n, m, 1))
        rows = _band(a, b, k)
        if rows[n, m - n + k] <= k or k >= max(n, m):
            return _way_back(a.tolist(), b.tolist(), rows, k)
        k *= 4
    return _counted(a, b)


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in _ERRORS]))
def word_errors(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """struct<substitutions,deletions,insertions,hits,reference_length> of the least edit script; null if either is.

    Equal words align; of equal costs a substitution goes before a deletion, a deletion before an insertion.
    """
    import numpy as np

    def work(r, h):
        if r is None or h is None:
            return (None,) * 5
        ids: dict = {}
        a, b = (np.array([ids.setdefault(w, len(ids)) for w in x], np.int64) for x in (r, h))
        s, d, i = edit_script(a, b)
        return s, d, i, len(a) - s - d, len(a)

    return pd.DataFrame([work(r, h) for r, h in zip(ref, hyp, strict=True)], columns=_ERRORS).astype("Int32")


def weighted_rate(e: Column) -> Column:
    n = e["reference_length"]
    weighted = (e["substitutions"] * SUBSTITUTION + e["deletions"] * DELETION + e["insertions"] * INSERTION) / n
    return F.when(n > 0, weighted).when(e["insertions"] > 0, 1.0).otherwise(0.0)


def edits(a: str | None, b: str | None) -> int | None:
    """Edits between two texts: the table a column a character of ``b``, the steps down each column as the bits of two whole numbers (Myers 1999)."""
    if a is None or b is None:
        return None
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last, cost = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for c in b:
        same = at.get(c, 0)
        level = (((same & up) + up) ^ up) | same
        rise, fall = down | full & ~(level | up), up & level
        cost += bool(rise & last) - bool(fall & last)
        rise = (rise << 1 | 1) & full
        up, down = (fall << 1) & full | full & ~(same | down | rise), rise & (same | down)
    return cost


# a hundred texts at a time: what a worker holds doesn't grow with the partition
_edits = F.udf(edits, T.IntegerType(), useArrow=False)

#: Distances that are tried first where texts are so long (BAND_PAYS times the bound): a comparison up to a bound takes time by length times bound.
BOUNDS, BAND_PAYS = (16, 128, 1024, 8192), 1000


def distance(a: Column, b: Column) -> Column:
    """Edits between two texts, by bands that grow where the texts are long, else or where it lies in none by the whole table, a column at a time."""
    near = F.coalesce(*[F.when(F.length(a) > BAND_PAYS * k, F.nullif(F.levenshtein(a, b, k), F.lit(-1))) for k in BOUNDS])
    return F.coalesce(near, _edits(F.when(near.isNull(), a), b))


def character_error(ref: Column, hyp: Column) -> Column:
    a, b = F.array_join(ref, " "), F.array_join(hyp, " ")
    return F.when(F.length(a) > 0, distance(a, b) / F.length(a)).when(F.length(b) > 0, 1.0).otherwise(0.0)


def repetition_score(tokens: Column) -> Column:
    """How much the longest run of one three-word phrase exceeds what is normal.

    A phrase equals the one three words before it if three words in a row do; then its run is one longer than that one's.  The
    fold keeps how many words in a row did and the runs of the last three places only.
    """
    n = F.size(tokens)
    later = F.slice(tokens, GRAM + 1, F.greatest(n - GRAM, F.lit(0)))
    same = F.zip_with(F.slice(tokens, 1, F.greatest(n - GRAM, F.lit(0))), later, lambda a, b: a == b)

    def step(s: Column, equal: Column) -> Column:
        row = F.when(equal, s["row"] + 1).otherwise(0)
        run = F.when(row >= GRAM, s["a"] + 1).otherwise(1)
        return F.struct(row.alias("row"), s["b"].alias("a"), s["c"].alias("b"), run.alias("c"), F.greatest(s["worst"], run).alias("worst"))

    start = F.struct(F.lit(0).alias("row"), *[F.lit(1).alias(c) for c in "abc"], F.lit(1).alias("worst"))
    worst = F.aggregate(same, start, step, lambda s: s["worst"])
    return F.when((n >= GRAM * REPEATS) & (worst >= REPEATS), (worst - REPEATS + 1) / F.lit(float(REPEATS))).otherwise(0.0)


def truncation_score(ref: Column, hyp: Column) -> Column:
    """Share of the reference's last words that the end of the transcript lacks."""
    end = F.slice(ref, F.greatest(F.size(ref) - TAIL + 1, F.lit(1)), TAIL)
    near = F.slice(hyp, F.greatest(F.size(hyp) - 3 * TAIL + 1, F.lit(1)), 3 * TAIL)
    missing = F.size(F.filter(end, lambda w: ~F.array_contains(near, w)))
    return F.when((F.size(ref) >= TAIL) & (F.size(hyp) > 0), missing / F.lit(float(TAIL))).otherwise(0.0)


def duration_penalty(text: Column, duration: Column) -> Column:
    expected = F.greatest(F.length(text) / CHARS_PER_SECOND, F.lit(LEAST_SECONDS))
    off = F.abs(duration - expected) / expected
    return F.when(off > DURATION_SLACK, DURATION_WEIGHT * (off - DURATION_SLACK)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def with_reference(rows: DataFrame, references: DataFrame, key: str, hot: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``references``, which has one row a key.

    Keys that hold over one in ``hot`` of all rows, fewer than ``hot`` of them, are joined where their rows are; the rest by shuffle.
    """
    counted = rows.groupBy(key).agg(F.count("*").alias("n_key"))
    often = counted.join(counted.agg(F.sum("n_key").alias("n_all")), F.lit(True)).where(F.col("n_key") * hot > F.col("n_all")).select(key)
    near = F.broadcast(references.join(often, key))
    far = rows.join(F.broadcast(often), key, "left_anti").join(references, key)
    return rows.join(near, key).unionByName(far)


def speaker_penalty(similarity: Column) -> Column:
    """``similarity`` from 0 to 1, null where there was nothing to compare."""
    return F.coalesce(SPEAKER_WEIGHT * F.greatest(F.lit(0.0), 1 - similarity), F.lit(0.0))
