import hashlib
import random

import pytest

from lectern.llm import substrings


def brute(rows, size):
    """{index of row: words left} by comparing the windows themselves."""
    texts = [(i, d, (t or "").encode().split()) for i, (d, t) in enumerate(rows)]
    least = {}
    for _, d, w in texts:
        if d is not None:
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                least[key] = min(least.get(key, d), d)
    out = []
    for _, d, w in texts:
        gone = set()
        if d is not None:
            for k in range(len(w) - size + 1):
                if least[tuple(w[k : k + size])] < d:
                    gone.update(range(k, k + size))
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def check(df, size=50):
    got = [tuple(r) for r in substrings.remove_repeats(df, window=size).collect()]
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], size)
    assert sorted(map(str, got)) == sorted(map(str, want))
    return got


@pytest.mark.parametrize("table", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, table):
    got = check(spark.read.parquet(f"{table}/documents.parquet"))
    assert any(r[2] for r in got)


def test_small_windows_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_WINDOWS", 40)
    rng = random.Random(3)
    rows = [(rng.randrange(60), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))) for _ in range(120)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=5)


def test_edges(spark):
    long = " ".join(f"w{i % 211}" for i in range(20_000))
    rows = [(1, None, 0), (2, "", 0), (3, "a b c", 0), (3, "a b c", 0), (4, "x a b c y", 0), (None, "a b c", 0), (5, long, 0), (6, long + " end", 0), (-7, "A b c", 0)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, spans int"), size=3)
    assert (4, 5, 3, "x y") in got
    assert not substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect()


def test_query(spark, sf):
    got = {r.doc_id: r.kept_sha256 for r in substrings.op8_substring_dedup(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, _, _, t in brute(rows, 50)}
