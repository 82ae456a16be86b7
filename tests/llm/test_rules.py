from collections import Counter

import duckdb

from lectern.llm import rules


def brute(text):
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    ls = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(covered)


def test_measurements(spark):
    texts = [None, "", " \n\t", "a " * 30, "x y z " * 5, "é ü\n\n #$%\n #$%\né ü", "😀 a\nb\n😀 a", " ".join(f"w{i}" for i in range(40)) * 2, ("p q r s t u v w " * 3) + "z", " ".join(f"w{i % 5000}" for i in range(20_000))]
    df = spark.createDataFrame([(i // 2 if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.ledger(df).collect()]
    assert sorted(map(str, got)) == sorted(str((i // 2 if i else None, *brute(t))) for i, t in enumerate(texts))
    assert not rules.ledger(df.limit(0)).collect()


def test_policies_and_ablations(spark, sf):
    led = rules.ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    bits = [r.fail_bits for r in led.collect()]
    for version in rules.POLICIES:
        m = rules.mask(version)
        assert led.where(rules.passes(version)).count() == sum(not b & m for b in bits)
        for r in rules.ablations(led, version).collect():
            assert r.n_failed == sum(bool(b & r.bit) for b in bits)
            assert r.n_failed_alone == sum(b & m == r.bit for b in bits)
            assert r.n_kept_without == sum(not b & m & ~r.bit for b in bits)


def test_query_against_sql(spark, sf):
    out = rules.op4_quality_rules(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, con.execute(f"SELECT {', '.join(out.columns)} FROM ({rules.OP4_SQL})").fetchall()))
