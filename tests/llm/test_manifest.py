"""Merkle manifests against a plain recursion, ranks against sorting."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(hashes):
    """(root, [siblings to the left and right by level] for each place)."""
    if len(hashes) == 1:
        return hashes[0], [[]]
    runs = [hashes[i : i + 16] for i in range(0, len(hashes), 16)]
    root, above = climbed([sha(*r) for r in runs])
    return root, [[("".join(r[:j]), "".join(r[j + 1 :])), *above[i]] for i, r in enumerate(runs) for j in range(len(r))]


def expected(rows):
    """Counter of the query's rows for (doc_id, source, lang, n_chars, text)."""
    by, out = {}, Counter()
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = climbed([leaf(*r) for r in by[s]])
    root, tops = climbed([trees[s][0] for s in order])
    for s, top in zip(order, tops, strict=True):
        for r, path in zip(by[s], trees[s][1], strict=True):
            d, _, lang, n, text = r
            hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
            low = None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            h = leaf(d, s, lang, n, low if hit else text)
            for a, b in (whole := path + top):
                h = sha(a, h, b)
            out[d, leaf(*r), trees[s][0], root, sha(*(a + b for a, b in whole)), h, h == root] += 1
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank int, g int, k int, p int, n int"


def compared(spark, tmp_path, rows):
    where = str(tmp_path / f"t{random.random()}")
    spark.createDataFrame([(*r, 1, 1, 1, 1, 1) for r in rows], SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    got = manifest.op11_merkle_manifest(spark, where).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == expected(rows)
    return got


@pytest.mark.parametrize("sizes", [(1,), (16,), (17,), (1, 2, 300), (1,) * 18])
def test_trees_of_all_sizes(spark, tmp_path, sizes):
    rows = [(i * 7 - 50, f"s{k}" if k else None, "en", i, f"Text {i}") for k, n in enumerate(sizes) for i in range(n)]
    got = compared(spark, tmp_path, rows)
    assert sizes == (1,) or {r.verified for r in got} >= {True}


def test_rows_of_all_kinds(spark, tmp_path, monkeypatch):
    """Nulls, empty and long texts, ids of all sizes, repeated ids and rows that fill a bucket, sources that begin alike or hold no letter."""
    monkeypatch.setattr(manifest, "BUCKET", 4)
    rng = random.Random(3)
    ids = [None, None, 0, -1, 2**63 - 1, -(2**63), 5, 5, 5] + [rng.randrange(10**6) for _ in range(40)]
    sources = [None, "", "s", "s ", "sé", "\U0001f600", "～", "https://example.com/a/very/long/one", "https://example.com/a/very/long/two"]
    rows = [(i, rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", "A", "é B"])) for i in ids]
    rows += [(9, "s", "en", 1, f"Text {j}") for j in range(30)] + [(10, "s", None, None, "the same row")] * 25 + [(11, None, None, None, "Long " * 40_000)]
    compared(spark, tmp_path, rows)


def test_ranks(spark, monkeypatch):
    """Crowded prefixes, dense and spread ids, each group by itself."""
    monkeypatch.setattr(manifest, "BUCKET", 8)
    rng = random.Random(5)
    rows = [(f"g{rng.randrange(3)}", v) for v in {*range(1000, 1400), *(rng.randrange(-(2**62), 2**62) for _ in range(200)), *(2**40 + rng.randrange(300) for _ in range(100))}]
    df = spark.createDataFrame(rows, "g string, v long").withColumn("k", manifest.id_key(F.col("v")))
    got = manifest.ranked(df, ["g"], "k").collect()
    want = {}
    for g in {g for g, _ in rows}:
        want |= {(g, v): i for i, v in enumerate(sorted(v for h, v in rows if h == g))}
    assert {(r.g, r.v): r["rank"] for r in got} == want and len(got) == len(rows)


def test_empty_table_and_text_ids(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert not manifest.manifest(df).collect()
    with pytest.raises(TypeError):
        manifest.manifest(df.withColumn("doc_id", F.lit("a")))


def test_proofs_hold_for_other_columns(spark):
    """The general form: any columns, a claim of one's own, paths as lists."""
    df = spark.createDataFrame([(i, "s", f"t{i}") for i in range(40)], "doc_id long, source string, text string")
    out = manifest.manifest(df, columns=("doc_id", "text"), claimed=F.when(F.col("doc_id") == 3, F.lit("forged"))).withColumn("found", manifest.folded(F.coalesce("claimed", "leaf"), F.col("path"))).collect()
    assert {r.doc_id for r in out if r.found != r.root} == {3} and [r["rank"] for r in sorted(out, key=lambda r: r.doc_id)] == list(range(40))
    assert all(r.leaf == leaf(r.doc_id, f"t{r.doc_id}") and len(r.path) == 2 for r in out)
