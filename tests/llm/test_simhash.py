import random

import numpy as np
import pytest
import xxhash

from lectern.llm import simhash
from lectern.llm.components import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """{(doc_id, fp): smallest doc_id reachable} by comparing all fingerprints."""
    fps = sorted({fp for _, fp in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    arr = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr ^ np.uint64(f)) <= 3).tolist():
            up[find(f)] = find(fps[j])
    least = {}
    for d, f in rows:
        if d is not None:
            r = find(f)
            least[r] = min(least.get(r, d), d)
    return {(d, f): least.get(find(f)) for d, f in rows}


def check(df):
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()]
    texts = [(r.doc_id, brute_fingerprint(r.text)) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(str, texts)) == sorted(map(str, [g[:2] for g in got]))
    want = brute_components(texts)
    assert all(want[d, f] == c for d, f, c in got)
    return got


@pytest.mark.parametrize("table", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, table):
    check(spark.read.parquet(f"{table}/documents.parquet"))


def test_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, 9), (2, "", 9), (3, " \t\n", 9), (4, "One", 1), (5, "one", 1), (6, "a B", 1), (7, "a b c", 1), (8, long, 1), (8, long, 1), (9, long + " x", 1), (None, "a b c", 1), (10, "é É", 1)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, component_id int"))
    assert {c for d, _, c in got if d in (1, 2, 3)} == {1}
    assert {c for d, _, c in got if d in (8, 9)} == {8}
    assert not simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect()


def test_links_keep_every_link_in_dense_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "OWNERS", 16)  # hot anchors are split
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for c in [rng.getrandbits(64) for _ in range(4)]:
        for _ in range(250):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps = sorted(fps)
    signed = [int(np.array([f], np.uint64).view(np.int64)[0]) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all(bin((e.a ^ e.b) & (2**64 - 1)).count("1") <= 3 for e in edges)
    want = brute_components(list(zip(signed, fps, strict=True)))
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame([(e.a, e.b) for e in edges], "u long, v long")).collect()}
    assert {d: roots.get(d, d) for d in signed} == {d: c for (d, _), c in want.items()}


def test_anchors_cover():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for bits in (0, 1, 2, 3):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, bits, replace=False).tolist():
                y[i] ^= np.uint64(1) << np.uint64(b)
        for a, b in zip(x, y, strict=True):
            ka, _, own = simhash.anchor_rows(np.array([a]))
            kb, _, _ = simhash.anchor_rows(np.array([b]))
            assert set(ka[own].tolist()) & set(kb.tolist())


def test_components_on_a_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 700), (600, 500), (9, 9)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 600: 500, 700: 500}


def test_long_chain_settles(spark):
    n = 3000
    edges = spark.range(n).selectExpr("id as u", "id + 1 as v")
    got = connected_components(edges).collect()
    assert len(got) == n + 1 and {r.root for r in got} == {0}
