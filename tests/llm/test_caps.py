"""Spherical-cap filters: decoding against all words, links and components against all pairs, recall at the threshold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import caps


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(rows, cosine=caps.THRESHOLD):
    """{place: (links, component)} of rows (vec_id, embedding, label) by comparing all pairs."""
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    def fine(e, label):
        return label is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)

    n = [0] * len(rows)
    for i, (_, e, a) in enumerate(rows):
        for j in range(i):
            _, g, b = rows[j]
            if a == b and fine(e, a) and fine(g, b) and len(e) == len(g):
                x, y = np.array(e, float), np.array(g, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    up[find(i)] = find(j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(least.get(find(i), v), v)
    return sorted(str((v, n[i], least.get(find(i)), v == least.get(find(i)))) for i, (v, _, _) in enumerate(rows))


def found(df):
    return sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in caps.near_duplicates(df).collect())


SCHEMA = "vec_id long, embedding array<double>, label int, pid int, w int, ball int, f int, n_links string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1, "x") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("n,dim", [(50, 16), (5000, 64), (10**9, 64), (10**7, 31)])
def test_all_words_over_the_bound_are_decoded(n, dim):
    bound, codes = caps.design(n, dim)
    assert caps.cap(bound, dim) == pytest.approx(min(0.05, caps.LOAD / n), rel=0.02)
    codes = [[b[:20] for b in books] for books in codes]
    x = unit(np.random.default_rng(1).normal(size=(60, dim)))
    bound = min(bound, 0.2)
    row, f = caps.decoded(x, bound, codes)
    want = set()
    for c, books in enumerate(codes):
        total, word = np.zeros((len(x), 1)), np.zeros(1, np.int64)
        for b in books:
            total = (total[:, :, None] + (x @ b.T)[:, None, :]).reshape(len(x), -1)
            word = (word[:, None] * len(b) + np.arange(len(b))).ravel()
        assert np.allclose([np.linalg.norm(sum(b[0] for b in books))], 1)
        want |= {(int(r), int(word[k]) + c * caps._CODE) for r, k in np.argwhere(total >= bound)}
    assert set(zip(row.tolist(), f.tolist(), strict=True)) == want and (np.diff(row) >= 0).all()


@pytest.mark.parametrize("n", [2000, 200_000])
def test_recall_at_the_threshold(n):
    """Pairs at exactly the threshold share a filter; pairs at 0.95 nearly always."""
    rng = np.random.default_rng(2)
    for cosine, least in ((0.93, 0.97), (0.95, 0.985)):
        x = unit(rng.normal(size=(600, 64)))
        z = rng.normal(size=x.shape)
        y = cosine * x + np.sqrt(1 - cosine**2) * unit(z - (z * x).sum(1, keepdims=True) * x)
        bound, codes = caps.design(n, 64)
        lists = [[set() for _ in x] for _ in range(2)]
        for held, v in zip(lists, (x, y), strict=True):
            for r, f in zip(*(a.tolist() for a in caps.decoded(v, bound, codes)), strict=True):
                held[r].add(f)
        assert np.mean([bool(a & b) for a, b in zip(*lists, strict=True)]) >= least


def clustered(rng, sizes, noise, dim=24):
    out = []
    for k, size in enumerate(sizes):
        centre = unit(rng.normal(size=(1, dim)))
        out += [(v * rng.uniform(0.5, 9)).tolist() for v in centre + noise[k % len(noise)] * unit(rng.normal(size=(size, dim)))]
    return out


@pytest.mark.parametrize("crowd", [caps.CROWD, 12])
def test_links_against_all_pairs(spark, monkeypatch, crowd):
    """Tight and loose clusters, chains, equal vectors; crowded filters with balls and pairs of parts give the same."""
    monkeypatch.setattr(caps, "CROWD", crowd)
    monkeypatch.setattr(caps, "EXPECTED", 40)
    rng = np.random.default_rng(3)
    vectors = clustered(rng, [60, 40, 25, 3, 2, 1, 1, 1], [0.1, 0.25, 0.35])
    rows = [(i, v, int(i % 7 == 0)) for i, v in enumerate(vectors)] + [(500 + i, vectors[0], 1) for i in range(5)]
    rows += [(600 + i, (np.cos(i / 4) * np.eye(24)[0] + np.sin(i / 4) * np.eye(24)[1]).tolist(), 3) for i in range(7)]
    assert found(table(spark, rows)) == brute(rows)


def test_rows_of_all_kinds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0] * 3, 1), (4, [1.0, None, 0.0], 1), (5, [1.0, nan], 1), (6, [inf, 1.0], 1), (7, [1.0, 2.0], None), (8, [1.0, 2.0], None)]
    rows += [(9, [1.0, 2.0], 1), (10, [1e300, 2e300], 1), (11, [1e-300, 2e-300], 1), (11, [1e-300, 2e-300], 1), (12, [1.0, 2.0, 0.0], 1), (13, [1.0, 2.0], 2), (14, [5.0], 1), (15, [0.1], 1), (16, [-0.1], 1)]
    rows += [(None, [1.0, 2.0], 1), (None, [7.0, -2.0], 4), (None, [7.0, -2.0], 4), (-3, [-0.0, 1.0], 5), (20, [0.0, 1.0], 5), (None, None, None)]
    assert found(table(spark, rows)) == brute(rows)
    assert not caps.near_duplicates(table(spark, rows).limit(0)).collect()
    floats = table(spark, [(1, [0.1, 0.7], 1), (2, [0.1, 0.7], 1)]).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert [(r.n_links, r.component_id) for r in caps.near_duplicates(floats).collect()] == [(1, 1), (1, 1)]


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert found(df) == brute(rows)
