"""Every operator and stage with nulls in any column, empty and long texts, repeated rows, empty tables and columns of clashing names."""

from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, decontamination, licenses, lines, packing, pu_quality, rules, simhash, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, n_removed int, _d int, _k int, d int, k int, _doc int, tkey long, score double, part int, hash long, own struct<`a b`:int>"
CLASH = [0.5, 1, 1, 1, 1, 1, 1, 1, 0.5, 1, 1, (1,)]
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (6, LONG), (7, LONG + " end"), (None, None), (8, "x y z\n" * 40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if n % 2 else "en", None, None if t is None else len(t), *CLASH) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(2, 0, 1), (4, 1, 0), (5, 0, 0), (5, None, None), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, "b c d e f"), (1, "b c d e f"), (2, None), (3, ""), (None, "a b")], "item_id long, text string").coalesce(1).write.parquet(f"{where}/benchmark.parquet")
    return where


def keys(rows):
    return Counter((r.doc_id, r.text) for r in rows)


@pytest.mark.parametrize("stage", range(4))
def test_filtering_stages(spark, docs, folder, stage):
    name, work = pipeline.STAGES[stage]
    out = work(spark, docs, folder)
    assert out.columns == docs.columns and out.schema == docs.schema
    rows = out.collect()
    assert all(tuple(r)[5:] == tuple(CLASH[:-1]) + (r.own,) for r in rows)
    if name == "line dedup":
        assert len(rows) == len(TEXTS) and {r.text for r in rows if r.doc_id == 8} == {"x y z\n"}
    elif name == "near-duplicates":
        assert sorted(r.doc_id for r in rows) == [1, 4, 5, 6, 8]  # the two long texts are near-duplicates
    elif name == "decontamination":
        assert keys(rows) == keys([r for r in docs.collect() if r.text != "a b c d e f g"])
    none = work(spark, docs.limit(0), folder)
    assert none.columns == docs.columns and not none.collect()


def test_packing_stage(spark, docs, folder):
    rows = pipeline.STAGES[4][1](spark, docs, folder).collect()
    ends = Counter(r.doc_id for r in rows if r.start + r.length == r.doc_tokens)
    assert ends == Counter(d for d, _ in TEXTS)
    assert not pipeline.STAGES[4][1](spark, docs.limit(0), folder).collect()


def test_operators(spark, docs, folder):
    n = len(TEXTS)
    assert substrings.remove_repeats(docs, window=5).count() == n and rules.ledger(docs).count() == n and packing.pack(docs).where("start = 0").count() == n
    assert simhash.near_duplicates(docs).count() == n and licenses.scan(docs).count() == n
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model, _ = pu_quality.train(docs, labels, F.lit(True))
    scored = pu_quality.score(docs, model, docs.columns, "quality_score")
    assert scored.count() == n and scored.schema["own"] == docs.schema["own"]
    empty = docs.limit(0)
    for out in (licenses.scan(empty), pu_quality.score(empty, None, ["doc_id"]), rules.ledger(empty), substrings.remove_repeats(empty), toxicity.score(empty, None, ["doc_id"])):
        assert not out.collect()
    assert pu_quality.train(empty, labels, F.lit(True))[0] is None and toxicity.train(empty, labels, F.lit(True)) is None


def test_text_ids_are_refused_or_served(spark, folder):
    df = spark.createDataFrame([("a", "x\ny"), ("b", "x\ny")], "doc_id string, text string")
    assert sorted(r.text for r in lines.dedup_lines(df).collect()) == ["", "x\ny"]
    assert decontamination.decontaminate(df, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 2
    for work in (simhash.near_duplicates, substrings.remove_repeats, packing.pack):
        with pytest.raises(TypeError):
            work(df)


def test_samples_are_bounded_and_the_same(spark):
    ids = spark.range(50_000).withColumnRenamed("id", "doc_id").repartition(7)
    some = [r.doc_id for r in common.bounded_sample(ids, "doc_id", 100).collect()]
    assert len(some) == 100 and some == [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(100).collect()]
    assert common.bounded_sample(ids.limit(0), "doc_id", 100).count() == 0 and common.bounded_sample(ids.limit(3), "doc_id", 100).count() == 3


def test_hot_keys_join_as_others_do(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(i, 0 if i % 2 else i % 40) for i in range(200)], "i long, k long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("m"))
    got = sorted(map(tuple, common.hot_joined(rows, table, ["k"], "n", 200).select("i", "k", "n", "m").collect()))
    assert got == sorted(map(tuple, rows.join(table, "k").select("i", "k", "n", "m").collect())) and len(got) == 200


def test_windows_that_share_one_hash_stay_apart(monkeypatch):
    """With either hash a constant, the other still tells windows apart."""
    codes = np.random.default_rng(0).integers(0, 2**63, 3000, dtype=np.uint64)
    real = substrings.rolled
    for dead in (0, 1):
        monkeypatch.setattr(substrings, "rolled", lambda c, size, which, dead=dead: np.zeros(len(c) - size + 1, np.uint64) if which == dead else real(c, size, which))
        compared, place = substrings.window_hashes(codes, 50)
        assert len(set(zip(compared.tolist(), place.tolist(), strict=True))) == len(codes) - 49


def test_batches_follow_the_sorted_partition(spark):
    """Whatever order the rows come in, the result is the same."""
    text = [" ".join(f"v{(i * j) % 50}" for j in range(80)) for i in range(12)]
    rows = [(i, text[i % 9]) for i in range(24)]
    results = [sorted(map(tuple, substrings.remove_repeats(spark.createDataFrame(r, "doc_id long, text string").coalesce(1)).collect())) for r in (rows, rows[::-1])]
    assert results[0] == results[1] and any(r[2] for r in results[0])


def test_crowded_anchors_keep_their_links(spark, monkeypatch):
    """Fingerprints that share a half: quarters of the other half find their links, and crowded quarters are split."""
    monkeypatch.setattr(simhash, "OWNERS", 8)
    rng = np.random.default_rng(2)
    base = int(rng.integers(2**31)) << 32
    fps = sorted({base | int(x) for x in rng.integers(2**32, size=150)} | {base | (0xABCD0000 ^ sum(1 << int(b) for b in rng.choice(32, 3, replace=False))) for _ in range(150)})
    signed = [int(np.array([f], np.uint64).view(np.int64)[0]) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    up = {f: f for f in signed}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for e in edges:
        assert bin((e.a ^ e.b) & (2**64 - 1)).count("1") <= 3
        up[find(e.a)] = find(e.b)
    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= 3:
                assert find(signed[i]) == find(signed[j])


def test_classes_have_their_own_bounds(spark):
    """Long items keep few of a document's shingles; every class finds its items."""
    word = lambda k, i: f"c{k}w{i}"
    items = [(k, " ".join(word(k, i) for i in range(n))) for k, n in enumerate((5, 7, 12, 25, 60, 130, 300, 900))]
    wanted = spark.createDataFrame(items, "item_id long, text string")
    sketch = decontamination.sketches(wanted.select("item_id", F.col("item_id").alias("ikey"), common.words(F.col("text")).alias("w")))
    assert sorted(decontamination.bounds(sketch)) == [0, 1, 3, 4, 5, 6, 8, 9]
    docs = spark.createDataFrame([(k, f"before {t} behind") for k, t in items], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, wanted).collect()) == [(k, k) for k, _ in items]


@pytest.mark.parametrize("shift", [0, -4])
def test_slopes_of_the_risk(shift):
    """Against differences of the risk itself, with its last part above and below zero."""
    rng = np.random.default_rng(4)
    p, u, prior = rng.normal(1, 1, 40), rng.normal(shift, 1, 60), 0.4
    sigmoid = lambda g: 1 / (1 + np.exp(-g))
    rest = lambda gp, gu: sigmoid(gu).mean() - prior * sigmoid(gp).mean()
    risk = (lambda gp, gu: prior * sigmoid(-gp).mean() + rest(gp, gu)) if not shift else (lambda gp, gu: -rest(gp, gu))
    assert (rest(p, u) < 0) == bool(shift)
    sp, su = pu_quality.risk_slopes(sigmoid(p), sigmoid(u), prior)
    for i in range(40):
        step = np.eye(40)[i] * 1e-6
        assert (risk(p + step, u) - risk(p - step, u)) / 2e-6 == pytest.approx(sp[i], rel=1e-4)
        other = np.eye(60)[i] * 1e-6
        assert (risk(p, u + other) - risk(p, u - other)) / 2e-6 == pytest.approx(su[i], rel=1e-4)


def test_table_scores_are_kernel_sums():
    """A machine kept as weights by subsequence scores as its sum over landmarks does."""
    units = [toxicity.Units([w]).spelt(0) for w in ("idiot", "zorgquix", "banana", "whelk", "idxiot", "scum")]
    landmarks, alpha = units[:3], np.array([0.7, -1.2, 0.4])
    table = sum(a * toxicity._phi(z) for a, z in zip(alpha, landmarks, strict=True))
    assert toxicity._Spelt(units).scores(table) == pytest.approx(toxicity.kernel(units, landmarks) @ alpha)
