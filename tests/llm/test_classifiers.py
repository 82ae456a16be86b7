import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import licenses, pu_quality, toxicity

SF01 = "/root/testdata/sf0.1"


def held_out(spark, out, label):
    labels = spark.read.parquet(f"{SF01}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = out.where("held_out").join(labels, "doc_id").collect()
    y, s = np.array([r.y for r in rows]), np.array([r.score for r in rows])
    assert ((s >= 0) & (s <= 1)).all()
    order = np.argsort(np.argsort(s, kind="stable"))
    n1 = y.sum()
    auc = (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))
    return auc, np.mean([r.predicted == r.y for r in rows])


def test_quality_on_held_out_documents(spark):
    auc, accuracy = held_out(spark, pu_quality.op5_quality_classifier(spark, SF01), "quality")
    assert auc > 0.97 and accuracy > 0.97


def test_toxicity_on_held_out_documents(spark):
    auc, accuracy = held_out(spark, toxicity.op1_toxicity(spark, SF01), "toxic")
    assert auc > 0.9 and accuracy > 0.95


def test_subsequence_kernel_by_hand():
    def phi(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, len(w)):
                    if k - i < 5:
                        out[w[i], w[j], w[k]] = out.get((w[i], w[j], w[k]), 0) + toxicity.DECAY ** (k - i - 2)
        return out

    words = ["idiot", "idxiot", "banana", "abcabc", "scum"]
    units = toxicity.Units([" ".join(words)])
    spelt = [units.spelt(i) for i in range(len(units))]
    norm = lambda w: sum(max(len(w) - b, 0) * d * d for _, b, d in toxicity._PATTERNS) ** 0.5
    got = toxicity.kernel(spelt, spelt)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            pa, pb = phi(a), phi(b)
            assert got[i, j] == pytest.approx(sum(v * pb.get(k, 0) for k, v in pa.items()) / norm(a) / norm(b))


def test_disguised_insults_are_found():
    rng = np.random.default_rng(3)
    syllables = ["ba", "do", "ker", "mi", "tun", "sel", "fra", "po", "vi", "gan"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    insults = ["zorgquix", "whelkbutz"]
    texts, y = [], []
    for i in range(240):
        w = [word() for _ in range(60)]
        y.append(i % 3 == 0)
        if y[-1]:
            w[int(rng.integers(60))] = insults[i % 2]
        texts.append(" ".join(w))
    model = toxicity.fit(texts, np.array(y, int))
    plain = " ".join(word() for _ in range(50))
    for bad in ("zorgquix", "ZORGQUIX!", "zor.gquix", "z o r g q u i x", "zoxrgquix", "wh3lkbutz", "whelk-butz", "zorgquixes"):
        assert model.score([f"{plain} {bad} {plain}"])[0] > 0.5, bad
    assert (model.score([plain, "", "a b c", "漢字 " * 50]) < 0.5).all()
    assert model.score(["po " * 300_000 + "zorgquix " + "vi " * 200_000])[0] > model.score(["po " * 300_000 + "vi " * 200_000])[0]


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "x", 0.5), (3, "w " * 50_000, 0.5)], "doc_id long, text string, score double")
    model = toxicity.fit(["fine day here", "nice lunch there", "quiet road", "zorgquix you", "vile zorgquix", "zorgquix now"], np.array([0, 0, 0, 1, 1, 1]))
    for out in (toxicity.score(docs.drop("score"), model, ["doc_id"]), toxicity.score(docs, None, docs.columns, "s"), toxicity.score(docs.limit(0), model, docs.columns, "s")):
        assert out.count() in (0, 5)
    net, prior = pu_quality.fit(np.random.default_rng(0).normal(1, 1, (60, 16)), np.random.default_rng(1).normal(0, 1, (90, 16)))
    assert 0.05 <= prior <= 0.98
    assert pu_quality.score(docs.drop("score"), net, ["doc_id"]).count() == 5
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert pu_quality.train(docs, empty, F.lit(True))[0] is None and toxicity.train(docs, empty, F.lit(True)) is None


def test_class_prior_of_a_known_mixture():
    rng = np.random.default_rng(2)
    positive = rng.normal(1, 1, (3000, 16))
    unlabelled = np.concatenate([rng.normal(1, 1, (2100, 16)), rng.normal(-1, 1, (900, 16))])
    net, prior = pu_quality.fit(positive, unlabelled)
    assert abs(prior - 0.7) < 0.08
    assert np.mean(net.score(positive) > 0.5) > 0.95 and np.mean(net.score(unlabelled[2100:]) < 0.5) > 0.95


def test_licenses(spark):
    texts = {
        1: "Some prose here.\nReleased under the MIT License.\nMore prose.",
        2: "This work is licensed under the GNU General Public License, version 3.",
        3: "Licensed under the Apache License, Version 2.0.",
        4: "Licensed under CC BY-NC 4.0.",
        5: "You need a driving licence to rent a car. The license was revoked.",
        6: "Licensed under the Foobar Agreement of 1987.",
        7: None,
        8: "",
        9: "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        10: "word " * 30_000 + "\nReleased under the MIT License.",
        11: "It is the Apache who rode north. General public opinion was divided.",
    }
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id") + 1000, "text")
    rows = [(i, t) for i, t in texts.items()] + [(3, texts[3]), (None, texts[4])]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").union(base)).collect()
    got = {r.doc_id: r.license for r in out}
    assert {i: got[i] for i in texts} == {1: "mit", 2: "gpl", 3: "apache", 4: "cc_by_nc", 5: None, 6: None, 7: None, 8: None, 9: "mit", 10: "mit", 11: None}
    assert len(out) == len(rows) + 200 and got[None] == "cc_by_nc"
    truth = {r.doc_id: r.text for r in base.withColumnRenamed("(doc_id + 1000)", "doc_id").collect()}
    assert all((got[d] is not None) == ("icensed under" in t or "Released under" in t) for d, t in truth.items())
