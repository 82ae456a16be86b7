from collections import Counter

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_decontamination import grams
from test_single_lines import brute as brute_lines
from test_simhash import brute_components, brute_fingerprint


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    at = [docs]
    for _, stage in pipeline.STAGES:
        at.append(stage(spark, at[-1], sf).cache())
    assert all(df.columns == docs.columns and df.schema == docs.schema for df in at[:5])
    rows = [[(r.doc_id, r.text) for r in df.collect()] for df in at[:5]]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {d for d, _ in rows[0]} - {d for d, _ in rows[1]}
    known = [labels[d] for d in gone if d in labels]
    assert set(rows[1]) <= set(rows[0]) and gone and sum(known) > len(known) / 2
    assert Counter(rows[2]) == Counter(brute_lines(rows[1], 2, 10).items())
    roots = brute_components([(d, brute_fingerprint(t)) for d, t in rows[2]])
    assert sorted(d for d, _ in rows[3]) == sorted({c for c in roots.values()})
    sizes = [(min(5, len((r.text or "").split())), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items = [(grams(t, size), size) for size, t in sizes if size]
    clean = [(d, t) for d, t in rows[3] if not any(len(i & grams(t, size)) >= 0.8 * len(i) - 1e-9 for i, size in items)]
    assert sorted(rows[4]) == sorted(clean)
    assert {r.doc_id for r in at[5].collect()} == {d for d, _ in rows[4]}
    # which pieces share a sequence follows from how rows are dealt to tasks; the tokens of each document do not
    tokens = lambda df: {r.doc_id: (r.n, r.all) for r in df.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()}
    assert tokens(pipeline.run(spark, sf)) == tokens(at[5]) and all(n == whole for n, whole in tokens(at[5]).values())


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark):
    rows = [(5, "a b c d", "en"), (5, "a b c d", "en"), (7, "a b c d", "en"), (8, None, "en"), (9, "", "en"), (None, "q r s", "en"), (None, "q r s", "en")]
    out = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(5, "a b c d"), (8, None), (None, "q r s")]))
