"""Words of paragraphs are taken once, and strange words rule a paragraph out only where its pairs would."""

from pyspark.sql import functions as F

from lectern.llm import licenses as L


def test_words_are_taken_in_the_generator_alone(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    seen = {}

    def caught(df):
        seen.setdefault("plan", df._jdf.queryExecution().optimizedPlan().toString())
        raise StopIteration

    kept = L.checkpointed
    L.checkpointed = caught
    try:
        L.licensed_paragraphs(docs, L.Scanner([], ["mit", L.UNKNOWN], [], [0.0, 0.0], 1.0))
    except StopIteration:
        pass
    finally:
        L.checkpointed = kept
    assert seen["plan"].count("regexp_extract_all") == 1


def test_strange_words_at_the_bound(spark):
    """Paragraphs around the least share of stated pairs, with strange words once and repeated, at ends and inside."""
    stated = {r.g for r in L._rows(spark, L.templates()).withColumn("w", L.tokens(F.col("text"))).select(F.explode(L.pairs("w")).alias("g")).distinct().collect()}
    base = "permission is hereby granted free of charge to any person obtaining a copy".split()
    texts = {" ".join(base)}
    for n in range(2, len(base)):
        for k in range(0, 5):
            texts |= {" ".join(base[:n] + [f"qq{i}" for i in range(k)]), " ".join([f"qq{i}" for i in range(k)] + base[:n]), " ".join(base[:n] + ["qq"] * k), " ".join([*base[: n // 2], *["qq"] * k, *base[n // 2 : n], *base[: n // 2]])}
    want = set()
    for t in texts:
        w = t.split()
        own = {f"{a} {b}" for a, b in zip(w, w[1:])}
        if len(own & stated) / len(own) >= L.MIN_CONTAINMENT:
            want.add(t)
    scanner = L.Scanner(["free"], ["mit", L.UNKNOWN], [[0.0, 0.0]], [0.0, 0.0], 1.0)
    docs = spark.createDataFrame(list(enumerate(sorted(texts))), "doc_id long, text string")
    assert {r.paragraph for r in L.licensed_paragraphs(docs, scanner).collect()} == want and 0 < len(want) < len(texts)
