from lectern.llm import licenses


def test_words_of_ordinary_prose_hide_no_licence(spark):
    """The words of these wordings all occur in prose, and so in the sample."""
    texts = {
        1: ("apache", "Distributed under Apache 2.0"),
        2: ("cc_by_nc", "You may not use the material for commercial purposes"),
        3: ("public_domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
        4: (None, "You may use the apache trail for commercial traffic."),
    }
    words = sorted({w for _, t in texts.values() for w in t.replace(",", "").replace(".", "").split() if w != "20"} | {"2.0"})
    prose = [(100 + i, f"They said {w} was spoken here often. Rain fell on {w} again today.") for i, w in enumerate(words)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in texts.items()] + prose, "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs).collect()}
    assert {i: got[i] for i in texts} == {i: family for i, (family, _) in texts.items()}
    assert not any(got[d] for d, _ in prose)
