import random

from lectern.llm import decontamination as dc


def grams(text, size):
    w = (text or "").lower().encode().split()
    return {b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()


def check(docs, items):
    got = sorted({(str(r.doc_id), r.item_id, r.n_item, r.n_shared) for r in dc.contaminated(docs, items).collect()})
    want = set()
    for i in items.collect():
        size = min(5, len((i.text or "").split()))
        b = grams(i.text, size)
        for d in docs.collect():
            n = len(b & grams(d.text, size))
            if b and n >= 0.8 * len(b) - 1e-9:
                want.add((str(d.doc_id), i.item_id, len(b), n))
    assert got == sorted(want)
    return got


def test_tables(spark, sf):
    assert check(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))


def test_altered_items(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 20, 40, 90])))) for i in range(30)]
    docs = []
    for d in range(150):
        w = items[rng.randrange(30)][1].split()
        for _ in range(rng.randrange(0, 4)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(["zz", word()])
        docs.append((d, " ".join([word() for _ in range(rng.randrange(60))] + w + [word() for _ in range(rng.randrange(60))])))
    check(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))


def test_edges(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(20_000))
    items = spark.createDataFrame([(1, "A b c d e f", 0), (1, "A b c d e f", 0), (2, None, 0), (3, "", 0), (4, "one two", 0), (5, "w9000 w9001 w9002 w9003 w9004", 0)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x a B c d E f y", 0), (3, "x a B c d E f y", 0), (None, "a b c d e f", 0), (4, "One  two", 0), (5, "one two three", 0), (6, long, 0)], "doc_id long, text string, item_id int")
    got = check(docs, items)
    assert {g[0] for g in got} == {"3", "None", "4", "5", "6"}
    kept = sorted((str(r.doc_id) for r in dc.decontaminate(docs, items).collect()))
    assert kept == ["1", "2"]
    assert not dc.contaminated(docs, items.limit(0)).collect() and not dc.contaminated(docs.limit(0), items).collect()
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)  # the shuffled form gives the same
    assert check(docs, items) == got


def test_items_of_few_words_inside_long_texts(spark):
    """One to four words side by side, wherever they stand; not across others, and only whole words."""
    items = spark.createDataFrame([(1, "tiny answer"), (2, "words before the tiny"), (3, "Unique"), (4, "a b a"), (5, "not here at all")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some words before the tiny answer and words after it"), (2, "tiny little answer"), (3, "unique"), (4, "so uniquely a b a b a " + "w " * 5000 + "unique"), (5, "answer tiny"), (6, "tiny answer")], "doc_id long, text string")
    assert {g[:2] for g in check(docs, items)} == {("1", 1), ("1", 2), ("6", 1), ("3", 3), ("4", 3), ("4", 4)}
