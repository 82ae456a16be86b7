import hashlib
import random

from lectern.llm import lines


def brute(rows, k, words):
    """{doc_id: text left} by comparing windows of k lines and single lines of ``words`` or more words."""
    first, seqs = {}, {}
    for d, t in sorted(rows):
        seqs[d] = [(j, x) for j, x in enumerate(t.split("\n")) if x.encode().split()]
        for n in (1, k):
            for i in range(len(seqs[d]) - n + 1):
                first.setdefault(tuple(x for _, x in seqs[d][i : i + n]), (d, i))
    out = {}
    for d, t in rows:
        gone = set()
        for n in (1, k):
            for i in range(len(seqs[d]) - n + 1):
                run = seqs[d][i : i + n]
                if (n > 1 or len(run[0][1].encode().split()) >= words) and first[tuple(x for _, x in run)] != (d, i):
                    gone.update(j for j, _ in run)
        out[d] = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone)
    return out


def test_long_single_lines(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c d e", "f g h i", "", " \t", "j k  l m n o"]) for _ in range(rng.randrange(0, 12)))) for i in range(40)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 2, min_words=4).collect()}
    assert got == brute(rows, 2, 4)


def test_single_line_document(spark):
    passage = " ".join(f"w{i}" for i in range(168))
    rows = [(164, f"head\n{passage}\ntail"), (606, passage), (700, f"All rights reserved.\n{passage}\nother"), (701, "All rights reserved.")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=lines.MIN_WORDS).collect()}
    assert got == {164: rows[0][1], 606: "", 700: "All rights reserved.\nother", 701: "All rights reserved."}


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.kept_sha256 for r in lines.op3_line_dedup(spark, sf).collect()}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in brute(rows, 2, lines.MIN_WORDS).items()}
