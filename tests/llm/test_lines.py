import random

import duckdb
import pytest

from lectern.llm import lines


def brute(rows, k):
    """[(doc_id, text left, lines removed)] by comparing the windows of k lines themselves."""
    seqs = {}
    for d, t in sorted({r for r in rows if r[0] is not None and r[1] is not None}):
        seqs[d, t] = [(i, x) for i, x in enumerate(t.split("\n")) if x.encode().split()]
    first = {}
    for key, seq in seqs.items():
        for i in range(len(seq) - k + 1):
            first.setdefault(tuple(x for _, x in seq[i : i + k]), (key, i))
    out = []
    for d, t in rows:
        gone = set()
        seq = seqs.get((d, t), [])
        for i in range(len(seq) - k + 1):
            if first[tuple(x for _, x in seq[i : i + k])] != ((d, t), i):
                gone.update(j for j, _ in seq[i : i + k])
        out.append((d, t if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone), len(gone)))
    return out


def check(df, k=2):
    got = [(r.doc_id, r.text, r._n_removed) for r in lines.dedup_lines(df, k).collect()]
    want = brute([(r.doc_id, r.text) for r in df.collect()], k)
    assert sorted(map(str, got)) == sorted(map(str, want))
    return got


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_random_lines(spark, k):
    rng = random.Random(k)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c d", "", " \t", "e"]) for _ in range(rng.randrange(0, 14)))) for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), k)


def test_edges(spark):
    long = "\n".join(f"line {i}" for i in range(3000))
    rows = [(1, None, 5), (2, "", 5), (3, "x\ny", 5), (3, "x\ny", 5), (4, "x\ny\nz", 5), (None, "x\ny", 5), (5, long, 5), (6, "new\n" + long, 5)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert (4, "z", 2) in got and (6, "new", 3000) in got
    assert not lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect()


def test_lengths_are_those_of_the_longest_earlier_copy(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "q\na\nb\nc\nd"), (3, "b\nc")], "doc_id long, text string")
    found = {(r.doc_id, r.i): (r.length, r.src_doc, r.src_i) for r in lines.copied_suffixes(lines._suffixes(df, "doc_id", "text")).collect()}
    assert found == {(2, 1): (4, 1, 0), (2, 2): (3, 1, 1), (2, 3): (2, 1, 2), (2, 4): (1, 1, 3), (3, 0): (2, 1, 1), (3, 1): (1, 1, 2)}


def longest_copies(rows):
    """{(doc_id, i): (lines, first place)} of the longest earlier copy of each suffix, by comparing it with all before it."""
    seqs = {d: [x for x in t.split("\n") if x.encode().split()] for d, t in rows}
    places = sorted((d, i) for d, s in seqs.items() for i in range(len(s)))
    out = {}
    for n, (d, i) in enumerate(places):
        best, first = 0, None
        for e, j in places[:n]:
            x, y = seqs[d][i:], seqs[e][j:]
            same = next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
            if same > best:
                best, first = same, (e, j)
        if best:
            out[d, i] = (best, *first)
    return out


@pytest.mark.parametrize("seed,letters", [(1, 2), (2, 3), (3, 30)])
def test_all_suffixes_against_all_before_them(spark, seed, letters):
    """Few lines give runs of all lengths with sources in many documents."""
    rng = random.Random(seed)
    base = [str(rng.randrange(letters)) for _ in range(60)]
    rows = []
    for i in range(35):
        a, n = rng.randrange(50), rng.randrange(1, 22)
        rows.append((i, "\n".join([str(rng.randrange(letters)) for _ in range(rng.randrange(4))] + base[a : a + n] + [str(rng.randrange(letters))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = longest_copies(rows)
    got = {(r.doc_id, r.i): (r.length, r.src_doc, r.src_i) for r in lines.copied_suffixes(lines._suffixes(df, "doc_id", "text")).collect()}
    assert got == want
    longest = {r.doc_id: r._longest_run for r in lines.dedup_lines(df).collect()}
    assert longest == {d: max((n for (e, _), (n, *_) in want.items() if e == d and n > 1), default=0) for d, _ in rows}


def test_a_run_whose_parts_stand_first_elsewhere(spark):
    """Pairs of its lines stand first in different documents, all three together in the third."""
    df = spark.createDataFrame([(1, "A\nB\nY"), (2, "Q\nB\nC\nZ"), (3, "U\nA\nB\nC\nV"), (4, "W\nA\nB\nC\nX")], "doc_id long, text string")
    assert {(r.doc_id, r.start, r.end, r.src_doc, r.src_start) for r in lines.repeated_runs(df).collect()} == {(3, 1, 3, 1, 0), (3, 2, 4, 2, 1), (4, 1, 4, 3, 1)}
    assert {r.doc_id: r._longest_run for r in lines.dedup_lines(df).collect()} == {1: 0, 2: 0, 3: 2, 4: 3}


def test_every_depth_counts(spark):
    """Pairs of lines stand first in different documents; only the intervals at depth 4 show that all four lines have one copy."""
    rows = [(1, "a\nb\nx"), (2, "b\nc\ny"), (3, "c\nd"), (4, "a\nb\nc\nd"), (5, "q\na\nb\nc\nd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = {(r.doc_id, r.start, r.end, r.src_doc, r.src_start) for r in lines.repeated_runs(df).collect()}
    assert runs == {(4, 0, 2, 1, 0), (4, 1, 3, 2, 0), (4, 2, 4, 3, 0), (5, 1, 5, 4, 0)}
    assert {r.doc_id: (r.text, r._longest_run) for r in lines.dedup_lines(df).collect()} == {1: (rows[0][1], 0), 2: (rows[1][1], 0), 3: (rows[2][1], 0), 4: ("", 2), 5: ("q", 4)}


def test_overlapping_copies_in_one_document(spark):
    rows = [(1, "A\nA\nA"), (2, "A\nB\nC"), (3, "B\nC")]
    assert {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: "A", 2: "A\nB\nC", 3: ""}


def test_clashing_columns_and_text_ids(spark):
    rows = [("a", "x\ny", 1, 2, 3, 4, 5), ("b", "x\ny\nz", 1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _doc int, _gone int, _runs int, tkey int, i int")
    out = lines.dedup_lines(df)
    assert out.columns == [*df.columns, "_n_lines", "_n_removed", "_longest_run"]
    assert sorted(map(tuple, out.collect())) == [(*rows[0], 2, 0, 0), ("b", "z", *rows[1][2:], 3, 2, 2)]


def test_equal_hashes_of_one_kind(spark, monkeypatch):
    """Lines that share one of their two hashes stay apart."""
    plain = lines.F.xxhash64
    rows = [(1, "a\nb"), (2, "c\nd"), (3, "c\nd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for collide in (1, 2):
        monkeypatch.setattr(lines.F, "xxhash64", lambda *c, collide=collide: lines.F.lit(7).cast("long") if len(c) == collide else plain(*c))
        suffixes = lines._suffixes(df, "doc_id", "text")
        assert suffixes.select("h1", "h2").distinct().count() == 4
        monkeypatch.setattr(lines.F, "xxhash64", plain)


def test_query_against_sql(spark, sf):
    names = ("doc_id", "n_lines", "n_removed", "longest_run", "kept_sha256")
    got = sorted(map(str, (tuple(r[c] for c in names) for r in lines.op3_line_dedup(spark, sf).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(map(str, con.execute(f"SELECT {', '.join(names)} FROM ({lines.OP3_SQL})").fetchall()))
