"""Fill-in-the-middle: boundary lists, cuts by plain string slicing, exact round trips."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import fim


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=400), st.integers(0, 3))
def test_boundaries_are_the_offsets_of_code_points(text, spread):
    text = text * (1 + 40 * spread)
    data = text.encode("utf-8", "surrogatepass")
    want = np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in text)])
    at = np.arange(len(want))
    assert (fim.boundaries(data).select(at) == want).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**7), min_size=1, max_size=300))
def test_lists_with_wide_gaps(values):
    values = np.sort(np.array(values))
    held = fim.EliasFano(values)
    assert (held.select(np.arange(len(values))) == values).all()
    assert len(held.low) * 8 + held.n <= held.n * (3 + max(0, int(values[-1] // held.n).bit_length())) + 8


def by_slices(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


LONG = "aé漢😀 \n" * 30_000


@pytest.mark.parametrize("members", [1000, 2])
def test_rows_of_all_kinds(spark, monkeypatch, members):
    """Nulls, repeated rows, texts of all widths, half sentinels next to cuts; crowded texts are dealt to several rows."""
    monkeypatch.setattr(fim, "MEMBERS", members)
    monkeypatch.setattr(fim, "BATCH", 500_000)
    texts = [None, "", "a", "<P", "<<S", "P>M>", "x<M>y", "<P><S>", "éé漢", "😀" * 9, "one copy of many", LONG]
    rows = [(i, texts[i % 12 if i < 60 else 10], 5) for i in range(110)] + [(None, "nobody's", 5), (None, None, 5), (7, "twice", 5), (7, "twice", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form int").repartition(3)
    out = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out) == Counter((d, *by_slices(d, t)) for d, t, _ in rows)
    assert Counter((r.doc_id, r.back) for r in out) == Counter((d, t or "") for d, t, _ in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert not fim.fill_in_middle(df.limit(0)).collect()
    index = fim.distinct_texts(df).collect()
    assert sum(len(r.members) for r in index) == len(rows) and (members == 2 or len(index) == len({t or "" for _, t, _ in rows}))


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fim.fill_in_middle(df).collect()}
    assert got == {r.doc_id: by_slices(r.doc_id, r.text) for r in df.collect()}
    assert any(v[1] == "spm" for v in got.values())


def test_text_ids_are_refused(spark):
    with pytest.raises(TypeError):
        fim.fill_in_middle(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
