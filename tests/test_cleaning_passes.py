"""The cleaning reads texts seldom: Python sees only what it may change, and what a pattern finds serves text and report."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import cleaning as C


def test_normal_characters_stay_wherever_they_stand():
    listed = re.compile(f"[{C.NORMAL}]")
    seconds = {d[1] for d in (unicodedata.decomposition(chr(i)).split() for i in range(0x110000)) if len(d) == 2 and not d[0].startswith("<")}
    for c in filter(listed.match, (chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)):
        assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) and f"{ord(c):04X}" not in seconds


def test_python_sees_only_texts_that_may_change(spark, monkeypatch):
    monkeypatch.setattr(C, "nfkc", F.udf(lambda t: None if t is None else "seen", T.StringType()))
    df = spark.createDataFrame([(0, "plain \u201ctext\u201d, \u00e9 \u2264 \u03b1\u00b9 \ufb01ne\t\u00adx"), (1, "\ufb05"), (2, "e\u0301"), (3, "\u212b"), (4, None)], "i int, text string")
    got = {r.i: r.t for r in df.select("i", C.unicode(F.col("text")).alias("t")).collect()}
    assert got == {0: 'plain "text", \u00e9 \u2264 \u03b1 fine x', 1: "seen", 2: "seen", 3: "seen", 4: None}


@pytest.mark.parametrize("preset", ["textbook", "light"])
def test_passes_do_what_the_rules_do(spark, preset):
    text = "at\n https://a.b/c lowand highwage,3 [1, 2] (see Lee et al., 2019) 3 ≤ α J.R.R. Tolkien ISBN 978-0-306-40615-7 and U.S., overrun"
    how = C.Cleaning(preset, {"reflow": False, **{n: False for n in C.LINE_RULES}})
    row = C.clean(spark.createDataFrame([(0, text)], "doc_id long, text string"), how).first()
    c = C.unicode(F.col("text"))
    for name, rule in C.TEXT_RULES.items():
        c = rule(c) if name in how.rules() else c
    assert row.text == spark.createDataFrame([(text,)], "text string").select(C.tidy(c)).first()[0]
    told = {r.rule: list(r.samples) for r in row.report}
    assert told["urls"] == ["at https://a.b/c"] + (["ISBN 978-0-306-40615-7"]) and told["dot_letters"] == ["J.R.R. -> J R R", "U.S. -> U S"]
    if preset == "textbook":
        assert told["citations"] == ["[1, 2]", "(see Lee et al., 2019)"] and told["footnote_markers"] == ["…,3"]
        assert told["broken_compounds"] == ["lowand -> low and", "highwage -> high-wage"] and told["symbols"] == ["≤ -> less than or equal to", "α -> alpha"]
