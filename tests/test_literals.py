"""Values that the operators must give for literal inputs."""

import itertools
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import cleaning as C
from lectern.operators import normalize as N
from lectern.operators import scoring as V
from lectern.operators import segment as G
from lectern.operators import subtitles as S


def run(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    return [r.x for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def check(spark, column, cases):
    assert run(spark, column, list(cases)) == list(cases.values())


def test_parentheses(spark):
    check(spark, N.strip_parentheses, {
        "Hello (world) there": "Hello, world, there", "(first) and (second)": "first, and, second", "((nested))": "nested",
        "See details (below).": "See details, below.", "Hello, (world) there": "Hello, world, there", "a (b)\nc": "a, b, c", "x\ny (z) w": "x\ny, z, w", "none": "none",
        "f(a (b) c) d": "f, a, b, c, d", "one (two": "one (two", "one) two": "one) two", "(a (b)) c": "a b c", "() x": "x", "a (b) x\nlater": "a b x\nlater", "(a) (b) x\n(c) d": "a, b, x, c, d", "say: (so) it": "say: so, it", "a (b)(c) d": "a, b, c, d",
        "to (be) x\nor (not) y": "to be x\nor, not, y",
    })
    long = run(spark, N.strip_parentheses, ["a (b) c " * 20_000])[0]
    assert long.count(", b, c") == 20_000


def test_normalize(spark):
    cases = {
        "The cost is $5M.": "The cost is 5 million dollars.", "Revenue: $2.5B": "Revenue: 2.5 billion dollars", "Salary: $100K": "Salary: 100 thousand dollars", "It costs $5.": "It costs 5 dollars.",
        "Price: $5.99": "Price: 5 dollars and 99 cents", "$5 million now": "5 million dollars now", "Dr. Smith arrived.": "Doctor Smith arrived.", "Mr. and Mrs. Jones": "Mister and Missus Jones", "2 + 2": "2 plus 2",
        "R&D department": "R and D department", "50% off": "50 percent off", "email @ domain": "email at domain", "yes/no question": "yes or no question", "12/25/2024": "12/25/2024", "http://a.b/c": "http://a.b/c", "I have 42 items.": "I have 42 items.",
        "": "", "   ": "   ", "Well. (Laughs) Indeed.": "Well. (laughs) Indeed.", "It cost $5M. (sighs) That is a lot.": "It cost 5 million dollars. (sighs) That is a lot.",
    }
    check(spark, N.normalize, cases)
    check(spark, lambda c: N.normalize(c, "full"), {"I have 42 items.": "I have forty two items.", "0 19 100 123 999 1000 007": "zero nineteen one hundred one hundred twenty three nine hundred ninety nine 1000 seven"})
    with pytest.raises(ValueError):
        N.normalize(F.lit("x"), "odd")


def test_newline_pauses(spark):
    check(spark, G.newline_pauses, {
        "a line\nwraps": "a line wraps", "Heading\nNext": "Heading, Next", "One\n\nTwo": "One. Two", "End.\n\nNext": "End. Next", "an inter-\nnational": "an international", "list:\nItem": "list: Item",
        "\n\nStart": "Start", "tail\n": "tail,", 'x\n"quoted"': 'x "quoted"', "foo \nBar": "foo , Bar", "a\n\n\nb": "a. b", "a-\nB": "a-, B", "wait!\nÉté": "wait! Été", "x\n(and": "x (and", "é\né": "é é",
    })
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", "\n", "\n", " ", "-", ".", ",", '"', "(", "é"]) for _ in range(rng.randrange(1, 14))) for _ in range(1000)]
    for text, got in zip(texts, run(spark, G.newline_pauses, texts), strict=True):
        assert "\n" not in got and "  " not in got and got == got.strip()
        solid = lambda t: [c for c in t if c.isalpha() or c in '"(']  # noqa: E731  letters and marks stay in their order
        assert solid(text) == solid(got)


def test_segments(spark):
    texts = ["A" * 200 + ". " + "B" * 100 + ".", "A" * 200 + ", " + "B" * 80, "A" * 1000, "", "Here is a list:\nitem one", "short", "word " * 300]
    a, b, c, d, e, f, g = run(spark, G.segment, texts)
    assert len(a) == 2 and a[0].endswith(".") and len(b) == 2 and "," in b[0]
    assert len(c) > 1 and all(len(x) <= 250 for x in c[:-1]) and "".join(c) == texts[2]
    assert d == [""] and f == ["short"] and ":," not in e[0] and ":." not in e[0]
    assert " ".join(g) == texts[6].strip() and all(len(x) <= 320 for x in g)


def chunk_end(rest):
    """Where the next chunk ends by the rule: the first of these choices that there is."""
    if len(rest) <= 220:
        return len(rest)
    zone = range(160, 220)
    ends = [max((i + 1 for i in zone if rest[i] in marks), default=None) for marks in (".!?", ",;")]
    spaces = [next((i for i in range(220, min(320, len(rest))) if rest[i] == " "), None), max((i for i in zone if rest[i] == " "), default=None)]
    return next(x for x in (*ends, *spaces, 220) if x is not None)


def test_segments_by_definition(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(200):
        marks = rng.choice([" ", "  ", " . ", ", ", "; ", "", "! ", " é "])
        texts.append("".join("".join(rng.choice("abçd") for _ in range(rng.randrange(1, rng.choice([8, 90, 400])))) + rng.choice([marks, " ", ""]) for _ in range(rng.randrange(1, 60))))
    for text, got in zip(texts, run(spark, lambda c: G.segment(c, newlines=False), texts), strict=True):
        rest, want = text.strip(), []
        while rest:
            n = chunk_end(rest)
            want.append(rest[:n].strip())
            rest = rest[n:].strip()
        assert got == (want or [""])


def test_a_long_text_is_segmented_in_time(spark):
    (got,) = run(spark, lambda c: G.segment(c, newlines=False), ["word, and more " * 200_000])
    assert len(" ".join(got)) == 15 * 200_000 - 1


def test_cleaning(spark):
    page = "Chapter 1\n\npackages led to the rise of the primary site\nof ATP synthesis and an inter-\nnational agreement."
    texts = [page, "A book by J.R.R. Tolkien.", "The value is ≤ 5 percent.", "Notes\n\nthe following discussion goes on here.", "", "   ", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in C.clean(df).collect()}
    assert got[0] == "Chapter 1.\n\npackages led to the rise of the primary site of ATP synthesis and an international agreement."
    assert "J R R Tolkien" in got[1] and "less than or equal to" in got[2] and got[3].startswith("Notes\n\nthe")
    assert [got[i] for i in (4, 5, 6)] == texts[4:]
    off = {r.doc_id: r.text for r in C.clean(df, C.Cleaning("off")).collect()}
    assert off == dict(enumerate(texts))


def test_reflow(spark):
    long = "a line of words that goes on and on"
    check(spark, C.reflow, {
        f"{long}\nand ends.": f"{long} and ends.", f"{long}\nAnother": f"{long}\nAnother", "short\nline": "short\nline", "an inter-\nnational": "an international", "sub-\nUnit": "sub-Unit", f"{long}:\nitem": f"{long}:\nitem",
        f"{long}\n(and so": f"{long} (and so", f"{long}.\"\nand": f"{long}.\"\nand", f"{long}\n\nover the page.\nNext": f"{long} over the page.\nNext", f"Title\n{long}\n \n\n and on": f"Title\n{long} and on",
        f"{long}.\n\nNew": f"{long}.\n\nNew", "": "", "\n\n": "", "ten chars\nmore of it then": "ten chars\nmore of it then", "ten chars \nmore of it\nthen a third": "ten chars\nmore of it\nthen a third",
    })


def test_what_reflow_tells(spark):
    """Both sides of each joint: a hyphen stays in what is told, a second joint starts forty characters back, paragraphs come before what is between them."""
    told = lambda t: spark.createDataFrame([(t,)], "t string").select(C.rejoined(F.col("t"))["told"]).first()[0]
    one = "Delegates from many countries met in the long hall and spoke of inter-\nnational print and of the more\nkind of thing"
    assert told(one) == ["…met in the long hall and spoke of inter- + national print and of the more…", "…e of international print and of the more + kind of thing…"]
    assert told("a-\nb-\nC") == ["…a- + b-…", "…ab- + C…"] and told("short\nline") == [] and told("") == []
    two = "A paragraph that is cut by the end of its page and\n\ngoes on over there without\nan end that is near\nStop here"
    assert told(two) == ["…goes on over there without + an end that is near…", "…h that is cut by the end of its page and + goes on over there without an end that i…"]
    assert told("A first line that stands alone\nAnother that is long enough to go on\nwith more") == ["…one\nAnother that is long enough to go on + with more…"]


def test_a_long_text_is_reflowed_in_time(spark):
    text = "words that go on and on without an end-\n" * 100_000
    began = time.time()
    assert len(spark.createDataFrame([(text,)], "t string").select(C.reflow(F.col("t"))).first()[0]) > 3_000_000
    assert time.time() - began < 20


def test_clean_keeps_every_row(spark):
    """Null and repeated ids, null texts and columns of other names."""
    rows = [(None, "first [1] text.", 1), (7, "same id [2] one.", 1), (7, "same id [2] two.", 1), (7, "same id [2] two.", 1), (8, None, 1), (9, "", 1)]
    out = C.clean(spark.createDataFrame(rows, "doc_id long, text string, mask int")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == [("7", "same id one."), ("7", "same id two."), ("7", "same id two."), ("8", "None"), ("9", ""), ("None", "first text.")]
    assert {(r.doc_id, tuple((x.rule, x["count"], tuple(x.samples)) for x in r.report)) for r in out if r.doc_id in (None, 8)} == {(None, (("citations", 1, ("[1]",)),)), (8, ())}
    assert not C.clean(spark.createDataFrame([], "doc_id long, text string")).collect()


def test_report(spark):
    page = "Ch1.indd 4\nSee notes.2 Then ‘x’ ≤ y.\n" + "\n".join(f"a stub line that is cut {'x' * i}-\nshort and goes." for i in range(8))
    df = spark.createDataFrame([(1, page)], "doc_id long, text string")
    row = C.clean(df, C.Cleaning("textbook", None, (("notes", "N"),))).first()
    told = {x.rule: x for x in row.report}
    assert list(told) == [r for r in C.RULES if r in told] and all(x.label == C.LABELS[x.rule] for x in row.report)
    assert told["typesetter_stamps"].samples == ["Ch1.indd 4"] and told["footnote_markers"].samples == ["….2"] and told["symbols"].samples == ["≤ -> less than or equal to"]
    assert told["unicode"].samples == ["folded quotes, dashes and spacing"] and told["substitutions"].samples == ["notes -> N"]
    assert told["reflow"]["count"] == 8 and len(told["reflow"].samples) == 6 and all(len(s) <= C.SAMPLE_CHARS for s in told["reflow"].samples)
    assert row.chars_before == len(page) and row.chars_after == len(row.text)
    text = C.clean(df, C.Cleaning("light")).select(C.report_json(F.struct("text", "report")).alias("j")).first().j
    assert {x["rule"] for x in json.loads(text)["report"]} == {"unicode", "reflow"}


def test_scores(spark):
    check(spark, lambda c: F.array_join(V.score_tokens(c), " "), {"well uh yes um fine": "well yes fine", "2016": "two thousand sixteen", "[S1] Hi (laughs), don't re-do 1,234,567!": "hi don't re do one million two hundred thirty four thousand five hundred sixty seven", "": ""})
    cases = [("a b c", "a x c", (1, 0, 0)), ("a b c", "a c", (0, 1, 0)), ("a c", "a b c", (0, 0, 1)), ("", "a b", (0, 0, 2)), ("a b", "", (0, 2, 0))]
    df = spark.createDataFrame(cases, "r string, h string, want struct<a:int,b:int,c:int>").withColumns({c: F.filter(F.split(c, " "), lambda w: w != "") for c in "rh"})
    for r in df.select("want", V.word_errors(F.col("r"), F.col("h")).alias("e"), V.weighted_rate(V.word_errors(F.col("r"), F.col("h"))).alias("w")).collect():
        assert tuple(r.want) == (r.e.substitutions, r.e.deletions, r.e.insertions)
    assert run(spark, lambda c: V.repetition_score(F.split(c, " ")), ["a b c " * 20_000 + "end"]) == [pytest.approx((20_000 - 2) / 3)]
    check(spark, lambda c: V.repetition_score(F.split(c, " ")) > 0, {"a b c a b c a b c a b c a b c": True, "a b c d e f g h i j": False, "a b c a b c": False})


def test_word_errors_add_up(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))), " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "r string, h string").coalesce(1).select(F.split("r", " ").alias("r"), F.split("h", " ").alias("h"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for r in df.select("r", "h", V.word_errors(F.col("r"), F.col("h")).alias("e")).collect():
        e = r.e
        assert e.substitutions + e.deletions + e.hits == len(r.r) and e.substitutions + e.insertions + e.hits == len(r.h)
        assert e.substitutions + e.deletions + e.insertions == distance(r.r, r.h)


def test_bands_give_what_the_whole_table_gives():
    """Random words with all kinds of edits, ties included; bands that are too narrow at first; long texts in time."""
    rng = random.Random(8)
    for _ in range(400):
        x = [rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randrange(60))]
        y = list(x)
        for _ in range(rng.randrange(40)):
            kind, at = rng.randrange(3), rng.randrange(len(y) + 1)
            y[at : at + (kind > 0)] = [rng.randrange(6)] if kind < 2 else []
        a, b = np.array(x, np.int64), np.array(y, np.int64)
        assert V.edit_script(a, b) == V._counted(a, b)
    words = [rng.randrange(3000) for _ in range(20_000)]
    heard = [w for i, w in enumerate(words) for w in ([] if i % 800 == 5 else [w, 1] if i % 800 == 300 else [w])]
    began = time.time()
    assert V.edit_script(np.array(words), np.array(heard)) == (0, 25, 25)
    assert time.time() - began < 5


def test_distances_beyond_every_bound(spark):
    pairs = [("kitten", "sitting", 3), ("", "abc", 3), ("same é", "same é", 0), ("x" * 300, "y" * 300, 300), ("ab" * 1500, "ba" * 1500, 2), ("", "", 0)]
    rows = spark.createDataFrame(pairs, "a string, b string, d int").select(V.distance(F.col("a"), F.col("b")).alias("got"), "d").collect()
    assert all(r.got == r.d for r in rows)


def test_cues(spark):
    def cues(chunks):
        rows = spark.createDataFrame([(1, i, t, d) for i, (t, d) in enumerate(chunks)], "job_id int, index int, text string, duration double")
        return S.build_cues(rows).orderBy("cue_index").collect()

    got = cues([("One. Two. Three.", 3.0), ("Four.", 1.0)])
    assert [c.text for c in got] == ["One.", "Two.", "Three.", "Four."] and got[3].start == 3.0
    assert cues([("", 5.0), ("After the gap.", 2.0)])[0].start == 5.0
    long = cues([("word " * 60, 30.0), ("Hi. A. B.", 0.9)])
    assert all(a.end <= b.start + 1e-9 for a, b in itertools.pairwise(long))
    check(spark, lambda c: S.stamp(c.cast("double")), {"3661.5": "01:01:01,500", "-1": "00:00:00,000", "0.9999": "00:00:00,999"})
