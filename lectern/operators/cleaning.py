"""Cleaning rules for extracted book text, as DataFrame transforms, with a report of what each removed.

Rules on lines work on one row per line, (doc_id, line_no, line), and tell for each whether it stays, what it becomes and
what was removed; one shuffle by document serves all of them.  Rules on whole texts are column functions; the whole cleaning
goes through their patterns one by one, so that what is found serves the text and the report.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import header_signature, is_prose, replace_characters, replace_found, strip, symbol_density

# Rule names in registry order with their labels, presets, character tables and patterns.
LABELS = {
    "unicode": "Normalize characters",
    "typesetter_stamps": "Typesetter stamps",
    "proof_notices": "Proof/copyright notices",
    "running_headers": "Running headers & footers",
    "headings": "Chapter & section headings",
    "page_numbers": "Page numbers",
    "reflow": "Rejoin split paragraphs",
    "footnote_markers": "Footnote reference numbers",
    "citations": "Inline citations",
    "figures_tables": "Figure & table bodies",
    "formula_lines": "Formula & symbol lines",
    "symbols": "Speak or drop symbols",
    "urls": "URLs, DOIs & ISBNs",
    "broken_compounds": "Repair broken compounds",
    "dot_letters": "Spaced initials",
    "substitutions": "Pronunciation dictionary",
}
RULES = list(LABELS)
PRESETS = {"off": [], "light": ["unicode", "reflow", "urls", "dot_letters", "substitutions"], "textbook": RULES}
MAX_SAMPLES, SAMPLE_CHARS = 6, 100
SUPERSCRIPTS = "¹²³⁰⁴⁵⁶⁷⁸⁹"
CHARACTERS = [("‘", "'"), ("’", "'"), ("‚", "'"), ("‛", "'"), ("“", '"'), ("”", '"'), ("„", '"'), ("‟", '"'), ("′", "'"), ("″", '"'), ("–", "-"), ("—", ", "), ("―", ", "), ("−", "-"), ("…", "...")]
CHARACTERS += [(c, " ") for c in "       　•●▪⁃·"]
CHARACTERS += [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")]
CHARACTERS += [(c, "") for c in "­​‌‍﻿"] + [("\f", "\n\n")]
SYMBOLS = [("≈", " approximately "), ("≠", " not equal to "), ("≤", " less than or equal to "), ("≥", " greater than or equal to "), ("±", " plus or minus "), ("×", " times "), ("÷", " divided by "), ("→", " to "), ("←", " from "), ("↔", " to "), ("⇒", " implies "), ("∑", " the sum of "), ("∫", " the integral of "), ("√", " the square root of "), ("∞", " infinity "), ("°", " degrees "), ("‰", " per mille "), ("½", " one half "), ("¼", " one quarter "), ("¾", " three quarters "), ("<", " less than "), (">", " greater than "), ("©", " copyright "), ("®", ""), ("™", "")]
STAMP_FILE = r"(?dUiu)^\S*\.(?:indd|qxd|qxp|fm|dvi)\b.*$"
STAMP_TIME = r"(?dU)^\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:[AaPp]\.?[Mm]\.?)?$"
STAMP_CLOCK = r"(?dU)^\d{1,2}:\d{2}(?::\d{2})?\s*(?:[AaPp]\.?[Mm]\.?)?$"
# Patterns start with a plain class of what they can start with: Unicode's word boundaries and white space are slow to test at every character, and so are classes of many parts.
CAPS_RUN = r"(?=[A-Z][A-Z'\-])(?U)\b[A-Z][A-Z'\-]+\b(?:[\s,.\-]+\b[A-Z][A-Z'\-]+\b){4,}"
PAGE_LINE = r"(?d)^[\[(]?(?:[0-9]{1,4}|[ivxlcdmIVXLCDM]{1,7})[\])]?$"
PAGE_TAIL = r"(?dU)\s+\d{1,4}\s*$"
HEADING = r"(?dUiu)^(chapter|part|section|appendix|book|volume|unit|lesson|epilogue|prologue|preface|foreword|introduction|conclusion|afterword|glossary|index)\b[\s:.\-]*([0-9]{1,3}|[ivxlcdm]{1,7})?\s*$"
CAPTION = r"(?dUiu)^\s*((?:figure|fig\.?|table|chart|exhibit|plate|box|diagram|graph)\s*[0-9ivxlc]+(?:[.\-][0-9]+)*)\s*[:.\-]?\s*(.*)$"
SOURCE = r"(?dUiu)^\s*(source|sources|note|notes|adapted from|reprinted from|credit)\s*[:.]"
NUMBERS = r"(?dU)^[^A-Za-z]*(?:[-+]?[\d.,%$()]+[\s|\t]+){2,}[-+]?[\d.,%$()]+[^A-Za-z]*$"
DOT_LETTERS = r"(?=[A-Z]\.[A-Z]\.)(?dU)\b((?:[A-Z]\.){2,})(?=\s|$|[,;:])"
FOOTNOTE = r"(?dU)([.!?,;:])(?<=[A-Za-z)\]\"'][.!?,;:])(\d{1,3})(?=\s|$)"
CITATION_NUMBERS = r"(?=[^!-Z\\-~])(?U)\s*+\[\s*\d+(?:\s*[,\-–]\s*\d+)*\s*\]"
CITATION_AUTHORS = r"(?=[^!-')-~])(?U)\s*+\((?:see\s+)?(?:e\.g\.,?\s*)?[A-Z][A-Za-z'\-]+(?:\s+(?:et\s+al\.?|and|&|,)\s*[A-Z]?[A-Za-z'\-]*)*,?\s*\d{4}[a-z]?(?:\s*[;,]\s*[^()]{0,40}?\d{4}[a-z]?)*\s*\)"
URL = r"(?=[AaFfVvOoHhWwDd1])(?<![A-Za-z0-9])(?Uiu)(?:\b(?:at|from|via|on)\s+)?(?:\b(?:https?://|www\.)\S+|\bdoi:\s*\S+|\b10\.\d{4,}/\S+)"
ISBN = r"(?=ISBN)(?U)\bISBN[- ]?(?:13|10)?:?\s*[\d\-Xx]{10,17}\b"
COMPOUND_HEADS = "low high upper lower middle long short well cross multi single double self non anti pre post sub super inter intra over under tax".split()
COMPOUND_HYPHEN = "income incomes term terms run based cutting wage wages skilled earners bracket brackets".split()
COMPOUND_SPACE = "and or to".split()
COMPOUND_WORDS = "crosscutting overrun overruns underrun underruns longrun subterm interterm".split()
#: Characters on either side of a joint that the report shows.
TOLD_CHARS = 40
SHORT_WORDS = ("i", "a", "no", "ok", "so")
#: Inside of a class: characters that normal form KC leaves as they are, wherever they stand among their like.  Others are normal too, these are the common ones.
NORMAL = r"\x00-\x9f¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-žΑ-ΡΣ-ώА-ҁҊ-ԯ‐‒–—‘-‟†‡•‹›←-⇿∀-∫∱-⋿‰ぁ-ゖァ-ヺ一-鿿"


def resolve_rules(preset: Column, overrides: Column) -> Column:
    """Enabled rules, in registry order: the preset's (textbook if unknown or null) with overrides (map<string,boolean>) applied."""
    base = F.array(*map(F.lit, RULES))
    for name in ("off", "light"):
        base = F.when(F.lower(preset) == name, F.array(*map(F.lit, PRESETS[name])).cast("array<string>")).otherwise(base)
    entries = F.coalesce(F.map_entries(overrides), F.array().cast("array<struct<key:string,value:boolean>>"))
    named = lambda on: F.transform(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit(False)) == on), lambda e: e["key"])
    chosen = F.array_union(F.array_except(base, named(False)), named(True))
    return F.filter(F.array(*map(F.lit, RULES)), lambda r: F.array_contains(chosen, r))


def to_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): one row per line, numbered from 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))


def to_text(lines: DataFrame) -> DataFrame:
    """(doc_id, text): lines joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def _with_actions(lines: DataFrame, keep: Column, out: Column, samples: Column) -> DataFrame:
    """Adds keep (boolean), out (the line after the rule) and samples (what the rule removed) to lines."""
    return lines.withColumns({"keep": F.coalesce(keep, F.lit(True)), "out": out, "samples": samples})


def _none() -> Column:
    return F.array().cast("array<string>")


def _line_rule(rule):
    """A rule sees each line stripped (s) and whether it is prose, worked out once."""

    def apply(lines: DataFrame) -> DataFrame:
        ready = lines.withColumn("s", strip(F.col("line")))
        return rule(ready.withColumn("prose", is_prose(F.col("s")))).drop("s", "prose")

    apply.__name__, apply.__doc__ = rule.__name__, rule.__doc__
    return apply


def _one(cond: Column, sample: Column) -> Column:
    return F.when(cond, F.array(sample)).otherwise(_none())


@_line_rule
def typesetter_stamps(lines: DataFrame) -> DataFrame:
    hit = F.col("s").rlike(STAMP_FILE) | F.col("s").rlike(STAMP_TIME) | F.col("s").rlike(STAMP_CLOCK)
    return _with_actions(lines, ~hit, F.col("line"), _one(hit, F.col("s")))


@_line_rule
def proof_notices(lines: DataFrame) -> DataFrame:
    """The first run of five or more capital words of 30 characters goes; what little is left of the line goes with it."""
    found = lines.withColumn("run", F.when(F.length(F.col("s")) >= 30, F.regexp_extract(F.col("s"), CAPS_RUN, 0)).otherwise(""))
    hit = F.length("run") >= 30
    at = F.regexp_instr(F.col("s"), F.lit(CAPS_RUN))
    # worked out only where there is a run
    left = strip(F.concat(F.substring(F.col("s"), F.lit(1), at - 1), F.lit(" "), F.substring(F.col("s"), at + F.length("run"), F.length(F.col("s")))))
    found = found.withColumn("rest", F.when(hit, left))
    found = found.withColumn("gone_", F.when(hit, (F.col("rest") == "") | ((F.length("rest") < 40) & ~is_prose(F.col("rest")))).otherwise(False))
    samples = F.when(F.col("gone_") & (F.col("rest") != ""), F.array("run", "rest")).when(hit, F.array("run")).otherwise(_none())
    return _with_actions(found, ~F.col("gone_"), F.when(F.col("s") == "", F.col("line")).when(hit, F.col("rest")).otherwise(F.col("s")), samples).drop("run", "rest", "gone_")


@_line_rule
def running_headers(lines: DataFrame) -> DataFrame:
    """Short lines that are no sentences go if their signature repeats in the document, or if they are fragments."""
    eligible = (F.col("s") != "") & (F.length(F.col("s")) <= 100) & ~F.col("prose")
    counted = lines.withColumn("sig", F.when(eligible, header_signature(F.col("s"))))
    same = F.count("sig").over(Window.partitionBy("doc_id", "sig"))
    hit = F.col("sig").isNotNull() & (((F.col("sig") != "") & (same >= 2)) | ((F.length(F.col("s")) <= 3) & ~F.lower(F.col("s")).isin(*SHORT_WORDS)))
    return _with_actions(counted, ~hit, F.col("line"), _one(hit, F.col("s"))).drop("sig")


@_line_rule
def headings(lines: DataFrame) -> DataFrame:
    hit = (F.col("s") != "") & (F.length(F.col("s")) <= 60) & ~F.col("prose") & F.col("s").rlike(HEADING)
    fixed = F.concat(F.regexp_replace(F.col("s"), r"[ .:-]+$", ""), F.lit("."))
    return _with_actions(lines, F.lit(True), F.when(hit, fixed).otherwise(F.col("line")), _one(hit, F.concat(F.col("s"), F.lit(" -> "), fixed)))


@_line_rule
def page_numbers(lines: DataFrame) -> DataFrame:
    gone = (F.col("s") != "") & F.col("s").rlike(PAGE_LINE)
    cut = F.when(~gone & (F.length(F.col("s")) <= 60) & ~F.col("prose"), F.regexp_replace(F.col("s"), PAGE_TAIL, "")).otherwise(F.col("s"))
    trimmed = (cut != F.col("s")) & (cut != "")
    return _with_actions(lines, ~gone, F.when(F.col("s") == "", F.col("line")).when(trimmed, cut).otherwise(F.col("s")), _one(gone | trimmed, F.col("s")))


@_line_rule
def figures_tables(lines: DataFrame) -> DataFrame:
    """Captions stay; the block of data after one goes, until prose resumes.

    What a line does to the block depends on the line alone (a caption opens it, other kept lines close it, blank and dropped
    lines leave it), so the state at a line is the last opening or closing before it.
    """
    caption = (F.col("s") != "") & F.col("s").rlike(CAPTION)
    rest = strip(F.regexp_extract(F.col("s"), CAPTION, 2))
    label = F.regexp_extract(F.col("s"), CAPTION, 1)
    kept = F.when(rest == "", F.concat(label, F.lit("."))).otherwise(F.concat(label, F.lit(". "), rest))
    data = F.col("s").rlike(SOURCE) | F.col("s").rlike(NUMBERS) | (symbol_density(F.col("s")) > 0.4)
    dropped = (F.col("s") != "") & F.when((F.length(F.col("s")) <= 60) & ~F.col("prose"), True).otherwise(data)
    event = F.when(caption, 1).when(~dropped & (F.col("s") != ""), 0)
    marked = lines.withColumns({"event": event, "dropped": dropped & ~caption})
    before = F.last("event", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    hit = F.col("dropped") & (F.coalesce(before, F.lit(0)) == 1)
    return _with_actions(marked, ~hit, F.when(caption, kept).otherwise(F.col("line")), _one(hit, F.col("s"))).drop("event", "dropped")


@_line_rule
def formula_lines(lines: DataFrame) -> DataFrame:
    dense = F.when(F.length(F.col("s")) <= 120, symbol_density(F.col("s")) > 0.55).otherwise(False)
    hit = (F.col("s") != "") & (dense | F.when(F.length(F.col("s")) <= 200, F.col("s").rlike(NUMBERS)).otherwise(False))
    return _with_actions(lines, ~hit, F.col("line"), _one(hit, F.col("s")))


LINE_RULES = {f.__name__: f for f in (typesetter_stamps, proof_notices, running_headers, headings, page_numbers, figures_tables, formula_lines)}


def apply_line_rule(lines: DataFrame, rule: str) -> DataFrame:
    """Lines left by one rule."""
    return LINE_RULES[rule](lines).where("keep").select("doc_id", "line_no", F.col("out").alias("line"))


# --- rules on whole texts ------------------------------------------------------------------------


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}|\t", " "), r" ++\n *|\n +", "\n")


# a hundred texts at a time: what a worker holds doesn't grow with the partition
@F.udf(T.StringType(), useArrow=False)
def nfkc(t):
    import unicodedata

    return None if t is None else unicodedata.normalize("NFKC", t)


def unicode(text: Column) -> Column:
    """Superscript digits go, typographic characters become plain, compatibility forms are folded, control characters go, spaces collapse."""
    t = F.regexp_replace(replace_characters(text, dict.fromkeys(SUPERSCRIPTS, "") | dict(CHARACTERS)), r"[\p{Cc}\p{Cf}&&[^\t\n]]", "")
    # Python sees only texts with characters that may change; both readings of t cost less than sending it
    folded = nfkc(F.when(text.rlike(f"(?=[^\\x00-\\x7f])(?=[^À-ı])[^{NORMAL}{SUPERSCRIPTS}{''.join(c for c, _ in CHARACTERS)}]"), t))
    return collapse_spaces(F.coalesce(folded, t))


def footnote_markers(text: Column) -> Column:
    return F.regexp_replace(text, FOOTNOTE, "$1")


def citations(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, CITATION_NUMBERS, ""), CITATION_AUTHORS, "")


def urls(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, URL, ""), ISBN, "")


def _greek() -> list[str]:
    """How the characters U+0370 to U+03FF are read: the last words of their names, nothing for those without one."""
    import unicodedata

    return [f" {n.split()[-1].lower()} " if (n := unicodedata.name(c, "")) else "" for c in map(chr, range(0x370, 0x400))]


def symbols(text: Column) -> Column:
    return replace_characters(text, dict(SYMBOLS) | dict(zip(map(chr, range(0x370, 0x400)), _greek(), strict=True)))


def _longest_first(xs: list[str]) -> str:
    return "|".join(sorted(xs, key=len, reverse=True))


def _by_initial(xs: list[str]) -> str:
    """The same choice, the first letters tried once each."""
    return "|".join(f"{c}(?:{_longest_first([x[1:] for x in xs if x[0] == c])})" for c in sorted({x[0] for x in xs}))


def _compound(tails: list[str]) -> str:
    heads, ends = _longest_first(COMPOUND_HEADS), _longest_first(tails)
    first = "".join(sorted({x[0] for x in COMPOUND_HEADS}))
    # İ, ı and ſ are letters i and s, whatever their case
    starts = rf"(?=[{first}{first.upper()}İıſ])(?<![A-Za-z0-9_])"
    return starts + rf"(?Uiu)\b(?=(?:{_by_initial(COMPOUND_HEADS)})(?:{_by_initial(tails)})\b)(?!(?:{'|'.join(COMPOUND_WORDS)})\b)({heads})({ends})\b"


_COMPOUND = _compound(COMPOUND_HYPHEN + COMPOUND_SPACE)


def broken_compounds(text: Column) -> Column:
    for joiner, tails in (("-", COMPOUND_HYPHEN), (" ", COMPOUND_SPACE)):
        text = F.regexp_replace(text, _compound(tails), f"$1{joiner}$2")
    return text


def dot_letters(text: Column) -> Column:
    """J.R.R. becomes J R R: the dot goes after the last letter of a run, others become spaces."""
    return replace_found(text, DOT_LETTERS, _spaced)


def _spaced(run: Column) -> Column:
    return F.replace(F.rtrim(run, F.lit(".")), F.lit("."), F.lit(" "))


def tidy(text: Column) -> Column:
    t = F.when(F.contains(text, F.lit("  ")) | F.contains(text, F.lit("\t")), F.regexp_replace(text, r"[ \t]{2,}", " ")).otherwise(text)
    t = F.regexp_replace(t, r" ([.,!?;:])", "$1")
    t = F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)
    return strip(F.array_join(F.transform(F.split(t, "\n", -1), strip), "\n"))


_CLOSING = "\"')]}"


def _ends_open(end: str) -> bool:
    return not end.rstrip(_CLOSING).endswith((".", "!", "?", "…")) and not end.endswith(":")


class _Growing:
    """A line or paragraph that is put together: its parts, its length and its last ``TOLD_CHARS`` characters."""

    def __init__(self, text: str) -> None:
        self.parts, self.size, self.tail = [text], len(text), text[-TOLD_CHARS:]

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)
        self.tail = (self.tail + text)[-TOLD_CHARS:]

    def goes_on_with(self, x: str) -> bool:
        """Whether ``x`` continues it: after a hyphen always, else if it is 25 characters or more and ends openly, and ``x`` starts in lower case."""
        if self.tail.endswith("-"):
            return True
        low = x[:1].islower() or (x[:1] in ("\"", "'", "(") and x[1:2].islower())
        return low and self.size >= 25 and _ends_open(self.tail if self.tail.strip(_CLOSING) else "".join(self.parts))

    def join(self, x: str) -> None:
        """Adds ``x``; a hyphen before a small letter goes, other lines are a space apart."""
        if not self.tail.endswith("-"):
            x = " " + x
        elif x[:1].islower():
            # what stands before the hyphen may lie in an earlier part, so the tail is that of the last parts
            self.parts[-1] = self.parts[-1][:-1]
            self.size -= 1
            self.tail = self._end()
        self.add(x)

    def _end(self) -> str:
        out = ""
        for part in reversed(self.parts):
            out = part[-TOLD_CHARS:] + out
            if len(out) >= TOLD_CHARS:
                break
        return out[-TOLD_CHARS:]


def _reflowed(text: str) -> tuple[str, list[str]]:
    """The text with its lines rejoined, and forty characters from both sides of each joint: first those within paragraphs, then those between them.

    A line is held against all of its paragraph so far.  Paragraphs are then held against the last line before them.
    """
    told, between, out = [], [], []  # out: finished lines, "" between paragraphs
    open_: _Growing | None = None  # the last line, which may go on
    lines = [x.strip() for x in text.split("\n")]
    for blank, block in groupby(lines, key=lambda x: not x):
        if blank:
            continue
        first, *rest = block
        whole, rows = _Growing(first), [_Growing(first)]
        for x in rest:
            if whole.goes_on_with(x):
                told.append(f"…{whole.tail} + {x[:TOLD_CHARS]}…")
                whole.join(x)
                rows[-1].join(x)
            else:
                whole.add("\n" + x)
                rows.append(_Growing(x))
        made = ["".join(r.parts) for r in rows]
        if open_ is not None and open_.goes_on_with(made[0]):
            between.append(f"…{open_.tail} + {made[0][:TOLD_CHARS]}…")
            open_.join(made[0])
            made = made[1:]
        else:
            if open_ is not None:
                out += ["".join(open_.parts), ""]
            open_, made = _Growing(made[0]), made[1:]
        for x in made:
            out.append("".join(open_.parts))
            open_ = _Growing(x)
    if open_ is not None:
        out.append("".join(open_.parts))
    return "\n".join(out), told + between


@F.udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("told", T.ArrayType(T.StringType()))]), useArrow=False)
def _rejoined(t):
    return (None, None) if t is None else _reflowed(t)


def rejoined(text: Column) -> Column:
    """struct<text,told>: wrapped lines rejoined in paragraphs, then sentences cut by a page break between paragraphs, and what was joined to what."""
    return _rejoined(text)


def reflow(text: Column) -> Column:
    return rejoined(text)["text"]


TEXT_RULES = {f.__name__: f for f in (footnote_markers, citations, urls, symbols, broken_compounds, dot_letters)}

# --- what the rules on texts remove, each from the text it is given --------------------------------


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _arrow(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" -> "), b)


def _unicode_told(before: Column, after: Column) -> Column:
    digits = F.transform(_all(before, f"[{SUPERSCRIPTS}]+"), lambda x: F.concat(F.lit("superscript '"), x, F.lit("'")))
    return F.when(F.size(digits) > 0, digits).when(before != after, F.array(F.lit("folded quotes, dashes and spacing"))).otherwise(_none())


def _symbols_told(text: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(f"{a} -> {b.strip() or '(removed)'}").alias("t")) for a, b in SYMBOLS])
    named = F.array(*[F.lit(n.strip()) for n in _greek()])
    greek = F.transform(_all(text, "[Ͱ-Ͽ]"), lambda c: _arrow(c, F.get(named, F.ascii(c) - 0x370)))
    return F.concat(F.transform(F.filter(pairs, lambda p: F.contains(text, p["a"])), lambda p: p["t"]), F.filter(greek, lambda t: ~t.endswith("> ")))


@dataclass(frozen=True)
class _Pass:
    """A rule on texts, or a part of one: matches of ``pattern`` become what ``how`` makes of them, nothing without it; ``told`` tells of one.  Texts without ``sign`` have none."""

    rule: str
    pattern: str
    how: Callable[[Column], Column] | None = None
    told: Callable[[Column], Column] = lambda m: m
    sign: str | None = None

    def found(self, text: Column) -> Column:
        matches = _all(text, self.pattern)
        return F.when(F.contains(text, F.lit(self.sign)), matches) if self.sign else matches

    def text(self, text: Column, found: Column) -> Column:
        return replace_found(text, self.pattern, self.how, found) if self.how else F.regexp_replace(text, self.pattern, "")


#: What the functions of ``TEXT_RULES`` do, in their order, a pattern at a time; symbols are looked up instead.
_PASSES = (
    _Pass("footnote_markers", FOOTNOTE, lambda m: F.substring(m, 1, 1), lambda m: F.concat(F.lit("…"), m)),
    _Pass("citations", CITATION_NUMBERS, sign="["),
    _Pass("citations", CITATION_AUTHORS, sign="("),
    _Pass("urls", URL),
    _Pass("urls", ISBN, sign="ISBN"),
    "symbols",
    _Pass("broken_compounds", _COMPOUND, broken_compounds, lambda w: _arrow(w, broken_compounds(w))),
    _Pass("dot_letters", DOT_LETTERS, _spaced, lambda m: _arrow(m, _spaced(m))),
)


def _substituted(text: Column, pairs: Column) -> Column:
    """struct<text,told>: as ``substitutions``, with one line for each entry that was found."""
    inner = lambda s: F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    quoted = lambda s: F.concat(F.lit("(?Uiu)(?=\\Q"), inner(s), F.lit("\\E)\\b\\Q"), inner(s), F.lit("\\E\\b"))
    literal = lambda s: F.regexp_replace(s, r"([\\$])", r"\\$1")

    def step(a: Column, p: Column) -> Column:
        hit = (p["src"] != "") & F.regexp_like(a["text"], quoted(p["src"]))
        text_ = F.when(hit, F.regexp_replace(a["text"], quoted(p["src"]), literal(p["dst"]))).otherwise(a["text"])
        return F.struct(text_.alias("text"), F.when(hit, F.concat(a["told"], F.array(_arrow(p["src"], p["dst"])))).otherwise(a["told"]).alias("told"))

    return F.aggregate(pairs, F.struct(text.alias("text"), _none().alias("told")), step)


def substitutions(text: Column, pairs: Column) -> Column:
    """Whole words of ``pairs`` (ordered array<struct<src,dst>>) replaced whatever their case; empty ones are passed over."""
    return _substituted(text, pairs)["text"]


# --- the whole cleaning -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Cleaning:
    """What to apply: a preset, overrides by rule name and a dictionary of replacements."""

    preset: str | None = None
    overrides: dict[str, bool] | None = None
    dictionary: tuple[tuple[str, str], ...] = ()

    def rules(self) -> list[str]:
        chosen = set(PRESETS.get((self.preset or "textbook").lower(), RULES))
        for name, on in (self.overrides or {}).items():
            chosen = chosen | {name} if on else chosen - {name}
        return [r for r in RULES if r in chosen]

    def options(self) -> dict[str, Column]:
        pairs = [F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in self.dictionary]
        return {"rules": F.array(*map(F.lit, self.rules())).cast("array<string>"), "pairs": F.array(*pairs) if pairs else F.array().cast(_PAIRS)}


_PAIRS = "array<struct<src:string,dst:string>>"


def row_options(enabled: Column | None = None, preset: Column | None = None, overrides: Column | None = None, dictionary: Column | None = None) -> dict[str, Column]:
    """Options that differ from row to row: a switch, a preset, overrides (map<string,boolean>) and a dictionary (ordered array<struct<src,dst>>).

    Where the switch is off or null the text stays; a null preset is textbook, null overrides and dictionaries are empty.
    """
    rules = resolve_rules(preset if preset is not None else F.lit(None).cast("string"), overrides if overrides is not None else F.lit(None).cast("map<string,boolean>"))
    on = F.coalesce(enabled, F.lit(False)) if enabled is not None else F.lit(True)
    empty = F.array().cast(_PAIRS)
    return {"rules": F.when(on, rules).otherwise(F.array().cast("array<string>")), "pairs": F.coalesce(dictionary.cast(_PAIRS), empty) if dictionary is not None else empty}


def _on(rule: str) -> Column:
    return F.col("mask").bitwiseAND(F.lit(1 << RULES.index(rule))) != 0


def _tell(rule: str, samples: Column) -> Column:
    """The report so far (``told``) with what ``rule`` removed."""
    return F.concat("told", F.transform(samples, lambda x: F.struct(F.lit(RULES.index(rule)).alias("r"), x.alias("s"))))


def clean(docs: DataFrame, how: Cleaning | dict[str, Column] = Cleaning(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, report, chars_before, chars_after), one row for every row of ``docs``.

    ``how`` is one setting for all rows or ``row_options``.  Blank and null texts, and texts with no rule on, stay as they are
    and report nothing.  Rows are told apart by themselves, so ids may be null or repeated; the columns of ``docs`` other than the id,
    the text and those that options read are left out.  Texts are shuffled once.  ``report`` is an array of (rule, label, count, samples) of the rules that
    removed something, in the order of ``RULES``.
    """
    options = how.options() if isinstance(how, Cleaning) else how
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw"), options["rules"].alias("rules"), options["pairs"].alias("pairs"))
    rows = rows.withColumn("mask", sum((F.array_contains("rules", r).cast("int") * (1 << i) for i, r in enumerate(RULES)), F.lit(0)))
    rows = rows.withColumn("works", (F.col("mask") != 0) & (strip(F.coalesce("raw", F.lit(""))) != ""))
    nothing = F.array().cast("array<struct<r:int,s:string>>")
    work = rows.where("works").select(F.monotonically_increasing_id().alias("doc_id"), "id", "mask", "pairs", F.length("raw").alias("before"), "raw", F.when(_on("unicode"), unicode(F.col("raw"))).otherwise(F.col("raw")).alias("text"), nothing.alias("told"))
    work = work.withColumn("told", F.when(_on("unicode"), _tell("unicode", _unicode_told(F.col("raw"), F.col("text")))).otherwise(F.col("told"))).drop("raw")
    # one row a line; a line that goes stays as a row, to tell of it.  All that follows keeps to this partitioning by document.
    work = work.repartition("doc_id")
    kept = F.struct("id", "mask", "pairs", "before", F.col("told").alias("first")).alias("kept")
    lines = work.select("doc_id", "mask", kept, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.select("doc_id", "mask", F.when(F.col("line_no") == 0, F.col("kept")).alias("kept"), "line_no", "line", F.lit(False).alias("gone"), nothing.alias("told"))
    for name, rule in LINE_RULES.items():
        on = _on(name) & ~F.col("gone")
        acted = rule(lines.withColumn("was", F.col("line")).withColumn("line", F.when(on, F.col("line"))))
        here = _on(name) & ~F.col("gone")
        lines = acted.select("doc_id", "mask", "kept", "line_no", F.when(here & F.col("keep"), F.col("out")).otherwise(F.col("was")).alias("line"), (F.col("gone") | (here & ~F.col("keep"))).alias("gone"), F.when(here & (F.size("samples") > 0), _tell(name, F.col("samples"))).otherwise(F.col("told")).alias("told"))
    gathered = lines.groupBy("doc_id").agg(F.first("kept", ignorenulls=True).alias("kept"), F.array_sort(F.collect_list(F.struct("line_no", "gone", "line", "told"))).alias("ls"))
    work = gathered.select("kept.*", F.array_join(F.transform(F.filter("ls", lambda x: ~x["gone"]), lambda x: x["line"]), "\n").alias("text"), F.concat("kept.first", F.flatten(F.transform("ls", lambda x: x["told"]))).alias("told"))
    joined = work.withColumn("joined", F.when(_on("reflow"), rejoined(F.col("text"))))
    work = joined.withColumns({"text": F.when(_on("reflow"), F.col("joined.text")).otherwise(F.col("text")), "told": F.when(_on("reflow"), _tell("reflow", F.col("joined.told"))).otherwise(F.col("told"))}).drop("joined")
    # one projection a step: what a pattern finds serves the text and the report
    for step in _PASSES:
        if step == "symbols":
            work = work.withColumns({"text": F.when(_on(step), symbols(F.col("text"))).otherwise(F.col("text")), "told": F.when(_on(step), _tell(step, _symbols_told(F.col("text")))).otherwise(F.col("told"))})
            continue
        work = work.withColumn("found", F.when(_on(step.rule), step.found(F.col("text"))))
        some = F.col("found").isNotNull() & (F.size("found") > 0)
        work = work.withColumns({"text": F.when(some, step.text(F.col("text"), F.col("found"))).otherwise(F.col("text")), "told": F.when(some, _tell(step.rule, F.transform("found", step.told))).otherwise(F.col("told"))}).drop("found")
    work = work.withColumn("sub", F.when(_on("substitutions") & (F.size("pairs") > 0), _substituted(F.col("text"), F.col("pairs"))))
    work = work.withColumns({"text": tidy(F.coalesce("sub.text", "text")), "told": F.when(F.col("sub").isNull(), F.col("told")).otherwise(_tell("substitutions", F.col("sub.told")))})
    # a filter on the result stays above this projection: pushed through the steps it would repeat the text of each rule many times over
    cleaned = work.select("id", F.when(F.rand() >= 0, F.col("text")).alias("text"), report("told").alias("report"), "before")
    passed = rows.where("not works").select("id", F.col("raw").alias("text"), report(nothing).alias("report"), F.length("raw").alias("before"))
    return cleaned.unionByName(passed).select(F.col("id").alias("doc_id"), "text", "report", F.col("before").alias("chars_before"), F.length("text").alias("chars_after"))


def report(told: Column | str) -> Column:
    """array<struct<rule,label,count,samples>> of what rules removed, array<struct<r,s>>: the first samples that are not blank, white space collapsed, cut to size."""

    def short(x: Column) -> Column:
        x = strip(F.regexp_replace(x["s"], r"(?U)\s+", " "))
        return F.when(F.length(x) > SAMPLE_CHARS, F.concat(F.substring(x, 1, SAMPLE_CHARS - 1), F.lit("…"))).otherwise(x)

    found = F.array_distinct(F.transform(told, lambda x: x["r"]))
    names, labels = F.array(*map(F.lit, RULES)), F.array(*map(F.lit, LABELS.values()))

    def one(r: Column) -> Column:
        own = F.filter(told, lambda x: x["r"] == r)
        samples = F.slice(F.filter(F.transform(own, short), lambda s: s != ""), 1, MAX_SAMPLES)
        return F.struct(F.get(names, r).alias("rule"), F.get(labels, r).alias("label"), F.size(own).alias("count"), samples.alias("samples"))

    return F.transform(F.array_sort(found), one)


def report_json(row: Column) -> Column:
    """A cleaned row as JSON: text, chars_before, chars_after and report."""
    return F.to_json(row)
