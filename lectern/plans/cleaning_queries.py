"""Queries over the cleaning rules, with DuckDB equivalents.  What the tables lack is added to their texts alike on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import cleaning as C

QUERIES, SQL = {}, {}

# Lines added to each document, in an SQL that both engines read.
_ADDED = [
    "'ch0' || cast(doc_id % 9 as string) || '.indd  14'",
    "'12/13/2016 1:58:29 PM'",
    "'The Digest ' || cast(doc_id % 50 as string)",
    "'Chapter ' || cast(doc_id % 30 as string)",
    "'Se'",
    "'ok'",
    "'(' || cast(doc_id % 5000 + 1000 as string) || ')'",
    "'  A Look Ahead ' || cast(doc_id % 7 as string)",
    "'UNCORRECTED PAGE PROOFS NOT FOR RESALE OR DISTRIBUTION ' || cast(doc_id % 3 as string)",
    "'Figure 3.' || cast(doc_id % 4 as string) || ': Votes by region'",
    "'North 12 14 15.5'",
    "'Region'",
    "'Source: census'",
    "'This long sentence closes the block because it is prose that runs well over eighty characters in all.'",
    "'x = (a + b) / 2 * 3 - 4'",
    "'10 20 30 ' || cast(doc_id % 90 as string)",
    "'Short label'",
    "'The Digest ' || cast(doc_id % 50 + 1 as string)",
]
PAGE = "text || chr(10) || " + " || chr(10) || ".join(_ADDED)
#: Lines that the rules on texts find something in.
_MORE = [
    "'The lowincomes were high.' || cast(doc_id % 9 as string) || ' They rose [12] by 3 ≤ x (Smith et al., 2019) and'",
    "'more of “it” at https://a.b/c?d=' || cast(doc_id as string) || ' as J.R.R. Tolkien wrote of the gdp and α¹² in ﬁne inter-'",
    "'national print.'",
]
WHOLE_PAGE = PAGE + " || chr(10) || chr(10) || " + " || chr(10) || ".join(_MORE)


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(PAGE).alias("text"))


def whole_pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(WHOLE_PAGE).alias("text"))


# --- DuckDB: rules on lines -----------------------------------------------------------------------
_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CAP = r"'(?i)^\s*((?:figure|fig\.?|table|chart|exhibit|plate|box|diagram|graph)\s*[0-9ivxlc]+(?:[.\-][0-9]+)*)\s*[:.\-]?\s*(.*)$'"
_HEAD = r"'(?i)^(chapter|part|section|appendix|book|volume|unit|lesson|epilogue|prologue|preface|foreword|introduction|conclusion|afterword|glossary|index)\b[\s:.\-]*([0-9]{1,3}|[ivxlcdm]{1,7})?\s*$'"
_SOURCE = r"'(?i)^\s*(source|sources|note|notes|adapted from|reprinted from|credit)\s*[:.]'"
_NUMBERS = r"'^[^A-Za-z]*(?:[-+]?[\d.,%$()]+[\s|\t]+){2,}[-+]?[\d.,%$()]+[^A-Za-z]*$'"


def _prose(c: str) -> str:
    return f"regexp_matches({c}, '[.!?…][\"'')\\]}}]*$')"


#: For each rule on lines: what it needs besides s, prose, density and numbers, in steps, then keep, out and told (what it removed).
_LINE_SQL = {
    "typesetter_stamps": (
        [r"regexp_matches(s, '(?i)^\S*\.(?:indd|qxd|qxp|fm|dvi)\b.*$') OR regexp_matches(s, '^\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:[AaPp]\.?[Mm]\.?)?$') OR regexp_matches(s, '^\d{1,2}:\d{2}(?::\d{2})?\s*(?:[AaPp]\.?[Mm]\.?)?$') AS hit"],
        "NOT hit", "line", "CASE WHEN hit THEN [s] ELSE [] END",
    ),
    "proof_notices": (
        [r"regexp_extract(s, '[A-Z][A-Z''\-]+(?:[\s,.\-]+[A-Z][A-Z''\-]+){4,}\b') AS run", "length(run) >= 30 AS hit, " + _STRIPPED.format("substr(s, 1, strpos(s, run) - 1) || ' ' || substr(s, strpos(s, run) + length(run))") + " AS rest", f"hit AND (rest = '' OR (length(rest) < 40 AND NOT {_prose('rest')})) AS gone"],
        "NOT gone", "CASE WHEN s = '' THEN line WHEN hit THEN rest ELSE s END", "CASE WHEN gone AND rest <> '' THEN [run, rest] WHEN hit THEN [run] ELSE [] END",
    ),
    "running_headers": (
        [r"CASE WHEN s <> '' AND length(s) <= 100 AND NOT prose THEN trim(regexp_replace(regexp_replace(lower(s), '\d+', '#', 'g'), '[^a-z#]+', ' ', 'g')) END AS sig", "count(sig) OVER (PARTITION BY doc_id, sig) AS same", "sig IS NOT NULL AND ((sig <> '' AND same >= 2) OR (length(s) <= 3 AND lower(s) NOT IN ('i', 'a', 'no', 'ok', 'so'))) AS hit"],
        "NOT hit", "line", "CASE WHEN hit THEN [s] ELSE [] END",
    ),
    "headings": ([f"s <> '' AND length(s) <= 60 AND NOT prose AND regexp_matches(s, {_HEAD}) AS hit, regexp_replace(s, '[ .:-]+$', '') || '.' AS fixed"], "true", "CASE WHEN hit THEN fixed ELSE line END", "CASE WHEN hit THEN [s || ' -> ' || fixed] ELSE [] END"),
    "page_numbers": (
        [r"s <> '' AND regexp_matches(s, '^[\[(]?(?:[0-9]{1,4}|[ivxlcdmIVXLCDM]{1,7})[\])]?$') AS gone, regexp_replace(s, '\s+\d{1,4}\s*$', '') AS cut", "NOT gone AND s <> '' AND length(s) <= 60 AND NOT prose AND cut <> s AND cut <> '' AS trimmed"],
        "NOT gone", "CASE WHEN s = '' THEN line WHEN trimmed THEN cut ELSE s END", "CASE WHEN gone OR trimmed THEN [s] ELSE [] END",
    ),
    "figures_tables": (
        [f"s <> '' AND regexp_matches(s, {_CAP}) AS caption, s <> '' AND (regexp_matches(s, {_SOURCE}) OR numbers OR density > 0.4 OR (length(s) <= 60 AND NOT prose)) AS dropped", "last_value(CASE WHEN caption THEN 1 WHEN NOT dropped AND s <> '' THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st", "dropped AND NOT caption AND coalesce(st, 0) = 1 AS hit"],
        "NOT hit", f"CASE WHEN caption THEN regexp_extract(s, {_CAP}, 1) || '.' || CASE WHEN trim(regexp_extract(s, {_CAP}, 2)) = '' THEN '' ELSE ' ' || trim(regexp_extract(s, {_CAP}, 2)) END ELSE line END", "CASE WHEN hit THEN [s] ELSE [] END",
    ),
    "formula_lines": (["s <> '' AND ((length(s) <= 120 AND density > 0.55) OR (numbers AND length(s) <= 200)) AS hit"], "NOT hit", "line", "CASE WHEN hit THEN [s] ELSE [] END"),
}


def _split_sql(text: str, source: str = "documents") -> str:
    return f"SELECT doc_id, unnest(ls) AS line, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no FROM (SELECT doc_id, string_split({text}, chr(10)) AS ls FROM {source})"


def _rule_sql(rule: str, source: str) -> list[str]:
    """The tables that lead from ``source`` (doc_id, line_no, line) to x_rule (doc_id, line_no, keep, out, told) and k_rule, the lines left."""
    steps, keep, out, told = _LINE_SQL[rule]
    made = [
        f"l_{rule} AS (SELECT doc_id, line_no, line, {_STRIPPED.format('line')} AS s FROM {source})",
        rf"q_{rule} AS (SELECT *, {_prose('s')} AS prose, length(regexp_replace(s, '\s', '', 'g')) AS solid, length(regexp_replace(s, '[^\pL]', '', 'g')) AS letters FROM l_{rule})",
        f"d_{rule}0 AS (SELECT *, CASE WHEN solid = 0 THEN 0.0 ELSE 1.0 - CAST(letters AS DOUBLE) / solid END AS density, regexp_matches(s, {_NUMBERS}) AS numbers FROM q_{rule})",
    ]
    made += [f"d_{rule}{i} AS (SELECT *, {step} FROM d_{rule}{i - 1})" for i, step in enumerate(steps, 1)]
    made.append(f"x_{rule} AS (SELECT doc_id, line_no, {keep} AS keep, {out} AS out, CAST({told} AS VARCHAR[]) AS told FROM d_{rule}{len(steps)})")
    made.append(f"k_{rule} AS (SELECT doc_id, line_no, out AS line FROM x_{rule} WHERE keep)")
    return made


def _line_query(number: str, rule: str) -> None:
    def query(spark, sf_dir):
        out = C.LINE_RULES[rule](C.to_lines(pages(spark, sf_dir)))
        return out.where("keep").select("doc_id", "line_no", F.col("out").alias("line"))

    QUERIES[f"{number}_{rule}"] = query
    SQL[f"{number}_{rule}"] = "WITH p AS (" + _split_sql(PAGE) + "), " + ", ".join(_rule_sql(rule, "p")) + f" SELECT doc_id, line_no, line FROM k_{rule}"


for _number, _rule in (("c02", "typesetter_stamps"), ("c03", "proof_notices"), ("c04", "running_headers"), ("c05", "headings"), ("c06", "page_numbers"), ("c07", "figures_tables"), ("c08", "formula_lines")):
    _line_query(_number, _rule)

# --- DuckDB: rules on texts -----------------------------------------------------------------------


def _replaced(expr: str, pairs: list[tuple[str, str]]) -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\f", "' || chr(12) || '") + "'"

    for a, b in pairs:
        expr = f"replace({expr}, {quoted(a)}, {quoted(b)})"
    return expr


_SUP = f"'[{C.SUPERSCRIPTS}]+'"
_NUM = r"'\s*\[\s*\d+(?:\s*[,\-–]\s*\d+)*\s*\]'"
_AUTH = r"'\s*\((?:see\s+)?(?:e\.g\.,?\s*)?[A-Z][A-Za-z''\-]+(?:\s+(?:et\s+al\.?|and|&|,)\s*[A-Z]?[A-Za-z''\-]*)*,?\s*\d{4}[a-z]?(?:\s*[;,]\s*[^()]{0,40}?\d{4}[a-z]?)*\s*\)'"
_LINK = r"'(?i)(?:\b(?:at|from|via|on)\s+)?(?:\b(?:https?://|www\.)\S+|\bdoi:\s*\S+|\b10\.\d{4,}/\S+)'"
_BOOK = r"'\bISBN[- ]?(?:13|10)?:?\s*[\d\-Xx]{10,17}\b'"
_FOOT = "'([A-Za-z)\\]\"''])([.!?,;:])(\\d{1,3})(\\s|$)'"
_HEADS, _HY, _SP = C._longest_first(C.COMPOUND_HEADS), C._longest_first(C.COMPOUND_HYPHEN), "|".join(C.COMPOUND_SPACE)
_TAILS = C._longest_first(C.COMPOUND_HYPHEN + C.COMPOUND_SPACE)
_GREEK = "[" + ", ".join(f"'{n}'" for n in C._greek()) + "]"


def _spaced(n: int) -> str:
    """A run of ``n`` dotted capitals, and how it is read."""
    return r"'\b" + r"([A-Z])\." * n + r"(\s|$|[,;:])', '" + " ".join(f"\\{i}" for i in range(1, n + 1)) + f"\\{n + 1}'"


def _dotted(t: str) -> str:
    for n in range(8, 1, -1):
        t = f"regexp_replace({t}, {_spaced(n)}, 'g')"
    return t


def _compounded(t: str) -> str:
    return rf"regexp_replace(regexp_replace({t}, '(?i)\b({_HEADS})({_HY})\b', '\1-\2', 'g'), '(?i)\b({_HEADS})({_SP})\b', '\1 \2', 'g')"


def _symbols_told(t: str) -> str:
    found = ", ".join(f"CASE WHEN contains({t}, '{a}') THEN '{a} -> {b.strip() or '(removed)'}' END" for a, b in C.SYMBOLS)
    return f"list_filter([{found}], lambda x: x IS NOT NULL) || list_filter(list_transform(regexp_extract_all({t}, '[Ͱ-Ͽ]'), lambda c: c || ' -> ' || trim({_GREEK}[unicode(c) - 879])), lambda x: NOT x LIKE '%> ')"


#: For each rule on texts: the text it makes of t, and what it removes from t.
_TEXT_SQL = {
    "footnote_markers": (lambda t: rf"regexp_replace({t}, {_FOOT}, '\1\2\4', 'g')", lambda t: rf"list_transform(regexp_extract_all({t}, {_FOOT}), lambda m: '…' || regexp_extract(m, '[.!?,;:]\d+'))"),
    "citations": (lambda t: f"regexp_replace(regexp_replace({t}, {_NUM}, '', 'g'), {_AUTH}, '', 'g')", lambda t: f"regexp_extract_all({t}, {_NUM}) || regexp_extract_all(regexp_replace({t}, {_NUM}, '', 'g'), {_AUTH})"),
    "urls": (lambda t: f"regexp_replace(regexp_replace({t}, {_LINK}, '', 'g'), {_BOOK}, '', 'g')", lambda t: f"regexp_extract_all({t}, {_LINK}) || regexp_extract_all(regexp_replace({t}, {_LINK}, '', 'g'), {_BOOK})"),
    "symbols": (lambda t: f"array_to_string(list_transform(regexp_extract_all({_replaced(t, C.SYMBOLS)}, '(?s)[Ͱ-Ͽ]|[^Ͱ-Ͽ]+'), lambda c: CASE WHEN regexp_full_match(c, '[Ͱ-Ͽ]') THEN {_GREEK}[unicode(c) - 879] ELSE c END), '')", _symbols_told),
    "broken_compounds": (_compounded, lambda t: rf"list_transform(regexp_extract_all({t}, '(?i)\b(?:{_HEADS})(?:{_TAILS})\b'), lambda w: w || ' -> ' || {_compounded('w')})"),
    "dot_letters": (_dotted, lambda t: rf"list_transform(regexp_extract_all({t}, '\b((?:[A-Z]\.){{2,}})(?:\s|$|[,;:])', 1), lambda m: m || ' -> ' || array_to_string(regexp_extract_all(m, '[A-Z]'), ' '))"),
}


def _unicode_sql(t: str) -> str:
    plain = _replaced(f"regexp_replace({t}, {_SUP}, '', 'g')", C.CHARACTERS)
    return rf"regexp_replace(regexp_replace(nfc_normalize(regexp_replace({plain}, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g')), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g')"


def _tidy_sql(t: str) -> str:
    one = rf"regexp_replace(regexp_replace(regexp_replace({t}, '[ \t]{{2,}}', ' ', 'g'), ' ([.,!?;:])', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"trim(array_to_string(list_transform(string_split({one}, chr(10)), lambda x: {_STRIPPED.format('x')}), chr(10)), chr(10) || ' ')"


def _goes_on(p: str, x: str) -> str:
    return f"({p} LIKE '%-' OR (NOT {_prose(p)} AND NOT {p} LIKE '%:' AND length({p}) >= 25 AND regexp_matches({x}, '^[\"''(]?\\p{{Ll}}')))"


def _join_sql(p: str, x: str) -> str:
    return f"CASE WHEN {p} LIKE '%-' THEN CASE WHEN regexp_matches({x}, '^\\p{{Ll}}') THEN left({p}, length({p}) - 1) ELSE {p} END ELSE {p} || ' ' END || {x}"


def _seamed_sql(t: str) -> str:
    """A struct of the text with wrapped lines rejoined (t) and what was joined to what (n): within paragraphs first, then between them."""
    note = lambda p, x: f"['…' || right({p}, 40) || ' + ' || left({x}, 40) || '…']"
    first = "list_transform(ls, lambda x: {'t': x, 'n': CAST([] AS VARCHAR[])})"
    block = f"list_reduce({first}, lambda a, x: CASE WHEN {_goes_on('a.t', 'x.t')} THEN {{'t': {_join_sql('a.t', 'x.t')}, 'n': a.n || {note('a.t', 'x.t')}}} ELSE {{'t': a.t || chr(10) || x.t, 'n': a.n}} END)"
    split = f"list_transform(string_split_regex({t}, '\\n\\s*\\n+'), lambda b: list_filter(list_transform(string_split(b, chr(10)), lambda x: {_STRIPPED.format('x')}), lambda x: x <> ''))"
    blocks = f"list_transform(list_filter({split}, lambda ls: len(ls) > 0), lambda ls: {block})"
    tail, head = r"regexp_extract(a.t, '[^\n]*$')", r"regexp_extract(b.t, '^[^\n]*')"
    start = "list_transform(bs, lambda b: {'t': b.t, 'n': b.n, 'o': CAST([] AS VARCHAR[])})"
    outer = f"list_reduce({start}, lambda a, b: CASE WHEN {_goes_on(tail, head)} THEN {{'t': left(a.t, length(a.t) - length({tail})) || {_join_sql(tail, head)} || substr(b.t, length({head}) + 1), 'n': a.n || b.n, 'o': a.o || {note(tail, head)}}} ELSE {{'t': a.t || chr(10) || chr(10) || b.t, 'n': a.n || b.n, 'o': a.o}} END)"
    return f"(SELECT CASE WHEN len(bs) = 0 THEN {{'t': '', 'n': CAST([] AS VARCHAR[])}} ELSE {{'t': r.t, 'n': r.n || r.o}} END FROM (SELECT bs, CASE WHEN len(bs) > 0 THEN {outer} END AS r FROM (SELECT {blocks} AS bs)))"


def _cleaned_sql() -> list[str]:
    """Tables from the whole pages to t_end (doc_id, t) and told (doc_id, rule, line_no, told)."""
    made = [f"raw AS (SELECT doc_id, {WHOLE_PAGE} AS t FROM documents)", f"uni AS (SELECT doc_id, t AS was, {_unicode_sql('t')} AS t FROM raw)", "p AS (" + _split_sql("t", "uni") + ")"]
    source = "p"
    for rule in C.LINE_RULES:
        made += _rule_sql(rule, source)
        source = f"k_{rule}"
    made.append(f"j AS (SELECT u.doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no), '') AS t FROM uni u LEFT JOIN {source} k ON k.doc_id = u.doc_id GROUP BY u.doc_id)")
    made.append(f"seam AS (SELECT doc_id, {_seamed_sql('t')} AS m FROM j)")
    made.append("t_0 AS (SELECT doc_id, m.t AS t FROM seam)")
    for i, rule in enumerate(C.TEXT_RULES, 1):
        made.append(f"t_{i} AS (SELECT doc_id, {_TEXT_SQL[rule][0]('t')} AS t FROM t_{i - 1})")
    spoken = r"regexp_replace(t, '(?i)\bGDP\b', 'G D P', 'g')"
    made.append(f"t_end AS (SELECT doc_id, t AS before, {_tidy_sql(spoken)} AS t FROM t_{len(C.TEXT_RULES)})")
    folded = f"list_transform(regexp_extract_all(was, {_SUP}), lambda x: 'superscript ''' || x || '''')"
    told = [f"SELECT doc_id, 'unicode' AS rule, 0 AS line_no, CASE WHEN len({folded}) > 0 THEN {folded} WHEN was <> t THEN ['folded quotes, dashes and spacing'] ELSE [] END AS told FROM uni"]
    told += [f"SELECT doc_id, '{rule}', line_no, told FROM x_{rule}" for rule in C.LINE_RULES]
    told.append("SELECT doc_id, 'reflow', 0, m.n FROM seam")
    told += [f"SELECT doc_id, '{rule}', 0, {_TEXT_SQL[rule][1]('t')} FROM t_{i}" for i, rule in enumerate(C.TEXT_RULES)]
    told.append(r"SELECT doc_id, 'substitutions', 0, CASE WHEN regexp_matches(before, '(?i)\bGDP\b') THEN ['GDP -> G D P'] ELSE [] END FROM t_end")
    return [*made, "told AS (" + " UNION ALL ".join(told) + ")"]


def _text_query(name: str, added: str, rule, sql: str) -> None:
    def query(spark, sf_dir):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return docs.select("doc_id", rule(F.expr(f"text || {added}")).alias("text"))

    QUERIES[name] = query
    SQL[name] = f"SELECT doc_id, {sql} AS text FROM (SELECT doc_id, text || {added} AS t FROM documents)"


_DICTIONARY = (("GDP", "G D P"),)
_WORDS = lambda: F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in (("GDP", "G D P"), ("", "no"), ("the", r"a \ $1"))])
_text_query("c01_unicode", "' “Quoted”—dash… ﬁne¹² it’s' || chr(9) || '  x  ' || chr(10) || ' y•z'", C.unicode, _unicode_sql("t"))
_text_query("c10_footnote_markers", "' credits.2 In (a).' || cast(doc_id % 1200 as string) || ' To 39.6 x,3'", C.footnote_markers, _TEXT_SQL["footnote_markers"][0]("t"))
_text_query("c11_citations", "' shown [12], [1, 3-5] and (see Smith et al., 2019; Doe, 2020b) or (Lee 1999).'", C.citations, _TEXT_SQL["citations"][0]("t"))
_text_query("c12_urls", "' available at https://a.b/c?d=' || cast(doc_id as string) || ' and via www.x.org, DOI: 10.1/x or 10.1000/182 ISBN 978-0-306-40615-7.'", C.urls, _TEXT_SQL["urls"][0]("t"))
_text_query("c13_symbols", "' 3 ≤ x ≠ y → z ½ © 5° αΩ µ'", C.symbols, _TEXT_SQL["symbols"][0]("t"))
_text_query("c14_broken_compounds", "' upperincome lowincomes longterm Highwage taxbrackets middleand wellto'", C.broken_compounds, _compounded("t"))
_text_query("c15_dot_letters", "' by J.R.R. Tolkien, U.S., no U.S.x and A.B.'", C.dot_letters, _dotted("t"))
_text_query("c16_substitutions", "' the gdp of GDPs, a+b and $x'", lambda c: C.substitutions(c, _WORDS()), r"regexp_replace(regexp_replace(t, '(?i)\bGDP\b', 'G D P', 'g'), '(?i)\bthe\b', 'a \\ $1', 'g')")
_text_query("p02_tidy", "'  x ,y  .' || chr(10) || chr(10) || chr(10) || chr(10) || '  z  '", C.tidy, _tidy_sql("t"))


def c17_prose(spark, sf_dir):
    lines = C.to_lines(pages(spark, sf_dir))
    return lines.groupBy("doc_id").agg(F.count_if(C.is_prose(F.col("line"))).alias("n_prose"), F.count("*").alias("n_lines"))


QUERIES["c17_prose"] = c17_prose
SQL["c17_prose"] = "WITH p AS (" + _split_sql(PAGE) + "), d AS (SELECT doc_id, " + _prose(_STRIPPED.format("line")) + " AS prose FROM p) SELECT doc_id, count(*) FILTER (prose) AS n_prose, count(*) AS n_lines FROM d GROUP BY doc_id"


def c18_removal_report(spark, sf_dir):
    """What each of the sixteen rules removed from each page."""
    rows = C.clean(whole_pages(spark, sf_dir), C.Cleaning("textbook", None, _DICTIONARY)).select("doc_id", F.explode_outer("report").alias("r")).where("r is not null")
    return rows.select("doc_id", "r.rule", "r.label", "r.count", F.array_join("r.samples", "|").alias("samples"))


QUERIES["c18_removal_report"] = c18_removal_report
SQL["c18_removal_report"] = (
    "WITH "
    + ", ".join(_cleaned_sql())
    + ", e AS (SELECT doc_id, rule, line_no, unnest(told) AS s, unnest(range(len(told))) AS k FROM told), c AS (SELECT *, "
    + _STRIPPED.format(r"regexp_replace(s, '\s+', ' ', 'g')")
    + " AS x FROM e), n AS (SELECT doc_id, rule, count(*) AS count, list(CASE WHEN length(x) > 100 THEN left(x, 99) || '…' ELSE x END ORDER BY line_no, k) FILTER (x <> '') AS xs FROM c GROUP BY doc_id, rule) SELECT doc_id, rule, CASE rule "
    + " ".join(f"WHEN '{r}' THEN '{label}'" for r, label in C.LABELS.items())
    + " END AS label, CAST(count AS INTEGER) AS count, coalesce(array_to_string(xs[:6], '|'), '') AS samples FROM n"
)
_WRAPPED = "replace(replace(text, ', ', ',' || chr(10)), '? ', '?' || chr(10) || ' ' || chr(10))"


def c09_reflow(spark, sf_dir):
    """Wrapped lines; every document is wrapped at its commas first, and has a blank line after every question."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", C.reflow(F.expr(_WRAPPED)).alias("text"))


QUERIES["c09_reflow"] = c09_reflow
SQL["c09_reflow"] = f"SELECT doc_id, m.t AS text FROM (SELECT doc_id, {_seamed_sql('t')} AS m FROM (SELECT doc_id, {_WRAPPED} AS t FROM documents))"


def p01_resolve_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    preset = F.expr("CASE doc_id % 4 WHEN 0 THEN 'LIGHT' WHEN 1 THEN 'off' WHEN 2 THEN 'odd' END")
    over = F.create_map(F.lit("urls"), F.col("doc_id") % 3 == 0, F.lit("nonsense"), F.lit(True))
    return docs.select("doc_id", F.array_join(C.resolve_rules(preset, over), ",").alias("rules"))


QUERIES["p01_resolve_rules"] = p01_resolve_rules
_ALL = "[" + ", ".join(f"'{r}'" for r in C.RULES) + "]"
_LIGHT = "[" + ", ".join(f"'{r}'" for r in C.PRESETS["light"]) + "]"
SQL["p01_resolve_rules"] = f"""
SELECT doc_id, array_to_string(list_filter({_ALL}, lambda r: CASE WHEN r = 'urls' THEN doc_id % 3 = 0 WHEN doc_id % 4 = 0 THEN list_contains({_LIGHT}, r) ELSE doc_id % 4 <> 1 END), ',') AS rules FROM documents"""


def p03_clean(spark, sf_dir):
    """The whole cleaning of pages with everything added."""
    return C.clean(whole_pages(spark, sf_dir), C.Cleaning("textbook", {"figures_tables": True}, _DICTIONARY)).drop("report")


QUERIES["p03_clean"] = p03_clean
SQL["p03_clean"] = "WITH " + ", ".join(_cleaned_sql()) + " SELECT doc_id, t_end.t AS text, CAST(length(raw.t) AS INTEGER) AS chars_before, CAST(length(t_end.t) AS INTEGER) AS chars_after FROM t_end JOIN raw USING (doc_id)"


def p03_row_options(spark, sf_dir):
    """Cleaning with options of each row: off, only citations, or only the dictionary."""
    kind = F.col("doc_id") % 3
    only = lambda rule: F.map_from_arrays(F.array(*map(F.lit, C.RULES)), F.array(*[F.lit(r == rule) for r in C.RULES]))
    how = C.row_options(kind != 0, F.lit("off"), F.when(kind == 1, only("citations")).otherwise(only("substitutions")), F.array(F.struct(F.lit("GDP").alias("src"), F.lit("G D P").alias("dst"))))
    return C.clean(whole_pages(spark, sf_dir), how).select("doc_id", "text", F.coalesce(F.get("report", F.lit(0))["count"], F.lit(0)).alias("n"))


QUERIES["p03_row_options"] = p03_row_options
_GDP = r"regexp_replace(t, '(?i)\bGDP\b', 'G D P', 'g')"
SQL["p03_row_options"] = (
    f"WITH raw AS (SELECT doc_id, {WHOLE_PAGE} AS t FROM documents) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN t WHEN 1 THEN {_tidy_sql(_TEXT_SQL['citations'][0]('t'))} ELSE {_tidy_sql(_GDP)} END AS text, "
    f"CAST(CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN len({_TEXT_SQL['citations'][1]('t')}) ELSE 1 END AS INTEGER) AS n FROM raw"
)
