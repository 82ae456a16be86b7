"""Queries over jobs, subtitles, A/B runs, voices, settings, audio, sources and streams, with DuckDB equivalents."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import strip
from lectern.operators import abtest, audio, jobs, settings, subtitles, voices
from lectern.plans.cleaning_queries import QUERIES, SQL
from lectern.sources import extract
from lectern.streaming import events as streams


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- jobs: orders as jobs, their lines as chunks -----------------------------------------------
_CHUNKS = "SELECT l_orderkey AS job_id, l_linenumber - 1 AS index, CASE WHEN min(l_linestatus) = 'F' THEN 'done' ELSE 'pending' END AS status, CASE WHEN min(l_returnflag) <> 'A' THEN cast(min(l_quantity) as double) END AS duration, cast(min(l_quantity) as double) AS seconds FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _chunks(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("s"), F.min("l_returnflag").alias("r"), F.min("l_quantity").alias("q"))
    return line.select(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") - 1).alias("index"), F.when(F.col("s") == "F", "done").otherwise("pending").alias("status"), F.when(F.col("r") != "A", F.col("q")).alias("duration"), F.col("q").alias("seconds"))


@query(f"""WITH c AS ({_CHUNKS}) SELECT job_id, count(*) FILTER (status = 'done') AS done, count(*) AS total,
  CAST(sum(CASE WHEN status = 'done' THEN coalesce(duration, 0) ELSE 0 END) AS DOUBLE) AS audio_duration, coalesce(min(index) FILTER (status <> 'done'), count(*)) AS resume_index,
  count(*) FILTER (status = 'done') = count(*) AS complete FROM c GROUP BY job_id""")
def j01_job_summary(spark, sf_dir):
    return jobs.summarize(_chunks(spark, sf_dir))


@query(f"WITH c AS ({_CHUNKS}) SELECT job_id, index FROM c WHERE status = 'done' AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = job_id AND o_custkey % 3 = index % 3)")
def j03_done_with_files(spark, sf_dir):
    files = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.explode(F.expr("filter(sequence(0, 6), i -> i % 3 = o_custkey % 3)")).alias("index"))
    return jobs.done_with_files(_chunks(spark, sf_dir), files).select("job_id", "index")


@query(f"WITH c AS ({_CHUNKS}) SELECT job_id, count(*) AS total FROM c GROUP BY job_id HAVING count(*) FILTER (status = 'done') < count(*)")
def j04_unfinished(spark, sf_dir):
    return jobs.summarize(_chunks(spark, sf_dir)).where("not complete").select("job_id", "total")


@query(f"""WITH c AS ({_CHUNKS}), w AS (SELECT job_id, index, avg(greatest(seconds, 0)) OVER (PARTITION BY job_id ORDER BY index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS pace, 8 - row_number() OVER (PARTITION BY job_id ORDER BY index) AS lft FROM c)
SELECT job_id, index, round(pace, 9) AS pace, round(CASE WHEN lft > 0 THEN pace * lft END, 9) AS eta FROM w""")
def j05_eta(spark, sf_dir):
    out = jobs.eta(_chunks(spark, sf_dir).withColumn("total", F.lit(8)))
    return out.select("job_id", "index", F.round("pace", 9).alias("pace"), F.round("eta", 9).alias("eta"))


@query("SELECT user_id AS job_id, event_id % 5 AS index, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_id % 5")
def k02_latest_chunks(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 5).alias("index"), F.col("event_id").alias("ts"), "value")
    return jobs.latest_chunks(e).select("job_id", "index", "value")


_JOB = "CASE WHEN o_orderkey % 9 = 0 THEN '../etc' ELSE lpad(cast(o_orderkey as string), 8, '2') || '-' || lpad(cast(o_custkey as string), 6, '0') || '-0a1b2c' END"


@query(f"SELECT job_id, created_at FROM (SELECT {_JOB} AS job_id, o_totalprice * 1000 + o_orderkey AS created_at FROM orders) WHERE regexp_full_match(job_id, '[0-9]{{8}}-[0-9]{{6}}-[0-9a-f]{{6}}') ORDER BY created_at DESC LIMIT 50")
def s09_list_jobs(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.expr(_JOB).alias("job_id"), F.expr("o_totalprice * 1000 + o_orderkey").alias("created_at"))
    return jobs.list_jobs(rows)


@query(f"SELECT o_orderkey, regexp_full_match({_JOB}, '[0-9]{{8}}-[0-9]{{6}}-[0-9a-f]{{6}}') AS valid FROM orders")
def p06_job_id(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", jobs.is_job_id(F.expr(_JOB)).alias("valid"))


@query(f"""WITH c AS ({_CHUNKS}), w AS (SELECT job_id, index, job_id % 3 + row_number() OVER (PARTITION BY job_id ORDER BY index) AS done, avg(greatest(seconds, 0)) OVER (PARTITION BY job_id ORDER BY index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS pace FROM c)
SELECT job_id, index, done, round(CASE WHEN 9 - done > 0 THEN pace * (9 - done) END, 9) AS eta FROM w""")
def j06_tracker(spark, sf_dir):
    """Jobs resumed after none, one or two of nine chunks; some of the times are negative."""
    out = jobs.track(_chunks(spark, sf_dir).withColumns({"total": F.lit(9), "resumed": F.col("job_id") % 3}))
    return out.select("job_id", "index", "done", F.round("eta", 9).alias("eta"))


@query("SELECT o_orderkey, strftime(to_timestamp(epoch(o_orderdate) + o_orderkey % 86400) AT TIME ZONE 'UTC', '%Y%m%d-%H%M%S') || '-' || substr(md5(cast(o_orderkey AS VARCHAR)), 1, 6) AS job_id, 'running' AS status FROM orders")
def k03_create(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 86400).cast("double").alias("created_at"))
    return jobs.create(o, "o_orderkey").select("o_orderkey", "job_id", "status")


@query(f"""WITH c AS ({_CHUNKS}), s AS (SELECT job_id, count(*) FILTER (status = 'done') AS done, count(*) AS total, coalesce(min(index) FILTER (status <> 'done'), count(*)) AS resume_index,
  CAST(sum(CASE WHEN status = 'done' THEN coalesce(duration, 0) ELSE 0 END) AS DOUBLE) AS a FROM c GROUP BY job_id)
SELECT job_id, '{{"job_id":' || job_id || ',"done":' || done || ',"total":' || total || ',"audio_duration":' || a || ',"resume_index":' || resume_index || ',"complete":' || CASE WHEN done = total THEN 'true' ELSE 'false' END || '}}' AS detail FROM s""")
def k10_job_json(spark, sf_dir):
    return jobs.detail_json(jobs.summarize(_chunks(spark, sf_dir)))


# --- subtitles: conversations as jobs, turns as chunks -----------------------------------------
_DUR = "cast((conv_id * 7 + turn * 3) % 23 as double) / 2"


def _turns(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("index"), "text", F.expr(_DUR).alias("duration"))


def _plain(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


# sentences; those over 90 characters are packed from their clauses, chr(3) between what is packed
_LAST = r"regexp_extract(a, '[^\x03]*$')"
_PACKED = rf"string_split(list_reduce(string_split(regexp_replace(p, '([,;:])\s+', '\1' || chr(2), 'g'), chr(2)), lambda a, x: CASE WHEN {_LAST} <> '' AND length({_LAST} || ' ' || x) > 90 THEN a || chr(3) || x ELSE a || ' ' || x END), chr(3))"
_SPLIT = rf"list_filter(list_transform(string_split(regexp_replace({_plain('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_plain('x')}), lambda x: x <> '')"
_SENTENCES = f"""s AS (SELECT conv_id AS job_id, turn AS index, {_DUR} AS d, flatten(list_transform({_SPLIT}, lambda p: CASE WHEN length(p) <= 90 THEN [p] ELSE {_PACKED} END)) AS ps FROM conversations)"""
#: Spans of sentences with their share of the time, as doubles worked out in the order in which the operator does.
_SPANS = f"""{_SENTENCES},
c AS (SELECT *, coalesce(sum(greatest(d, 0)) OVER (PARTITION BY job_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM s),
u AS (SELECT job_id, index, d, s0, len(ps) AS n, unnest(ps) AS text, CAST(unnest(range(len(ps))) AS INTEGER) AS k FROM c WHERE d > 0),
v AS (SELECT *, length(text) AS own, sum(length(text)) OVER (PARTITION BY job_id, index ORDER BY k) AS chars, sum(length(text)) OVER (PARTITION BY job_id, index) AS total FROM u),
span AS (SELECT job_id, index, k, s0 + d * (CAST(chars - own AS DOUBLE) / CAST(total AS DOUBLE)) AS start, CASE WHEN k = n - 1 THEN s0 + d ELSE s0 + d * (CAST(chars AS DOUBLE) / CAST(total AS DOUBLE)) END AS stop, text FROM v)"""
_GROUPS = f"""{_SPANS},
o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY job_id ORDER BY index, k) = 1 OR stop - start >= 0.6 THEN 1 ELSE 0 END AS opens FROM span),
g AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY job_id ORDER BY index, k) AS BIGINT) AS g FROM o),
m AS (SELECT job_id, g, min(start) AS start, max(stop) AS stop, {_plain("string_agg(text, ' ' ORDER BY index, k)")} AS text FROM g GROUP BY job_id, g)"""


@query(f"WITH {_SENTENCES} SELECT job_id, index, CAST(unnest(range(len(ps))) AS INTEGER) AS k, unnest(ps) AS text FROM s")
def t01_sentences(spark, sf_dir):
    """Sentences of each turn, long ones packed from their clauses."""
    return _turns(spark, sf_dir).select("job_id", "index", F.posexplode(subtitles.split_sentences(F.col("text"))).alias("k", "text"))


@query(f"""WITH c AS (SELECT conv_id AS job_id, turn AS index, {_DUR} AS duration FROM conversations)
SELECT job_id, index, coalesce(sum(greatest(duration, 0)) OVER (PARTITION BY job_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c""")
def t03_clock(spark, sf_dir):
    return subtitles.clock(_turns(spark, sf_dir)).select("job_id", "index", "start")


@query(f'WITH {_SPANS} SELECT job_id, index, k, round(start, 6) AS start, round(stop, 6) AS "end", text FROM span')
def t02_apportion(spark, sf_dir):
    """All sentences of each turn."""
    out = subtitles.spans(subtitles.clock(_turns(spark, sf_dir)))
    return out.select("job_id", "index", "k", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text")


@query(f'WITH {_GROUPS} SELECT job_id, g, round(start, 6) AS start, round(stop, 6) AS "end", text FROM m')
def t04_merge_short(spark, sf_dir):
    out = subtitles.merge_short(subtitles.spans(subtitles.clock(_turns(spark, sf_dir))))
    return out.select("job_id", "g", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text")


def _long(spark, sf_dir):
    rows = subtitles.clock(_turns(spark, sf_dir)).where("duration > 0")
    return rows.select("job_id", F.col("index").alias("g"), "start", (F.col("start") + F.col("duration") * 2).alias("end"), strip(F.regexp_replace("text", r"\s+", " ")).alias("text"))


@query(f"""WITH c AS (SELECT conv_id AS job_id, turn AS g, {_DUR} AS duration, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations),
k AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY job_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c),
s AS (SELECT job_id, g, start, start + duration * 2 AS stop, text, string_split(text, ' ') AS w FROM k WHERE duration > 0),
h AS (SELECT *, CASE WHEN stop - start > 7 AND length(text) > 40 THEN greatest(2, CAST(floor((stop - start) / 7) AS INTEGER) + 1) ELSE 1 END AS parts FROM s),
p AS (SELECT *, greatest(1, len(w) // parts) AS per, unnest(range(parts)) AS part FROM h),
x AS (SELECT *, CASE WHEN parts = 1 THEN text ELSE array_to_string(CASE WHEN part = parts - 1 THEN w[part * per + 1:] ELSE w[part * per + 1:(part + 1) * per] END, ' ') END AS piece FROM p)
SELECT job_id, CAST(part AS INTEGER) AS part, g, round(start + part * ((stop - start) / parts), 6) AS start, round(start + (part + 1) * ((stop - start) / parts), 6) AS "end", piece AS text FROM x WHERE piece <> ''""")
def t05_split_long(spark, sf_dir):
    out = subtitles.split_long(_long(spark, sf_dir))
    return out.select("job_id", "part", "g", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text")


@query(f"""WITH {_GROUPS},
w AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w, CASE WHEN stop - start > 7 AND length(text) > 40 THEN greatest(2, CAST(floor((stop - start) / 7) AS INTEGER) + 1) ELSE 1 END AS parts FROM m),
p AS (SELECT *, greatest(1, len(w) // parts) AS per, unnest(range(parts)) AS part FROM w),
x AS (SELECT *, (stop - start) / parts AS step, CASE WHEN parts = 1 THEN text ELSE array_to_string(CASE WHEN part = parts - 1 THEN w[part * per + 1:] ELSE w[part * per + 1:(part + 1) * per] END, ' ') END AS piece FROM p)
SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY g, part) AS INTEGER) AS cue_index, round(CASE WHEN parts = 1 THEN start ELSE start + part * step END, 6) AS start, round(CASE WHEN parts = 1 THEN stop ELSE start + (part + 1) * step END, 6) AS "end", piece AS text FROM x WHERE piece <> ''""")
def t06_cues(spark, sf_dir):
    return subtitles.build_cues(_turns(spark, sf_dir)).select("job_id", "cue_index", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text")


_SEC = "cast(l_orderkey * 37 % 100000 as double) / 16 + l_linenumber"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_SEC} AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, lpad(CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(s / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(s) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(CAST(least(round_even((s - floor(s)) * 1000, 0), 999) AS BIGINT) AS VARCHAR), 3, '0') AS stamp FROM x""")
def t07_stamp(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", subtitles.stamp(F.expr(_SEC)).alias("stamp"))


_CUES = f"""
WITH c AS (SELECT conv_id AS job_id, turn AS i, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, {_DUR} AS d FROM conversations),
s AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY i) AS n, lpad(CAST(CAST(floor(d) AS BIGINT) AS VARCHAR), 2, '0') || 'SEP' || CASE WHEN d > floor(d) THEN '500' ELSE '000' END AS t FROM c)
"""


def _simple_cues(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("index"))
    return rows.select("job_id", number.alias("cue_index"), F.lit(0.0).alias("start"), F.col("duration").alias("end"), strip(F.regexp_replace("text", r"\s+", " ")).alias("text"))


@query(_CUES.replace("SEP", ",") + "SELECT job_id, string_agg(n || chr(10) || '00:00:00,000 --> 00:00:' || t || chr(10) || text, chr(10) || chr(10) ORDER BY n) || chr(10) AS document FROM s GROUP BY job_id")
def k04_srt(spark, sf_dir):
    return subtitles.to_srt(_simple_cues(spark, sf_dir))


@query(_CUES.replace("SEP", ".") + "SELECT job_id, 'WEBVTT' || chr(10) || chr(10) || string_agg('00:00:00.000 --> 00:00:' || t || chr(10) || text, chr(10) || chr(10) ORDER BY n) || chr(10) AS document FROM s GROUP BY job_id")
def k05_vtt(spark, sf_dir):
    return subtitles.to_vtt(_simple_cues(spark, sf_dir))


# --- A/B runs: labelled documents as measurements ----------------------------------------------
_MEASURES = "SELECT lang || '/' || cast(quality as string) AS variant, (doc_id % 17) / cast(100 as double) AS wer, (doc_id % 13) / cast(100 as double) AS cer, (doc_id % 11) / cast(100 as double) AS score, CASE WHEN doc_id % 4 > 0 THEN (doc_id % 7) / cast(8 as double) END AS similarity, n_chars / cast(16 as double) AS duration, (doc_id % 19) / cast(4 as double) AS seconds FROM documents JOIN labels USING (doc_id)"


def _measures(spark, sf_dir):
    both = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    return both.selectExpr("lang || '/' || cast(quality as string) AS variant", "(doc_id % 17) / 100D AS wer", "(doc_id % 13) / 100D AS cer", "(doc_id % 11) / 100D AS score", "CASE WHEN doc_id % 4 > 0 THEN (doc_id % 7) / 8D END AS similarity", "n_chars / 16D AS duration", "(doc_id % 19) / 4D AS seconds")


_SUM = f"""WITH m AS ({_MEASURES}), s AS (SELECT variant, count(*) AS n, avg(wer) AS wer, avg(cer) AS cer, avg(score) AS score, avg(similarity) AS similarity, max(wer) AS worst_wer, sum(duration) AS audio, sum(seconds) AS seconds FROM m GROUP BY variant)"""
_ROUNDED = ("wer", "cer", "score", "similarity", "worst_wer", "audio", "seconds")


@query(_SUM + " SELECT variant, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED) + " FROM s")
def a02_summary(spark, sf_dir):
    return abtest.summarize(_measures(spark, sf_dir)).select("variant", "n", *[F.round(c, 6).alias(c) for c in _ROUNDED])


@query(_SUM + " SELECT variant, wer = min(wer) OVER () AS best, round(CASE WHEN audio > 0 THEN seconds / audio ELSE 0 END, 9) AS xrt FROM s")
def a03_best_marker(spark, sf_dir):
    return abtest.mark_best(abtest.summarize(_measures(spark, sf_dir))).select("variant", "best", F.round("xrt", 9).alias("xrt"))


@query("SELECT n_name AS voice, CASE WHEN v <= 1.0 THEN NULL ELSE 'speaker_force' END AS param, CASE WHEN v <= 1.0 THEN NULL ELSE v END AS value FROM nation, (VALUES (CAST(1.0 AS DOUBLE)), (1.5), (2.0)) AS s(v) UNION ALL SELECT n_name, 'steps', v FROM nation, (VALUES (CAST(20 AS DOUBLE)), (40)) AS s(v)")
def a01_variants(spark, sf_dir):
    sweeps = spark.createDataFrame([("speaker_force", 1.0), ("speaker_force", 1.5), ("speaker_force", 2.0), ("steps", 20.0), ("steps", 40.0)], "param string, value double")
    return abtest.build_variants(_t(spark, sf_dir, "nation").select(F.col("n_name").alias("voice")), sweeps)


@query("SELECT o_orderkey, round(o_totalprice / greatest(1, o_custkey % 4), 6) AS seconds, 42 + 7919 * (o_custkey % 3) AS seed FROM orders")
def a04_spread_time(spark, sf_dir):
    runs = _t(spark, sf_dir, "orders").select("o_orderkey", F.lit(42).alias("base_seed"), (F.col("o_custkey") % 3).alias("repeat"), F.col("o_totalprice").alias("elapsed"), (F.col("o_custkey") % 4).alias("n_chunks"))
    return abtest.spread_time(runs).select("o_orderkey", F.round("seconds", 6).alias("seconds"), "seed")


@query(f"WITH m AS ({_MEASURES}) SELECT variant, " + ", ".join(f"printf('%.{d}f', {c}) AS {c}" for c, d in (("wer", 6), ("cer", 6), ("duration", 3), ("seconds", 3))) + ", CASE WHEN similarity IS NULL THEN '' ELSE printf('%.6f', similarity) END AS similarity FROM m")
def k06_csv(spark, sf_dir):
    return abtest.csv_columns(_measures(spark, sf_dir).select("variant", "wer", "cer", "duration", "seconds", "similarity"))


# --- settings -----------------------------------------------------------------------------------
_FILE = "'/up/' || replace(p_name, ' ', '.') || ' (' || cast(p_partkey as string) || ')_.WAV'"


@query(rf"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace({_FILE}, '^.*/', ''), '(?i)\.wav$', ''), '[^A-Za-z0-9 _-]', '_', 'g').regexp_replace('^[ ._-]+|[ ._-]+$', '', 'g') AS name FROM part")
def p05_voice_name(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", settings.voice_name(F.expr(_FILE)).alias("name"))


_MODEL = "CASE p_partkey % 5 WHEN 0 THEN ' None ' WHEN 1 THEN '' WHEN 2 THEN 'OFF' WHEN 3 THEN 'false' ELSE p_brand END"


@query(f"SELECT p_partkey, CASE WHEN lower(trim({_MODEL})) IN ('', 'none', 'off', 'false') THEN NULL ELSE {_MODEL} END AS model FROM part")
def p07_model(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", settings.model_or_none(F.expr(_MODEL)).alias("model"))


@query("SELECT p_partkey, p_size BETWEEN 8 AND 64 AND p_size % 10 BETWEEN 1 AND 8 AS valid FROM part")
def p09_bounds(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", settings.within_bounds({"steps": F.col("p_size"), "candidates": F.col("p_size") % 10}).alias("valid"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN 40.0 ELSE p_size END AS DOUBLE) AS steps, CAST(3.0 AS DOUBLE) AS cfg_text, CASE WHEN p_size % 5 > 1 THEN CAST(p_size % 5 AS DOUBLE) END AS scale, CASE WHEN p_size % 5 > 1 THEN CAST(0.5 AS DOUBLE) END AS least FROM part""")
def p04_params(spark, sf_dir):
    defaults = F.create_map(F.lit("steps"), F.lit(40.0), F.lit("cfg_text"), F.lit(3.0))
    given = F.create_map(F.lit("steps"), F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("double")), F.lit("odd"), F.lit(1.0))
    params = settings.speaker_force(settings.merge_params(defaults, given), F.col("p_size") % 5)
    return _t(spark, sf_dir, "part").select("p_partkey", params.alias("m")).select("p_partkey", F.col("m.steps").alias("steps"), F.col("m.cfg_text").alias("cfg_text"), F.element_at("m", "speaker_kv_scale").alias("scale"), F.element_at("m", "speaker_kv_min_t").alias("least"))


#: Seconds from below zero over all three forms, with halves and nulls.
_SECONDS = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast(event_id * 13 % 90000 - 200 as double) / (1 + event_id % 5 * event_id % 3) END"


@query(f"""WITH s AS (SELECT event_id, {_SECONDS} AS s FROM events), t AS (SELECT *, CAST(floor(s) AS BIGINT) AS t, CAST(floor(s + 0.5) AS BIGINT) AS r, CAST(floor(s / 60 + 0.5) AS BIGINT) AS m, greatest(coalesce(CAST(floor(s) AS BIGINT), 0), 0) AS p FROM s)
SELECT event_id, CASE WHEN s IS NULL OR s < 0 THEN '' WHEN s < 60 THEN r || 's' WHEN m < 60 THEN m || ' min' WHEN m % 60 > 0 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE (m // 60) || 'h' END AS told,
  CASE WHEN s IS NULL THEN '' WHEN s >= 0 THEN (t // 60) || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') ELSE '-' END AS short,
  CASE WHEN p >= 3600 THEN (p // 3600) || ':' || lpad(CAST(p // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(p % 60 AS VARCHAR), 2, '0') ELSE (p // 60) || ':' || lpad(CAST(p % 60 AS VARCHAR), 2, '0') END AS long FROM t""")
def p08_displays(spark, sf_dir):
    """All three displays of a duration; the shortest clock is for durations, which are not negative."""
    s = F.expr(_SECONDS)
    return _t(spark, sf_dir, "events").select("event_id", settings.short_duration(s).alias("told"), F.when(s < 0, "-").otherwise(settings.clock_short(s)).alias("short"), settings.clock_long(s).alias("long"))


_DICT = "'k' || cast(p_partkey % 5 as string) || ' = v=1' || chr(10) || '=x' || chr(10) || 'none' || chr(10) || ' k' || cast(p_size % 5 as string) || '=' || p_brand || ' '"


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = p_size % 5 THEN '' ELSE 'k' || (p_partkey % 5) || '>v=1|' END || 'k' || (p_size % 5) || '>' || p_brand AS pairs FROM part""")
def s11_dictionary(spark, sf_dir):
    pairs = settings.dictionary(F.expr(_DICT))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(pairs, lambda p: F.concat(p["src"], F.lit(">"), p["dst"])), "|").alias("pairs"))


# --- voices -------------------------------------------------------------------------------------
@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT DISTINCT n_name FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 <> 0")
def r01_add(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    return voices.add(n.where("n_nationkey % 2 = 0").select("name"), n.where("n_nationkey % 3 = 0").select("name"))


@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 3 <> 0")
def r02_remove(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    return voices.remove(n, n.where("n_nationkey % 3 = 0")).select("name")


_ASKED = "SELECT n_name AS old, CASE n_nationkey % 4 WHEN 0 THEN 'new ' || n_name WHEN 1 THEN 'shared' WHEN 2 THEN (SELECT min(n_name) FROM nation) ELSE 'x' END AS new FROM nation UNION ALL SELECT 'nobody ' || n_name, 'y' || n_name FROM nation"


@query(f"""WITH a AS ({_ASKED}), r AS (SELECT old, new, old IN (SELECT n_name FROM nation) AS there, new IN (SELECT n_name FROM nation) AS used FROM a),
f AS (SELECT new, min(old) AS old FROM r WHERE there AND NOT used GROUP BY new) SELECT old, new, CASE WHEN NOT there THEN 'missing' WHEN used OR (old, new) NOT IN (SELECT old, new FROM f) THEN 'taken' ELSE 'renamed' END AS status FROM r""")
def r03_rename_status(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    return voices.rename_status(n, _rename_requests(n))


def _rename_requests(n):
    k = F.col("n_nationkey") % 4
    one = n.agg(F.min("name").alias("one"))
    asked = n.join(one, F.lit(True)).select(F.col("name").alias("old"), F.when(k == 0, F.concat(F.lit("new "), "name")).when(k == 1, "shared").when(k == 2, F.col("one")).otherwise("x").alias("new"))
    return asked.union(n.select(F.concat(F.lit("nobody "), "name"), F.concat(F.lit("y"), "name")))


@query("SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'new ' || n_name WHEN n_name = (SELECT min(n_name) FROM nation WHERE n_nationkey % 4 = 1) THEN 'shared' WHEN n_name = (SELECT min(n_name) FROM nation WHERE n_nationkey % 4 = 3) THEN 'x' ELSE n_name END AS name FROM nation")
def r03_rename(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    return voices.rename(n, _rename_requests(n)).select("name")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS DOUBLE) / 2 END AS seconds FROM nation")
def r04_info(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    have = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), (F.col("n_nationkey") / 2).alias("seconds"))
    return voices.info(n.select(F.col("n_name").alias("name")), have)


@query("SELECT n_name AS name FROM nation ORDER BY n_name")
def r05_sorted(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).orderBy("name")


@query("SELECT o_orderkey, n_name AS name, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 THEN n_name || '.wav' END AS path FROM orders JOIN nation ON n_nationkey = o_custkey % 25")
def r07_lookup(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    asked = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("k")).join(n, "k").select("o_orderkey", "name")
    return voices.lookup(asked, n.where("k % 2 = 0").select("name"), n.where("k % 3 = 0").select("name", F.concat("name", F.lit(".wav")).alias("path")))


@query("""WITH e AS (SELECT event_id, 'v' || (user_id % 40) AS voice, event_id % 3 AS k FROM events), x AS (SELECT voice, arg_max(k, event_id) AS k FROM e WHERE k < 2 GROUP BY voice) SELECT voice AS name FROM x WHERE k = 0""")
def e07_current_voices(spark, sf_dir):
    e = _t(spark, sf_dir, "events").selectExpr("event_id AS ts", "CASE event_id % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'removed' ELSE 'processing' END AS type", "'v' || cast(user_id % 40 as string) AS voice", "cast(null as string) AS old", "cast(null as string) AS new")
    return voices.current(e)


# --- audio: vectors as samples -------------------------------------------------------------------
@query("""WITH r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), g AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS rms FROM r),
s AS (SELECT *, least(0.1 / rms, 8) AS gain, list_max(list_transform(x, lambda v: abs(v))) AS top FROM g)
SELECT vec_id, round(list_sum(list_transform(x, lambda v: abs(v))) * CASE WHEN top * gain > 0.99 THEN 0.99 / top ELSE gain END, 6) AS total FROM s""")
def d01_loudness(spark, sf_dir):
    x = audio.normalize_loudness(F.col("embedding").cast("array<double>"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v)), 6).alias("total"))


@query("SELECT vec_id, array_to_string(list_transform(CAST(embedding AS DOUBLE[]), lambda v: CAST(trunc(CASE WHEN greatest(least(v * 8, 1), -1) < 0 THEN greatest(least(v * 8, 1), -1) * 32768 ELSE greatest(least(v * 8, 1), -1) * 32767 END) AS INTEGER)), ' ') AS pcm FROM embeddings")
def k09_pcm16(spark, sf_dir):
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 8)
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(audio.to_pcm16(x), lambda v: v.cast("string")), " ").alias("pcm"))


def _le(v: str, size: int) -> str:
    return " || ".join(f"printf('%02X', ({v} >> {8 * i}) & 255)" for i in range(size))


_SAMPLES = "list_transform(CAST(embedding AS DOUBLE[]), lambda v: greatest(least(v * 8, 1), -1))"
_WAV = f"""WITH p AS (SELECT vec_id, list_transform({_SAMPLES}, lambda v: CAST(trunc(CASE WHEN v < 0 THEN v * 32768 ELSE v * 32767 END) AS BIGINT)) AS x FROM embeddings), q AS (SELECT vec_id, CAST(len(x) * 2 AS BIGINT) AS n, array_to_string(list_transform(x, lambda v: {_le('v', 2)}), '') AS pcm FROM p),
w AS (SELECT vec_id, '52494646' || {_le('(n + 36)', 4)} || '57415645666D7420' || '10000000' || '0100' || '0100' || '44AC0000' || '88580100' || '0200' || '1000' || '64617461' || {_le('n', 4)} || pcm AS h FROM q)"""


def _wav(spark, sf_dir):
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 8)
    return _t(spark, sf_dir, "embeddings").select("vec_id", audio.encode(x, F.when(F.col("vec_id") % 2 == 0, "odd")).alias("w")).select("vec_id", "w.*")


@query(_WAV + " SELECT vec_id, h AS wav, 'audio/wav' AS media_type FROM w")
def k07_encode(spark, sf_dir):
    """WAV files, as hexadecimal digits."""
    return _wav(spark, sf_dir).select("vec_id", F.hex("content").alias("wav"), "media_type")


@query(_WAV + " SELECT vec_id, base64(unhex(h)) AS b64 FROM w")
def k08_base64(spark, sf_dir):
    return _wav(spark, sf_dir).select("vec_id", F.regexp_replace(F.base64("content"), r"\s", "").alias("b64"))


_LATENTS = "flatten(list_transform(range(32 * (1 + vec_id % 3)), lambda i: CAST(embedding AS DOUBLE[])))"


@query(f"SELECT vec_id, CAST(len(x) AS BIGINT) AS n, x[1] AS first, round(coalesce(list_sum(x), 0), 6) AS total FROM (SELECT vec_id, {_LATENTS}[vec_id % 4 * 2048 + 1:] AS x FROM embeddings)")
def d03_crop(spark, sf_dir):
    """One to three latents' samples without those of the first none to three latents."""
    wide = F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), (32 * (1 + F.col("vec_id") % 3)).cast("int")))
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", audio.crop_front(wide, (F.col("vec_id") % 4).cast("int")).alias("x"))
    return rows.select("vec_id", F.size("x").cast("long").alias("n"), F.get("x", F.lit(0)).alias("first"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("SELECT vec_id, CAST(len(x) AS BIGINT) AS n, 640 - len(x) AS block, x[1] AS first FROM (SELECT vec_id, w[greatest(len(w) - 399, 1):] AS x FROM (SELECT vec_id, flatten(list_transform(range(1 + vec_id % 9), lambda i: CAST(embedding AS DOUBLE[]))) AS w FROM embeddings))")
def d03_continuation(spark, sf_dir):
    """The last latents that a continuation starts from, and the room it leaves."""
    wide = F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), (1 + F.col("vec_id") % 9).cast("int")))
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", audio.continuation(wide).alias("x"))
    return rows.select("vec_id", F.size("x").cast("long").alias("n"), (F.lit(audio.BLOCK) - F.size("x")).cast("long").alias("block"), F.get("x", F.lit(0)).alias("first"))


@query()
def d02_denoise(spark, sf_dir):
    """Every vector, twenty times over, through the denoiser; tests hold it against sums by definition."""
    x = F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), 20))
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", audio.denoise(x).alias("y"))
    return rows.select("vec_id", F.size("y").alias("n"), F.array_max("y").alias("peak"), F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v).alias("energy"))


@query()
def v16_resample(spark, sf_dir):
    """Vectors as two channels at 44.1 kHz, at 16 kHz; tests hold it against the interpolation sum."""
    x = F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), 20))
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", audio.resample(audio.RATE)(F.array(x, F.reverse(x))).alias("y"))
    return rows.select("vec_id", F.size("y").alias("n"), F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v).alias("energy"))


# --- sources ------------------------------------------------------------------------------------
@query("""SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'caf' || chr(233) || doc_id ELSE text END AS text FROM documents""")
def s01_decode(spark, sf_dir):
    """Texts as UTF-8, as UTF-8 with a mark, and bytes that are no UTF-8."""
    odd = F.concat(F.encode(F.lit("caf"), "UTF-8"), F.unhex(F.lit("E9")), F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    content = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(odd)
    return _t(spark, sf_dir, "documents").select("doc_id", extract.decode(content).alias("text"))


_TAGS = "|".join(extract.BLOCK_TAGS)


@query(rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<![^>]*>', '', 'g'), '(?s)<(head|script|style|title)(\s[^>]*)?>.*?</head>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '</?(?:{_TAGS})(?:\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a)
SELECT page_id, replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS text FROM b""")
def s02_html(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", extract.html_text("html").alias("text"))


@F.udf(T.BinaryType(), useArrow=False)
def _book(title, text):
    """An EPUB file of two pages, a title and a text, whose table of contents lists the title first and the archive last."""
    import html

    def page(body: str) -> str:
        return f"<html><head><title>no</title></head><body>{body}</body></html>"

    def put(z, name: str, content: str) -> None:
        z.writestr(zipfile.ZipInfo(name), content)  # dated alike, so that a book made again is the same book

    if text is None:
        return None
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        put(z, "META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{i}" href="{i}.xhtml"/>' for i in ("text", "title"))
        put(z, "OEBPS/c.opf", f'<package xmlns="http://x"><manifest>{items}</manifest><spine><itemref idref="title"/><itemref idref="gone"/><itemref idref="text"/></spine></package>')
        put(z, "OEBPS/text.xhtml", page(f"<p>{html.escape(text)}</p>"))
        put(z, "OEBPS/title.xhtml", page(f"<h1>{title}</h1><script>no</script>"))
    return out.getvalue()


def _books(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", _book(F.concat(F.lit("Part "), (F.col("doc_id") % 7).cast("string")), F.col("text")).alias("content"))


_BOOK_TEXT = r"'Part ' || doc_id % 7 || chr(10) || chr(10) || regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, {_BOOK_TEXT} AS text FROM documents")
def s04_epub(spark, sf_dir):
    """Documents as books of two pages, read back in the order of their contents."""
    return extract.with_book_texts(_books(spark, sf_dir).select("doc_id", "content")).select("doc_id", "text")


@query("""SELECT o_custkey AS file, o_orderkey AS ord, 'OEBPS/p' || (o_orderkey % 7) || '.xhtml' AS name FROM orders WHERE o_orderkey % 7 < 5 AND o_orderkey % 7 <> 2""")
def s03_spine(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    spine = o.selectExpr("o_custkey AS file", "o_orderkey AS ord", "'i' || cast(o_orderkey % 7 as string) AS idref")
    books = o.select(F.col("o_custkey").alias("file")).distinct()
    manifest = books.selectExpr("file", "explode(sequence(0, 4)) AS k").selectExpr("file", "'i' || cast(k as string) AS item_id", "'/p' || cast(k as string) || '.xhtml' AS href", "'OEBPS/' AS base")
    names = books.selectExpr("file", "explode(array(0, 1, 3, 4, 5, 6)) AS k").selectExpr("file", "'OEBPS/p' || cast(k as string) || '.xhtml' AS name")
    return extract.spine_order(spine, manifest, names)


@query("SELECT p_name || p_partkey AS stem, coalesce(p_size % 3 > 1, false) AND p_size % 2 = 0 AS use_cache FROM part")
def s06_voice_cache(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    stem = F.concat("p_name", F.col("p_partkey").cast("string"))
    wav = p.select(F.concat(F.lit("/v/"), stem, F.lit(".wav")).alias("path"), F.lit(1).alias("modificationTime"))
    pkl = p.where("p_size % 2 = 0").select(F.concat(F.lit("/v/"), stem, F.lit(".pkl")).alias("path"), (F.col("p_size") % 3).alias("modificationTime"))
    return extract.voice_cache(wav.union(pkl))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN CAST(1.5 AS DOUBLE) WHEN o_custkey % 4 > 0 THEN o_orderkey / CAST(o_custkey % 4 AS DOUBLE) WHEN o_custkey % 5 = 0 THEN CAST(2.5 AS DOUBLE) END AS seconds FROM orders")
def s07_duration(spark, sf_dir):
    c = F.col("o_custkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", extract.duration(F.when(c % 3 == 0, 1.5), F.col("o_orderkey").cast("double"), (c % 4).cast("int"), F.when(c % 5 == 0, 2.5)).alias("seconds"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 < 2 THEN round(CAST(128 * (1 + vec_id % 5) AS DOUBLE) / (2 * 8000 * (1 + vec_id % 2)), 9) END AS seconds FROM embeddings")
def s07_wav_header(spark, sf_dir):
    """Durations by the headers of WAV files of one to five vectors, at two rates; other bytes have none."""
    x = F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), (1 + F.col("vec_id") % 5).cast("int")))
    slow, fast = audio.wav_bytes(x, 8000), audio.wav_bytes(x, 16_000)
    content = F.when(F.col("vec_id") % 3 == 2, F.encode(F.lit("no sound"), "UTF-8")).when(F.col("vec_id") % 2 == 0, slow).otherwise(fast)
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(extract.wav_seconds(content), 9).alias("seconds"))


_MANIFEST = "CASE o_orderkey % 4 WHEN 0 THEN '{\"id\":\"j' || cast(o_orderkey as string) || '\",\"voice\":\"v\",\"created_at\":' || cast(o_custkey as string) || ',\"chunks\":[{\"index\":0,\"text\":\"a\",\"status\":\"done\",\"duration\":1.5}]}' WHEN 1 THEN '{\"id\":\"j' || cast(o_orderkey as string) || '\",\"status\":\"complete\"}' WHEN 2 THEN '{broken' ELSE '{}' END"


@query("SELECT 'j' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS DOUBLE) ELSE 0 END AS created_at, CASE WHEN o_orderkey % 4 = 0 THEN 'v' ELSE '' END AS voice, CASE WHEN o_orderkey % 4 = 0 THEN 'running' ELSE 'complete' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN CAST(1.5 AS DOUBLE) END AS first FROM orders WHERE o_orderkey % 4 < 2")
def s08_manifests(spark, sf_dir):
    rows = extract.parse_manifests(_t(spark, sf_dir, "orders").select(F.expr(_MANIFEST).alias("value")))
    return rows.select("id", "created_at", "voice", "status", F.get("chunks", F.lit(0))["duration"].alias("first"))


@query("SELECT event_id % 7 AS index, 'chunk' AS type, 'v' || user_id AS voice FROM events WHERE event_id % 4 > 0")
def s12_event_lines(spark, sf_dir):
    body = F.expr("CASE WHEN event_id % 4 = 0 THEN ': ping' ELSE 'data: {\"type\":\"chunk\",\"index\":' || cast(event_id % 7 as string) || ',\"voice\":\"v' || cast(user_id as string) || '\"}' END")
    return extract.event_lines(_t(spark, sf_dir, "events").select(body.alias("value")), "type string, index bigint, voice string")


@query(f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {_plain('text')} ELSE {_BOOK_TEXT} END AS text FROM documents WHERE doc_id % 3 < 2 AND (doc_id % 3 = 1 OR {_plain('text')} <> '')")
def s05_uploads(spark, sf_dir):
    """Texts, books and files of no known kind, each read as what it is."""
    kind = F.expr("element_at(array('a.TXT', 'b.epub', 'c.pdf'), cast(doc_id % 3 as int) + 1)")
    files = _books(spark, sf_dir).select("doc_id", kind.alias("name"), F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-8")).otherwise(F.col("content")).alias("content"))
    return extract.upload_texts(files).select("doc_id", "text")


# --- streams over the events table, as an analogue -----------------------------------------------
@query("""WITH e AS (SELECT 'f' || (user_id % 50) || '.wav' AS path, ts, lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY ts) AS before FROM events),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT path, max(ts) + INTERVAL 1 HOUR AS settled_at, count(*) AS n FROM g GROUP BY path, g""")
def e01_settled(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("ts", F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string"), F.lit(".wav")).alias("path"))
    return streams.settled(e, "1 hour")


def _event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


@query("""WITH w AS (SELECT user_id AS job_id, event_id AS index, CAST(row_number() OVER o AS INTEGER) AS done, avg(greatest(value, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS pace FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
SELECT job_id, index, done, round(CASE WHEN done < 100 THEN pace * (100 - done) END, 6) AS eta FROM w""")
def e05_progress_stream(spark, sf_dir):
    """Remaining time per job from a stream of the events files."""
    e = _event_stream(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("index"), F.lit(100).alias("total"), F.col("value").alias("seconds"))
    out = streams.drained(streams.progress(e), streams.shared_folder(spark, f"progress-{uuid.uuid4().hex}"))
    return out.select("job_id", "index", "done", F.round("eta", 6).alias("eta"))


@query("SELECT event_id, 'clicks' AS subscriber FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'even' FROM events WHERE user_id % 2 = 0")
def e03_fan_out(spark, sf_dir):
    """Two subscribers to one stream, each with its own condition."""
    folder = streams.shared_folder(spark, f"subscribers-{uuid.uuid4().hex}")
    for q in streams.fan_out(_event_stream(spark, sf_dir), {"clicks": "event_type = 'click'", "even": "user_id % 2 = 0"}, folder):
        q.processAllAvailable()
        q.stop()
    read = lambda name: spark.read.parquet(f"{folder}/{name}").select("event_id", F.lit(name).alias("subscriber"))
    return read("clicks").union(read("even"))


_SESSION = "user_id % 40 AS session, ts, event_id, CASE event_id % 7 WHEN 0 THEN 'start' WHEN 1 THEN 'stop' ELSE 'chunk' END AS type, event_id // 700 AS generation"


@query(f"""WITH e AS (SELECT {_SESSION} FROM events), m AS (SELECT *, max(CASE type WHEN 'stop' THEN generation WHEN 'start' THEN generation - 1 END) OVER (PARTITION BY session ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended FROM e)
SELECT session, event_id FROM m WHERE type = 'chunk' AND (ended IS NULL OR ended < generation)""")
def e06_still_wanted(spark, sf_dir):
    """Chunks of generations that no stop and no later start has ended."""
    e = _t(spark, sf_dir, "events").selectExpr(*_SESSION.replace("//", "div").split(", "))
    return streams.still_wanted(e).select("session", "event_id")


@query("SELECT label AS job_id, vec_id AS index, CAST(coalesce(sum(len(embedding)) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def j07_audio_concat(spark, sf_dir):
    """Where each chunk's samples lie in the audio of its job."""
    chunks = _t(spark, sf_dir, "embeddings").select(F.col("label").alias("job_id"), F.col("vec_id").alias("index"), F.col("embedding").alias("samples"))
    return audio.placed_chunks(chunks).select("job_id", "index", F.col("offset").cast("long").alias("offset"), F.size("samples").cast("long").alias("n"))


@query(f"WITH c AS ({_CHUNKS}) SELECT job_id, index FROM c WHERE job_id % 4 <> 1")
def k03_delete(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return jobs.delete_jobs(chunks, chunks.where("job_id % 4 = 1").select("job_id").distinct()).select("job_id", "index")


@query("SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 3 = 0 THEN 'complete' ELSE 'running' END AS status FROM orders")
def k03_finish(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("job_id"), F.lit("running").alias("status"))
    return jobs.finish_jobs(rows, o.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("job_id"), F.lit("complete").alias("ended_as")))


@query("SELECT n_name AS name, n_name IN ('BRAZIL', 'JAPAN', 'NATION_3') AS favourite FROM nation")
def r06_favourites(spark, sf_dir):
    return voices.favourites_first(_t(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), ["BRAZIL", "JAPAN", "NATION_3"])


@query("SELECT p_partkey, 'v_' || p_partkey || ' x' AS name FROM part WHERE p_partkey % 2 = 0 AND p_size % 5 > 0 AND p_partkey % 7 <> 0")
def r08_upload_guard(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    up = p.selectExpr("p_partkey", "'/up/ v*' || cast(p_partkey as string) || ' x.' || CASE WHEN p_partkey % 2 = 0 THEN '.WAV' ELSE '.mp3' END AS filename", "p_size % 5 AS size")
    have = p.where("p_partkey % 7 = 0").selectExpr("'v_' || cast(p_partkey as string) || ' x' AS name")
    return voices.accept_recordings(up, have).select("p_partkey", "name")


@query(f"WITH c AS ({_CHUNKS}) SELECT job_id, index, CASE WHEN job_id % 2 = 0 THEN index * 10 END AS content FROM c")
def r09_chunk_audio(spark, sf_dir):
    chunks = _chunks(spark, sf_dir).select("job_id", "index")
    return voices.chunk_audio(chunks, chunks.where("job_id % 2 = 0").withColumn("content", F.col("index") * 10))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id % 2 = 0")
def e02_deletions(spark, sf_dir):
    e = _t(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_type = 'click' THEN 'deleted' ELSE 'created' END AS type", "CASE WHEN user_id % 2 = 0 THEN 'a.WAV' ELSE 'a.txt' END AS path")
    return streams.deletions(e).select("event_id")
