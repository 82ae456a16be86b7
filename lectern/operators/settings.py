"""Names, parameters and displays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of a request.
BOUNDS = {"seed": (0, 2147483647), "steps": (8, 64), "cfg_text": (1, 8), "cfg_speaker": (1, 15), "truncation": (0.5, 1.5), "speaker_force": (1, 3), "candidates": (1, 8), "max_rounds": (1, 5), "verify_threshold": (0, 1)}


def voice_name(filename: Column) -> Column:
    """Last part of a path without .wav, odd characters as _, no blanks, dots, dashes or _ at the ends."""
    base = F.substring_index(F.replace(filename, F.lit("\\"), F.lit("/")), "/", -1)
    plain = F.regexp_replace(F.regexp_replace(base, r"(?i)\.wav$", ""), r"[^A-Za-z0-9 _-]", "_")
    return F.regexp_replace(plain, r"^[ ._-]+|[ ._-]+$", "")


def model_or_none(value: Column) -> Column:
    return F.when(F.lower(F.trim(value)).isin("", "none", "off", "false"), None).otherwise(value)


def within_bounds(columns: dict[str, Column]) -> Column:
    """Whether all named values lie in their bounds."""
    out = F.lit(True)
    for name, c in columns.items():
        lo, hi = BOUNDS[name]
        out = out & c.between(lo, hi)
    return out


def merge_params(defaults: Column, given: Column) -> Column:
    """Defaults with known keys that are given and not null (maps of string to double)."""
    known = F.map_filter(given, lambda k, v: F.array_contains(F.map_keys(defaults), k) & v.isNotNull())
    return F.transform_values(defaults, lambda k, v: F.coalesce(known[k], v))


def _real(s: Column) -> Column:
    """The number, null if it is none or without end."""
    return F.when(~F.isnan(s.cast("double")) & (F.abs(s.cast("double")) != float("inf")), s)


def short_duration(s: Column) -> Column:
    """12s, 5 min, 1h or 1h 5m; empty for negative, missing and endless durations."""
    t = _real(s)
    seconds, m = F.floor(t + 0.5).cast("long"), F.floor(t / 60 + 0.5).cast("long")
    hours, rest = F.floor(m / 60), m % 60
    long = F.when(rest > 0, F.format_string("%dh %dm", hours, rest)).otherwise(F.format_string("%dh", hours))
    return F.when(t.isNull() | (t < 0), "").when(t < 60, F.format_string("%ds", seconds)).when(m < 60, F.format_string("%d min", m)).otherwise(long)


def clock_short(s: Column) -> Column:
    """m:ss; empty for missing and endless durations."""
    t = F.floor(_real(s)).cast("long")
    return F.when(t.isNull(), "").otherwise(F.format_string("%d:%02d", F.floor(t / 60), t % 60))


def clock_long(s: Column) -> Column:
    """h:mm:ss, or m:ss under an hour; negative, missing and endless times are 0."""
    t = F.greatest(F.coalesce(F.floor(_real(s)).cast("long"), F.lit(0)), F.lit(0))
    return F.when(t >= 3600, F.format_string("%d:%02d:%02d", F.floor(t / 3600), F.floor(t / 60) % 60, t % 60)).otherwise(F.format_string("%d:%02d", F.floor(t / 60), t % 60))


def dictionary(text: Column) -> Column:
    """array<struct<src,dst>> of lines ``key = value``: split at the first =, trimmed, a later key wins over an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.instr(x, "=") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("src"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("dst")))
    full = F.filter(pairs, lambda p: p["src"] != "")
    return F.filter(full, lambda p, i: F.size(F.filter(full, lambda q, j: (q["src"] == p["src"]) & (j > i))) == 0)


#: A speaker force up to this sets no parameter; the least time that goes with a force whose time is not given.
NO_FORCE, FORCE_TIME = 1.0, 0.5


def speaker_force(params: Column, force: Column) -> Column:
    """``params`` (map of string to double) with a forced speaker's scale and least time, if ``force`` is above NO_FORCE."""
    given = F.map_concat(F.map_filter(params, lambda k, v: k != "speaker_kv_scale"), F.create_map(F.lit("speaker_kv_scale"), force.cast("double")))
    timed = F.when(F.coalesce(F.element_at(params, "speaker_kv_min_t").isNotNull(), F.lit(False)), given).otherwise(F.map_concat(F.map_filter(given, lambda k, v: k != "speaker_kv_min_t"), F.create_map(F.lit("speaker_kv_min_t"), F.lit(FORCE_TIME))))
    return F.when(force > NO_FORCE, timed).otherwise(params)
