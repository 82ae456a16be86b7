"""Every query of the library against its DuckDB equivalent on the smallest tables."""

import math

import duckdb
import pytest

from lectern.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(str([round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if not n.startswith("op") and n != "pipeline"])
def test_query(spark, sf, con, name):
    df = queries.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in queries.SQL:
        assert rows
        return
    found = con.execute(queries.SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == sorted(df.columns)
    want = [tuple(r[at.index(c)] for c in df.columns) for r in found.fetchall()]
    assert plain(rows) == plain(want)


def test_queries_register_without_a_session():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
