import random

import duckdb

from lectern.llm import urls


def brute(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [(len(h), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def check(spark, rows, rules, default="allow"):
    df = spark.createDataFrame(rows, "page_id long, url string, host int")
    got = urls.match_rules(df, spark.createDataFrame(rules, "host string, path string, verdict string"), default=default).collect()
    want = [(i, *brute(u, rules, default)) for i, u, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_random_rules(spark):
    rng = random.Random(4)
    labels = ["a", "b", "ab", "A", "x-1", ""]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/a", "/b", "/", "a"]) for _ in range(rng.randint(0, 3)))
    rules = sorted({(host().lower(), "/" + path() if rng.random() < 0.8 else "", rng.choice(["block", "allow"])) for _ in range(60)})
    rows = [(i, f"http{'s' * rng.randint(0, 1)}://{host()}{path()}{rng.choice(['', '?q=/a#x', '#f?'])}", 0) for i in range(1500)]
    rows += [(9000 + i, "http://hot.example.com/en/1", 0) for i in range(800)]  # a hot host
    check(spark, rows, rules)


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "no scheme", 0), (4, "://", 0), (5, "x://h", 0), (5, "x://h", 0), (None, "a://b://c/d", 0), (6, "a://É.COM\n/p\nq?z", 0), (7, "a://" + "l." * 5000 + "com/en/", 0)]
    check(spark, rows, [("com", "/en/", "block"), ("", "", "block"), ("h", "", "allow")])
    check(spark, rows, [])
    assert not urls.match_rules(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string")).collect()


def test_query_against_sql(spark, sf):
    got = sorted(map(str, (tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in urls.op2_url_filters(spark, sf).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert got == sorted(map(str, con.execute("SELECT page_id, host, path, rule, verdict FROM (" + urls.OP2_SQL + ")").fetchall()))
