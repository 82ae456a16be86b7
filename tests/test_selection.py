"""Takes in rounds and what is told of them; the order of names."""

import random

from pyspark.sql import functions as F

from lectern.operators import selection, voices


def test_rounds_ask_only_for_what_is_open(spark):
    """Against ranking all rounds made beforehand; the rows that are ranked fall as chunks settle."""
    rng = random.Random(9)
    takes = [(c, r * 2 + k, rng.choice([0.05, 0.3, 0.3, 0.5, 0.9])) for c in range(120) for r in range(4) for k in range(2) if c % 10 or r < 2]
    table = spark.createDataFrame(takes, "chunk_id long, take int, score double").withColumn("mean_rank", F.lit(0.0))
    asked = []

    def make(chunks, r):
        asked.append({x.chunk_id for x in chunks.collect()})
        return table.drop("mean_rank").where(F.col("take").between(2 * r, 2 * r + 1)).join(chunks, "chunk_id", "left_semi")

    won, touched = selection.escalation(table.select("chunk_id").distinct(), make, lambda t: t.withColumn("mean_rank", F.lit(0.0)), 4)
    all_rounds = table.withColumn("own", F.expr("cast(take / 2 as int)")).withColumn("round", F.explode(F.expr("sequence(own, if(chunk_id % 10 = 0, 1, 3))")))
    want = selection.escalate(all_rounds)
    plain = lambda df: sorted(tuple(r) for r in df.select("chunk_id", "round", "winner", "score", "acceptable").collect())
    assert plain(won) == plain(want)
    assert all(b < a for a, b in zip(asked, asked[1:], strict=False)) and len(asked) == 4 and touched[0] == 240
    naive = [240 * (r + 1) for r in range(4)]
    assert all(t < n for t, n in zip(touched[1:], naive[1:], strict=True))


def test_rounds_stop_when_all_is_settled(spark):
    table = spark.createDataFrame([(1, 0, 0.01), (2, 0, 0.09)], "chunk_id long, take int, score double")
    won, touched = selection.escalation(table.select("chunk_id"), lambda chunks, r: table.join(chunks, "chunk_id", "left_semi"), lambda t: t.withColumn("mean_rank", F.lit(0.0)), 5)
    assert touched == [2] and sorted((r.chunk_id, r.round, r.winner) for r in won.collect()) == [(1, 0, 0), (2, 0, 0)]
    none, touched = selection.escalation(table.select("chunk_id").limit(0), lambda chunks, r: table.join(chunks, "chunk_id", "left_semi"), lambda t: t.withColumn("mean_rank", F.lit(0.0)), 5)
    assert not none.collect() and touched == [0]


def test_what_is_seen_while_a_query_runs(spark):
    df = spark.createDataFrame([(0, 0.5), (1, None), (2, 0.25), (0, 0.0)], "winner int, wer double")
    told, kept = selection.observed(df)
    assert kept.count() == 4 and told() == (4, 2, 0.5)


def test_names_stand_as_readers_expect(spark):
    names = ["Zoe", "élan", "Eva", "apple", "Émile", "emile", "eva", "Ångström", "zebra", "10", "Öl", "ostern", "äpfel"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.name for r in voices.favourites_first(df, ["Zoe"]).collect()]
    assert got == ["Zoe", "10", "Ångström", "äpfel", "apple", "élan", "emile", "Émile", "eva", "Eva", "Öl", "ostern", "zebra"]
    assert [r.name for r in voices.favourites_first(df, [], "UTF8_BINARY").collect()] == sorted(names, key=str.encode)
