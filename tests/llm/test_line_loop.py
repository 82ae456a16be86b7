import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import common, lines
from lectern.llm.common import loop_tables
from lectern.llm.components import connected_components


def test_tables_of_the_loop_grow_with_the_copies(spark):
    """Texts with a common head and copies of many lengths: a table of the descent has two rows a copied suffix at most, one of the names only suffixes with so many lines."""
    rng = random.Random(4)
    base = [f"l{i}" for i in range(40)]
    rows = []
    for i in range(60):
        a, n = rng.randrange(20), rng.randrange(1, 21)
        rows.append((i, "\n".join(["head", *base[a : a + n], f"tail {rng.randrange(4)}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with loop_tables(spark, keep=True) as written:
        sizes = []

        def counted(df):
            sizes.append((out := written(df)).count())
            return out

        names = lines.suffix_names(written(lines._suffixes(df, "doc_id", "text")), counted)
        at_depth, sizes[:] = list(sizes), []
        copied = lines._descended(names, counted).count()
        assert max(sizes) <= 2 * copied
        full = [sum(max(0, len(t.split("\n")) - d + 1) for _, t in rows) for d in (1, 2, 4, 8, 16, 32)]
        # one table at depth 1, then two a depth
        assert all(n <= full[(k + 1) // 2] for k, n in enumerate(at_depth))


def test_runs_end_with_their_document(spark):
    """Documents that follow each other in the order of the ids hold the lines of a run between them; it is none."""
    rows = [(1, "a\nb"), (2, "c\nd"), (3, "x\na"), (4, "b\nc"), (5, "a"), (6, "b"), (7, "a\nb\n"), (8, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.start, r.end, r.src_doc, r.src_start) for r in lines.repeated_runs(df).collect()} == {(7, 0, 2, 1, 0)}


@pytest.mark.parametrize("hot", [False, True])
def test_loops_broadcast_only_where_a_key_can_fill_a_task(spark, monkeypatch, hot):
    """Broadcasts are made in the driver, some in each round; the result is the same with them and without."""
    made, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: made.append(1) or broadcast(df))
    if hot:
        for module in (common, lines):
            monkeypatch.setattr(module, "FEW_ROWS", 1)
        monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nx"), (3, "a\nb\na\nb"), (4, "a"), (5, "y\nb\nc\nd"), (6, "a"), (7, "a\nb\nc\nd")]
    runs = lines.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.start, r.end, r.src_doc, r.src_start) for r in runs.collect()} == {(2, 0, 3, 1, 0), (3, 0, 2, 1, 0), (3, 2, 4, 1, 0), (5, 1, 4, 1, 1), (7, 0, 4, 1, 0)}
    edges = [(1, i) for i in range(2, 9)] + [(8, 9), (9, 20), (30, 31)]
    roots = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {(r.node, r.root) for r in roots.collect()} == {(i, 1) for i in [*range(1, 10), 20]} | {(30, 30), (31, 30)}
    assert bool(made) == hot
