"""Takes of a chunk meet once, whatever the steps of the work."""

import pytest

from lectern.operators import selection
from lectern.plans import queries


@pytest.mark.parametrize("name", ["v13_rank_ensemble", "v14_winner", "v22_stats"])
def test_takes_are_shuffled_once(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Join") == 0


def test_penalties_apart_or_beside_the_scores(spark):
    """Chunk 1: verifier b failed on all takes; take 2 was never scored; take 9 is scored and not listed."""
    rows = [(1, 0, "a", 0, 0.5, 0.1, 1.0, 0.0), (1, 1, "a", 0, 0.2, 0.4, 0.0, 1.0), (1, 0, "b", 1, None, 0.1, None, None), (1, 1, "b", 1, None, 0.0, None, None), (1, 9, "a", 0, 0.0, 0.0, 0.0, 0.0), (2, 0, "a", 0, None, None, None, None), (2, 0, "b", 1, 0.3, 0.0, 0.0, 0.0), (2, 1, "b", 1, None, 0.0, 9.0, 0.0)]
    scores = spark.createDataFrame(rows, "chunk_id long, take int, verifier string, verifier_ord int, wer double, cer double, repetition double, truncation double")
    other = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.25), (1, 2, 0.1), (2, 0, 0.0), (2, 1, 0.0)], "chunk_id long, take int, other double")
    got = {(r.chunk_id, r.take): (r.mean_rank, round(r.score, 9), r.wer, r.n_verifiers) for r in selection.rank_takes(scores, other).collect()}
    assert got == {(1, 0): (1.0, 0.925, 0.5, 1), (1, 1): (0.0, 0.85, 0.2, 1), (1, 2): (0.0, 0.0, None, 0), (2, 0): (0.0, 0.3, 0.3, 1), (2, 1): (1.0, 4.6, None, 1)}
    whole = scores.where("take <> 9").join(other, ["chunk_id", "take"])
    beside = {(r.chunk_id, r.take): (r.mean_rank, round(r.score, 9), r.wer, r.n_verifiers) for r in selection.rank_takes(whole).collect()}
    assert beside == {k: v for k, v in got.items() if k != (1, 2)}
