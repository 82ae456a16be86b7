"""Best of N: takes of a chunk ranked by several verifiers and one of them chosen."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lectern.operators.scoring import CER_WEIGHT, REPETITION_WEIGHT, TRUNCATION_WEIGHT
from lectern.streaming.events import written

ACCEPT = 0.10


def rank_takes(scores: DataFrame, penalties: DataFrame | None = None) -> DataFrame:
    """(chunk_id, take, mean_rank, score, wer, cer, n_verifiers): every take, by verifiers that worked.

    ``scores``: chunk_id, take, verifier, verifier_ord, wer, cer, repetition, truncation, with wer null where the verifier failed on
    the take.  ``penalties``: chunk_id, take, other (penalties not from transcripts); it lists all takes, each once.  Without it ``scores`` lists them
    all and has other, the same for all verifiers.  A verifier that failed on all takes of a chunk is left out; a failed take counts as composite 1.
    Without verifiers mean_rank and score are 0.  Takes of a chunk meet once; rows dealt out by chunk_id are not shuffled again.
    """
    rows = scores.withColumns({"listed": F.lit(penalties is None), "scored": F.lit(True)})
    if penalties is not None:
        listed = penalties.select("chunk_id", "take", "other", F.lit(True).alias("listed"), F.lit(False).alias("scored"))
        rows = rows.drop("other").where("chunk_id is not null and take is not null").unionByName(listed, allowMissingColumns=True)
    chunk = Window.partitionBy("chunk_id")
    # peers by order, not by partition: of all that follows only this asks for rows by chunk_id alone, and the rest keeps to it
    alike = lambda c: chunk.orderBy(c).rangeBetween(Window.currentRow, Window.currentRow)
    alive = F.col("scored") & (F.count("wer").over(alike("verifier")) > 0)
    rows = rows.withColumn("alive", alive)
    take = Window.partitionBy("chunk_id", "take")
    worst = lambda c: F.coalesce(F.max(F.when(F.col("alive"), F.col(c))).over(take), F.lit(0.0))
    spoken = REPETITION_WEIGHT * worst("repetition") + TRUNCATION_WEIGHT * worst("truncation")
    rows = rows.select("*", (F.max("other").over(take) + spoken).alias("penalty"), F.max("listed").over(take).alias("known")).where("known")
    rows = rows.withColumn("composite", F.when(F.col("alive"), F.coalesce(F.col("wer") + CER_WEIGHT * F.col("cer"), F.lit(1.0))))
    order = Window.partitionBy("chunk_id", "verifier", "alive").orderBy(F.col("composite") + F.col("penalty"), "take")
    ranked = rows.withColumn("rank", F.when(F.col("alive"), F.row_number().over(order) - 1))
    told = F.when(F.col("wer").isNotNull(), F.col("verifier_ord"))
    out = ranked.groupBy("chunk_id", "take").agg(F.avg("rank").alias("mean_rank"), (F.avg("composite") + F.max("penalty")).alias("score"), F.min_by("wer", told).alias("wer"), F.min_by("cer", told).alias("cer"), F.count("rank").alias("n_verifiers"))
    return out.fillna({"mean_rank": 0.0, "score": 0.0})


def select_winners(ranked: DataFrame, accept: float = ACCEPT, more: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, winner, score, acceptable and ``more`` columns of the winner): the take of least (mean_rank, score, take)."""
    best = F.min_by(F.struct("take", "score", *more), F.struct("mean_rank", "score", "take"))
    won = ranked.groupBy("chunk_id").agg(best.alias("b"))
    return won.select("chunk_id", F.col("b.take").alias("winner"), F.col("b.score").alias("score"), (F.col("b.score") <= accept).alias("acceptable"), *[F.col(f"b.{c}").alias(c) for c in more])


def escalate(rounds: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(chunk_id, round, winner, score, acceptable): the round that settles each chunk.

    ``rounds``: chunk_id, round, take, mean_rank, score, as ranked over all takes up to that round.  The first round with an acceptable
    winner settles a chunk, else its last.
    """
    best = F.min_by(F.struct("take", "score"), F.struct("mean_rank", "score", "take"))
    won = rounds.groupBy("chunk_id", "round").agg(best.alias("b")).select("chunk_id", "round", F.col("b.take").alias("winner"), F.col("b.score").alias("score"))
    won = won.withColumn("acceptable", F.col("score") <= accept)
    order = F.when(F.col("acceptable"), F.col("round")).otherwise(1_000_000 - F.col("round"))
    pick = Window.partitionBy("chunk_id").orderBy(order)
    return won.withColumn("n", F.row_number().over(pick)).where("n = 1").drop("n")


def escalation(chunks: DataFrame, make: Callable[[DataFrame, int], DataFrame], rank: Callable[[DataFrame], DataFrame], rounds: int, accept: float = ACCEPT) -> tuple[DataFrame, list[int]]:
    """((chunk_id, round, winner, score, acceptable), takes ranked in each round): rounds of takes until each chunk is settled.

    ``make`` gives the takes (chunk_id, take and more) of a round for the chunks (chunk_id) it is asked for, ``rank`` ranks takes (adds mean_rank, score).  A
    round asks only for chunks without an acceptable winner so far and ranks all takes of these; after ``rounds`` rounds, one at least, what is left keeps its best.  round
    is the last round that made takes for the chunk; chunks that never have any do not come out.  Each round is written, so none is made twice.
    """
    open_, takes, done, touched = chunks.select("chunk_id"), None, [], []
    for r in range(max(1, rounds)):
        new = make(open_, r).withColumn("round", F.lit(r))
        takes = new if takes is None else takes.join(open_, "chunk_id", "left_semi").unionByName(new)
        takes = written(takes, "takes")
        touched.append(takes.count())
        made = takes.groupBy("chunk_id").agg(F.max("round").alias("round"))
        won = written(select_winners(rank(takes), accept).join(made, "chunk_id").select("chunk_id", "round", "winner", "score", "acceptable"), "winners")
        settled = F.coalesce("acceptable", F.lit(False))
        if r + 1 == max(1, rounds) or won.where(~settled).isEmpty():
            done.append(won)
            break
        done.append(won.where(settled))
        open_ = written(open_.join(won.where(settled).select("chunk_id"), "chunk_id", "left_anti"), "open")
    return reduce(DataFrame.unionByName, done), touched


def observed(winners: DataFrame) -> tuple[Callable[[], tuple], DataFrame]:
    """(what was seen, ``winners``): the table to be used in the place of ``winners`` (winner, wer), which tells chunks, retakes and the worst wer as it is read.

    What was seen is a function that waits for the first complete use of the table; no query of its own runs.
    """
    seen = Observation()
    return (lambda: tuple(seen.get[c] for c in ("chunks", "retakes", "worst_wer"))), winners.observe(seen, F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("winner") != 0).alias("retakes"), F.max("wer").alias("worst_wer"))


def seeds(base: int, chunk, round_):
    """Seed of the takes of a round of a chunk (columns)."""
    return F.lit(base) + 1000 * chunk + 100 * round_


def verification_stats(winners: DataFrame) -> DataFrame:
    """chunks, retakes and worst wer of (chunk_id, winner, wer)."""
    return winners.agg(F.count("*").alias("chunks"), F.count_if(F.col("winner") != 0).alias("retakes"), F.max("wer").alias("worst_wer"))
