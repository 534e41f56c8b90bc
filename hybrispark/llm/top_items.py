"""The top N items within every group, with a tie rule that leaves nothing to chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rnk") -> DataFrame:
    """Rows of rank 1 to ``n`` in each group, with their rank.

    The rank filter over ``row_number`` lets the optimiser's group limit cut
    every group to ``n`` rows a task before the shuffle, so that no task
    receives a hot group whole, and again after it.  ``order`` must end in a
    column that tells any two items of a group apart; rows equal in all of it
    are interchangeable.  Rows with a null group are left out.  An empty table
    gives an empty result.
    """
    window = Window.partitionBy(*groups).orderBy(*order)
    rows = df
    for g in groups:
        rows = rows.where(F.col(g).isNotNull())
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def best_scores(scoring: DataFrame, item: str = "seqid", score: str = "on_target_score") -> DataFrame:
    """The highest score of each item; null and NaN scores and null items don't count."""
    known = scoring.select(item, score).where(F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    return known.groupBy(item).agg(F.max(score).alias(score))


def top_probes(probes: DataFrame, scoring: DataFrame, n: int = 5) -> DataFrame:
    """(seq_id, rnk, seqid): for each sequence its ``n`` probes of the highest score.

    A probe is a distinct seqid; rows with a null seq_id or seqid don't count,
    nor do probes without a score.  Equal scores go by smaller start, then
    smaller stop (nulls last), then seqid.
    """
    known = probes.select("seqid", "seq_id", "start", "stop").where("seq_id IS NOT NULL AND seqid IS NOT NULL")
    # One row a probe, combined before the shuffle; both sides are then hashed by seqid.
    distinct = known.groupBy("seqid", "seq_id").agg(F.min("start").alias("start"), F.min("stop").alias("stop"))
    scored = distinct.join(best_scores(scoring), "seqid")
    order = [
        F.col("on_target_score").desc(),
        F.col("start").asc_nulls_last(),
        F.col("stop").asc_nulls_last(),
        F.col("seqid").asc(),
    ]
    return top_n_per_group(scored, ["seq_id"], order, n).select("seq_id", "rnk", "seqid")
