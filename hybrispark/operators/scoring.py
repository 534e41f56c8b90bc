"""Merging probes with alignments and scoring their on- and off-target binding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_alignments(probes: DataFrame, alignments: DataFrame, key: str = "seqid") -> DataFrame:
    """Each probe with each of its alignments; probes without one are left out, null keys never match.

    Columns of the alignments that the probes have too are dropped.
    """
    extra = [c for c in alignments.columns if c == key or c not in probes.columns]
    return probes.join(alignments.select(*extra).hint("merge"), key)


def label_on_target(df: DataFrame) -> DataFrame:
    """Adds ``on_target``: the alignment lies where the probe came from (same sequence and start)."""
    same = (F.col("align_seqid") == F.col("seq_id")) & (F.col("align_start") == F.col("start"))
    return df.withColumn("on_target", F.coalesce(same, F.lit(False)))


def score_probes(df: DataFrame, pred_column: str = "duplex_pred", key: str = "seqid") -> DataFrame:
    """(seqid, on_target_score, off_target_score): sums of predictions at and off the target.

    One conditional aggregation with a map-side part.  A missing side is 0,
    null predictions add nothing, rows with a null key are left out.
    """
    labelled = df if "on_target" in df.columns else label_on_target(df)
    part = lambda wanted: F.coalesce(F.sum(F.when(F.col("on_target") == wanted, F.col(pred_column))), F.lit(0.0))
    return (
        labelled.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(part(True).alias("on_target_score"), part(False).alias("off_target_score"))
    )
