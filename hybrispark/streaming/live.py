"""Mining and scoring on streams: additions beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hybrispark.errors import ConfigurationError
from hybrispark.operators.mining import MiningConfig, mine
from hybrispark.operators.scoring import label_on_target, score_probes


def mine_stream(sequences: DataFrame, id_col: str = "seq_id", seq_col: str = "seq", cfg: MiningConfig = MiningConfig()) -> DataFrame:
    """Probes of sequences as they arrive; a row function without state.

    Selection by spacing needs a whole sequence in order and is for batches only.
    """
    if cfg.spaced:
        raise ConfigurationError("overlap=False and spacing need a batch")
    return mine(sequences, id_col, seq_col, cfg)


def score_stream(merged: DataFrame, pred_column: str, checkpoint: str, path: str, event_time: str | None = None, delay: str = "1 hour") -> StreamingQuery:
    """Running scores, of each micro-batch those that changed, appended to a table at ``path`` with the batch's number.

    The newest row of a key holds its scores.  With ``event_time`` scores are
    kept by hour of that time and dropped from the state ``delay`` after it, so
    that the state is bounded; without it the state holds every key.
    """
    if event_time is None:
        scores = score_probes(merged, pred_column)
    else:
        labelled = label_on_target(merged).withWatermark(event_time, delay)
        part = lambda wanted: F.coalesce(F.sum(F.when(F.col("on_target") == wanted, F.col(pred_column))), F.lit(0.0))
        hour = F.window(event_time, "1 hour").alias("hour")
        grouped = labelled.where("seqid IS NOT NULL").groupBy("seqid", hour)
        scores = grouped.agg(part(True).alias("on_target_score"), part(False).alias("off_target_score")).select("seqid", F.col("hour.start").alias("hour"), "on_target_score", "off_target_score")

    def append(batch: DataFrame, number: int) -> None:
        # A batch that is repeated replaces what it wrote.
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scores.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).start()
