"""The sequence functions for SQL users, and mining as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Temporary SQL functions; they are inlined into the plan like any expression.
FUNCTIONS = {
    "rev_comp(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))",
    "gc_content(s STRING) RETURNS DOUBLE": "IF(length(s) = 0, 0D, (length(s) - length(translate(upper(s), 'GC', ''))) / length(s))",
    "probe_key(seq_id STRING, a INT, b INT) RETURNS STRING": "concat(seq_id, ':', a, '-', b)",
}


@udtf(returnType="start int, stop int, probe_seq string, tm double")
class MineProbes:
    """``SELECT * FROM s, LATERAL mine_probes(s.seq)``: the probes of one sequence by the default settings.

    A row's sequence is worked on whole; long sequences are for the operator ``mine``.
    """

    def eval(self, seq: str):
        import numpy as np

        from hybrispark.operators.mining import MiningConfig, _choose, _CODE, _Grid

        cfg = MiningConfig()
        text = (seq or "").upper()
        if len(text) < cfg.max_length:
            return
        code = _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
        place, size, tm = _choose(_Grid(code, cfg), np.arange(len(text) - cfg.max_length + 1), cfg)
        for a, n, t in zip(place.tolist(), size.tolist(), np.round(tm, 2).tolist()):
            yield a, a + n, text[a : a + n], t


def register(spark: SparkSession) -> None:
    """Make the functions known to a session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("mine_probes", MineProbes)
