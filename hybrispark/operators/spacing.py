"""Greedy selection of probes that don't overlap, or keep a spacing.

What a scan keeps of a stretch of a sequence depends on nothing before it but
where the last kept probe ended, and a probe reaches no further than its
length.  So a sequence is divided into parts; for each part every stop a scan
may enter with is followed to the stop it leaves with; the small maps of a
sequence's parts are composed in order; then all parts are scanned at once,
each from the stop it is entered with.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def _chain(start: np.ndarray, stop: np.ndarray, last: int, gap: int) -> tuple[list[int], int]:
    """Places kept when each start must be at least ``gap`` beyond the last stop, jumping by binary search."""
    kept, at = [], 0
    while True:
        at += int(np.searchsorted(start[at:], last + gap))
        if at >= len(start):
            return kept, last
        kept.append(at)
        last = int(stop[at])
        at += 1


def _exits(start: np.ndarray, stop: np.ndarray, last: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the stop a part is left with by the stop it is entered with, up to ``last``.

    A stop entered with goes by the first step that isn't lower; beyond all of
    them it leaves as it came.  Each probe leads to the first that begins far
    enough beyond its stop; the chains are followed from behind, each probe once.
    """
    after = np.searchsorted(start, stop + gap).tolist()
    leave = stop.tolist()
    for i in range(len(leave) - 1, -1, -1):
        # Behind itself at least, for probes without length.
        following = max(after[i], i + 1)
        if following < len(leave):
            leave[i] = leave[following]
    steps, out = start - gap, np.array(leave)
    some = int(np.searchsorted(steps, last)) + 1
    steps, out = steps[:some], out[:some]
    # Of equal starts the first counts.
    heads = np.flatnonzero(np.append(True, steps[1:] != steps[:-1]))
    steps, out = steps[heads], out[heads]
    ends = np.flatnonzero(np.append(out[1:] != out[:-1], True))
    return steps[ends], out[ends]


def select_spaced(df: DataFrame, key: str, start: str, stop: str, spacing: int = 0, longest: int | None = None, part: int = 1 << 17) -> DataFrame:
    """The rows a scan by start keeps: each begins no earlier than the last kept stop plus ``spacing``.

    The scan begins at stop -1.  Equal starts go by the smaller stop.  A null
    key is one of its own.  Null bounds are an error.  ``longest`` is the
    greatest length of a row, found by an aggregate where it isn't given.

    A sequence is scanned in parts of ``part`` places, so a long one is spread
    over many tasks; of each part only how entered stops become left ones is
    brought together, in the order of a sequence's parts.
    """
    gap = max(spacing, 0)
    if longest is None:
        longest = df.agg(F.max(F.col(stop) - F.col(start))).first()[0] or 0
    names = df.columns
    a, b = names.index(start), names.index(stop)
    g, p = len(names), len(names) + 2
    # Keys that are never null, so that rows of a part are shuffled once and stay where they are when joined.
    place = F.coalesce(F.floor(F.col(start) / part).cast("int"), F.lit(0))
    keyed = df.withColumns({"__null": F.col(key).isNull(), "__key": F.coalesce(F.col(key).cast("string"), F.lit("")), "__part": place})
    parts = keyed.repartition("__null", "__key", "__part").sortWithinPartitions("__null", "__key", "__part", start, stop)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows of each part, one table at a time."""
        held: list[pa.RecordBatch] = []
        current: object = None
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(g + 1).dictionary_encode().indices.to_numpy()
            null = batch.column(g).to_numpy(zero_copy_only=False)
            number = batch.column(p).to_numpy()
            fresh = (code[1:] != code[:-1]) | (number[1:] != number[:-1]) | (null[1:] != null[:-1])
            edges = [0, *(np.flatnonzero(fresh) + 1).tolist(), len(code)]
            for lo, hi in zip(edges, edges[1:]):
                this = tuple(batch.column(c)[lo].as_py() for c in (g, g + 1, p))
                if held and this != current:
                    yield pa.Table.from_batches(held)
                    held = []
                current = this
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield pa.Table.from_batches(held)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            begin, end = (table.column(c).to_numpy().astype(np.int64) for c in (a, b))
            null, name, number = (table.column(c)[0].as_py() for c in (g, g + 1, p))
            # A stop of an earlier part lies less than a length beyond its end.
            steps, leave = _exits(begin, end, number * part + longest, gap)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([null]),
                    pa.array([name], pa.string()),
                    pa.array([number], pa.int32()),
                    pa.array([steps.tolist()], pa.list_(pa.int64())),
                    pa.array([leave.tolist()], pa.list_(pa.int64())),
                ],
                names=["__null", "__key", "__part", "steps", "leave"],
            )

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = None
        last = -1
        for batch in batches:
            entered = []
            for null, name, steps, leave in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4))):
                if (null, name) != current:
                    current, last = (null, name), -1
                entered.append(last)
                at = bisect_left(steps, last)
                last = leave[at] if at < len(steps) else last
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(entered, pa.int64())], names=["__null", "__key", "__part", "__last"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            begin, end = table.column(a).to_numpy(), table.column(b).to_numpy()
            kept, _ = _chain(begin, end, table.column(p + 1)[0].as_py(), gap)
            if kept:
                yield from table.take(pa.array(kept)).select(range(g)).combine_chunks().to_batches()

    found = parts.mapInArrow(maps, "__null boolean, __key string, __part int, steps array<bigint>, leave array<bigint>")
    ordered = found.repartition("__null", "__key").sortWithinPartitions("__null", "__key", "__part")
    entered = ordered.mapInArrow(compose, "__null boolean, __key string, __part int, __last bigint")
    joined = parts.join(entered, ["__null", "__key", "__part"]).select(*names, "__null", "__key", "__part", "__last")
    return joined.sortWithinPartitions("__null", "__key", "__part", start, stop).mapInArrow(scan, df.schema)
