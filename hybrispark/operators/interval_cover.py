"""Overlapping and gapped intervals: continuous stretches and the gaps between.

Every interval is decomposed into canonical dyadic blocks (a block of level l
covers ``[i * 2**l, (i + 1) * 2**l)``).  Blocks covered by an ancestor are
removed, sibling pairs are merged upward and adjacent blocks coalesced.  This
is done over runs of rows before anything is shuffled, so that an entity with
any number of rows sends only the stretches they cover; then again by entity
and tile of positions, which divides a hot entity over many tasks.  How far each
tile's stretches reach, a row a tile, tells where those of later tiles go on
from them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of dyadic blocks; shifted positions are at most 2**LEVELS.
LEVELS = 33
_OFFSET = 1 << 31


def dyadic_blocks(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct canonical blocks (group, level, index) of the intervals [lo, hi)."""
    groups, levels, indexes = [], [], []
    lo, hi = lo.copy(), hi.copy()
    for level in range(LEVELS):
        live = lo < hi
        if not live.any():
            break
        group, lo, hi = group[live], lo[live], hi[live]
        odd = (lo & 1) == 1
        groups.append(group[odd])
        indexes.append(lo[odd])
        levels.append(np.full(int(odd.sum()), level))
        lo = lo + odd
        odd = ((hi & 1) == 1) & (lo < hi)
        hi = hi - odd
        groups.append(group[odd])
        indexes.append(hi[odd])
        levels.append(np.full(int(odd.sum()), level))
        lo, hi = lo >> 1, hi >> 1
    if not groups:
        return group[:0], group[:0], group[:0]
    return np.concatenate(groups), np.concatenate(levels), np.concatenate(indexes)


def merge_blocks(group: np.ndarray, level: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (group, start, end) covered by the blocks of each group.

    All groups are worked on at once: first the covered blocks go, then
    siblings are merged level by level, then adjacent blocks are coalesced.
    """
    start, end = index << level, (index + 1) << level
    order = np.lexsort((-level, start, group))
    group, level, start, end = group[order], level[order], start[order], end[order]
    if not len(group):
        return group, start, end
    # Dyadic blocks nest or are disjoint: with ancestors first, a block is
    # covered if and only if it ends no later than the furthest end before it.
    span = np.int64(1) << 33
    reach = np.maximum.accumulate(end + group * span)
    keep = np.ones(len(group), bool)
    keep[1:] = (end + group * span)[1:] > reach[:-1]
    group, level, start = group[keep], level[keep], start[keep]
    for now in range(int(level.min()), int(level.max()) + LEVELS):
        at = np.flatnonzero(level == now)
        if len(at) >= 2:
            g, i = group[at], start[at] >> now
            pair = np.flatnonzero((g[1:] == g[:-1]) & (i[:-1] % 2 == 0) & (i[1:] == i[:-1] + 1))
            if len(pair):
                level[at[pair]] += 1
                gone = np.ones(len(group), bool)
                gone[at[pair + 1]] = False
                group, level, start = group[gone], level[gone], start[gone]
        if not (level > now).any():
            break
    end = start + (np.int64(1) << level)
    fresh = np.ones(len(group), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (start[1:] != end[:-1])
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(group)) - 1
    return group[heads], start[heads], end[tails]


def _entities(table: pa.Table, columns: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """A number for the entity of each row, told by some columns, and one row of each entity."""
    code = np.zeros(table.num_rows, np.int64)
    for i in columns:
        part = table.column(i).combine_chunks().dictionary_encode()
        code = code * (len(part.dictionary) + 1) + part.indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code, return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def cover_and_gaps(
    df: DataFrame,
    keys: Sequence[str],
    start_col: str,
    end_col: str,
    tile_bits: int = 14,
    rows_per_run: int = 250_000,
) -> DataFrame:
    """Per entity, each longest covered stretch (``span``) and uncovered ``gap``.

    Bounds are inclusive integers; the result has the key columns, ``kind``,
    ``seg_start`` and ``seg_end``, both inclusive.  Rows with a null key, a
    null bound or start after end are no intervals and give nothing; repeated
    rows change nothing; intervals that touch form one stretch.  An empty table
    gives an empty result; further columns of ``df`` are ignored, whatever
    their names.  ``rows_per_run`` bounds the rows a task holds at once.
    """
    keys = list(keys)
    names = [f"__k{i}" for i in range(len(keys))]
    width = len(names)
    rows = df.select(
        *[df[k].alias(n) for k, n in zip(keys, names)],
        # Shifted so that negative positions are non-negative as well.
        (df[start_col].cast("long") + _OFFSET).alias("__s"),
        (df[end_col].cast("long") + (_OFFSET + 1)).alias("__e"),
    ).where("__s < __e")
    for n in names:
        rows = rows.where(F.col(n).isNotNull())
    schema = T.StructType(
        [
            # Nulls are gone, and a join by these columns needn't look for them.
            *[T.StructField(n, df.schema[k].dataType, False) for k, n in zip(keys, names)],
            T.StructField("__s", T.LongType(), False),
            T.StructField("__e", T.LongType(), False),
        ]
    )

    def merged(run: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(run)
        entity, first = _entities(table, range(width))
        lo, hi = (table.column(width + i).to_numpy() for i in (0, 1))
        g, s, e = merge_blocks(*dyadic_blocks(entity, lo, hi))
        at = pa.array(first[g])
        columns = [table.column(i).combine_chunks().take(at) for i in range(width)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(s), pa.array(e)], names=schema.fieldNames())

    def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if batch.num_rows:
                run.append(batch)
                held += batch.num_rows
            if held >= rows_per_run:
                yield merged(run)
                run, held = [], 0
        if run:
            yield merged(run)

    tiled = rows.mapInArrow(merge_runs, schema).withColumn("__t", F.shiftright("__s", tile_bits))
    tiles = tiled.repartition(*names, "__t").sortWithinPartitions(*names, "__t")

    def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows of about ``rows_per_run``, no tile of an entity divided."""
        run: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            run.append(batch)
            held += batch.num_rows
            if held < rows_per_run:
                continue
            table = pa.Table.from_batches(run)
            code, _ = _entities(table, [*range(width), width + 2])
            cut = int(np.flatnonzero(code != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0
            if cut:
                yield table.slice(0, cut)
            run = table.slice(cut).to_batches()
            held = table.num_rows - cut
        if run:
            yield pa.Table.from_batches(run)

    def covered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The stretches of each entity and tile in order, and one row of each."""
        group, first = _entities(table, [*range(width), width + 2])
        lo, hi = (table.column(width + i).to_numpy() for i in (0, 1))
        g, s, e = merge_blocks(*dyadic_blocks(group, lo, hi))
        return g, s, e, first

    def keys_of(table: pa.Table, at: np.ndarray) -> list[pa.Array]:
        return [table.column(i).combine_chunks().take(pa.array(at)) for i in range(width)]

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tiles(batches):
            g, _, e, first = covered(table)
            last = np.append(g[1:] != g[:-1], True)
            at = first[g[last]]
            columns = [*keys_of(table, at), table.column(width + 2).combine_chunks().take(pa.array(at)), pa.array(e[last])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "__t", "__end"])

    keyed = [T.StructField(n, df.schema[k].dataType, False) for k, n in zip(keys, names)]
    place = T.StructField("__t", T.LongType(), False)
    ends = tiles.mapInArrow(reaches, T.StructType([*keyed, place, T.StructField("__end", T.LongType(), False)]))
    # A row a tile; an entity has at most 2 ** (LEVELS - tile_bits) of them.
    entity = Window.partitionBy(*names).orderBy("__t")
    reached = ends.select(
        *names,
        "__t",
        F.coalesce(F.max("__end").over(entity.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)).alias("__reach"),
        F.lead("__t").over(entity).isNull().alias("__last"),
    )

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tiles(batches):
            g, s, e, first = covered(table)
            reach = table.column(width + 3).to_numpy()[first][g]
            final = table.column(width + 4).to_numpy(zero_copy_only=False)[first][g]
            head = np.append(True, g[1:] != g[:-1])
            tail = np.append(g[1:] != g[:-1], True)
            # Stretches that begin within the reach of earlier tiles go on from them.
            fresh = s > reach
            before = np.where(head, reach, np.maximum(reach, np.append(-1, e[:-1])))
            gap = fresh & (before >= 0)
            # A stretch ends in its tile if the next begins there, too.
            inner = fresh & ~tail
            opens = fresh & tail
            closes = gap & (head | ~np.append(False, fresh[:-1]))
            ending = tail & final
            parts = [
                (first[g[inner]], "span", s[inner], e[inner]),
                (first[g[gap]], "gap", before[gap], s[gap]),
                (first[g[opens]], "open", s[opens], s[opens]),
                (first[g[closes]], "close", before[closes], before[closes]),
                (first[g[ending]], "close", np.maximum(reach, e)[ending], np.maximum(reach, e)[ending]),
            ]
            at, kind = np.concatenate([p[0] for p in parts]), [p[1] for p in parts for _ in range(len(p[0]))]
            columns = [*keys_of(table, at), pa.array(kind, pa.string()), *(pa.array(np.concatenate([p[c] for p in parts])) for c in (2, 3))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "kind", "__s", "__e"])

    joined = tiles.join(reached, [*names, "__t"]).select(*names, "__s", "__e", "__t", "__reach", "__last")
    found = joined.sortWithinPartitions(*names, "__t").mapInArrow(
        stretches, T.StructType([*schema.fields[:width], T.StructField("kind", T.StringType()), T.StructField("__s", T.LongType()), T.StructField("__e", T.LongType())])
    )
    # Stretches that end in another tile: an end follows each beginning, at most two rows a tile.
    order = Window.partitionBy(*names).orderBy("__s", F.col("kind"))
    edges = found.where("kind IN ('open', 'close')").withColumn("__e", F.lead("__s").over(order)).where("kind = 'open'")
    rows_out = found.where("kind IN ('span', 'gap')").unionByName(edges.withColumn("kind", F.lit("span")))
    return rows_out.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)],
        "kind",
        (F.col("__s") - _OFFSET).cast("int").alias("seg_start"),
        (F.col("__e") - (_OFFSET + 1)).cast("int").alias("seg_end"),
    )
