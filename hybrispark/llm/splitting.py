"""Splitting oversized items into pieces at natural boundaries, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_space = re.compile(r"\s+")


def piece_bounds(n: int, boundaries: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece of an item of ``n`` tokens.

    ``boundaries`` is sorted.  A piece ends at the last boundary within the
    limit that brings the next piece forward, found by binary search, else at
    the limit; the next piece steps back by the overlap.
    """
    out, p = [], 0
    while n - p > limit:
        i = bisect_right(boundaries, p + limit) - 1
        end = boundaries[i] if i >= 0 and boundaries[i] > p + overlap else p + limit
        out.append((p, end))
        p = end - overlap
    out.append((p, n))
    return out


def natural_boundaries(text: str, run: str, at_least: int) -> tuple[str, list[int]]:
    """A text without white space, and the sorted places right after its boundary runs.

    A boundary run is a longest run of at least ``at_least`` letters of
    ``run``.  Tokens are these runs and what lies between them; the prefix sums
    of their lengths are the offsets, of which those after a run count, but not
    the end of the text.
    """
    s = _space.sub("", text)
    tokens = re.split(f"([{re.escape(run)}]{{{at_least},}})", s)
    offsets = np.cumsum([len(t) for t in tokens])
    return s, [int(x) for x in offsets[1::2] if x < len(s)]


def split_items(
    df: DataFrame,
    id_col: str = "mine_id",
    text_col: str = "seq",
    limit_col: str = "chunk_size",
    overlap_col: str = "max_length",
    default_limit: int = 100_000,
    run: str = "Nn",
    at_least: int = 10,
    with_text: bool = False,
) -> DataFrame:
    """(id, piece_no, piece_start, piece_end) of every piece, 0-based and end exclusive.

    The limit is that of the row, ``default_limit`` where it is null; pieces
    overlap by one less than ``overlap_col``.  Rows with a null, empty or blank
    text, a null overlap or a limit not greater than the overlap (zero and
    negative ones too) give nothing.  ``with_text`` adds the piece itself.

    Repeated deliveries count once; deliveries of an id that differ each give
    their pieces, equal ones of which are one without texts.  A null id is an
    id of its own.  An empty table gives an empty result.
    """
    id_type = df.schema[id_col].dataType
    fields = [
        T.StructField(id_col, id_type),
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("piece_start", T.IntegerType()),
        T.StructField("piece_end", T.IntegerType()),
    ]
    if with_text:
        fields.append(T.StructField("piece", T.StringType()))
    schema = T.StructType(fields)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, limit, width = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                limit = default_limit if limit is None else limit
                if not text or width is None or limit <= width - 1:
                    continue
                whole, ends = natural_boundaries(text, run, at_least)
                if not whole:
                    continue
                pieces = piece_bounds(len(whole), ends, limit, max(width - 1, 0))
                starts, stops = zip(*pieces)
                columns = [
                    batch.column(0).take(pa.array([i] * len(pieces))),
                    pa.array(range(1, len(pieces) + 1), pa.int32()),
                    pa.array(starts, pa.int32()),
                    pa.array(stops, pa.int32()),
                ]
                if with_text:
                    columns.append(pa.array([whole[a:b] for a, b in pieces], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    rows = df.select(df[id_col], df[text_col], df[limit_col].cast("long"), df[overlap_col].cast("long")).where(F.length(df[text_col]) > 0)
    # Bounds are shuffled to count repeated deliveries once; with texts the texts are, which are shorter than their pieces.
    return rows.distinct().mapInArrow(split, schema) if with_text else rows.mapInArrow(split, schema).distinct()
