"""Mining of candidate probes from sequences, a distributed table function.

Sequences are cut into chunks with a halo, so that a chromosome is many rows
and one task never holds more than its batches; each batch of chunks is one
flat array over which prefix sums give every window's energies and counts.
``mine_native`` declares the same with window functions only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hybrispark.errors import ConfigurationError
from hybrispark.functions import thermo
from hybrispark.functions.thermo import Conditions
from hybrispark.operators.spacing import select_spaced

PROBE_SCHEMA = "seq_id string, start int, stop int, probe_seq string, tm double"


@dataclass(frozen=True)
class MiningConfig:
    """Settings of a mining run; the defaults suit hybridisation in 50 % formamide."""

    min_length: int = 30
    max_length: int = 37
    min_tm: float = 42
    max_tm: float = 47
    tm_target: float | None = None
    overlap: bool = True
    spacing: int = 0
    exhaustive: bool = False
    max_homopolymer: int | None = 4
    prohibited: tuple[str, ...] = ()
    min_gc: float = 20
    max_gc: float = 80
    chunk_size: int = 100_000
    conditions: Conditions = field(default_factory=Conditions)

    def __post_init__(self):
        if not 2 <= self.min_length <= self.max_length:
            raise ConfigurationError("lengths must satisfy 2 <= min_length <= max_length")
        if self.exhaustive and (not self.overlap or self.spacing > 0):
            raise ConfigurationError("exhaustive mining excludes overlap=False and spacing")
        if self.chunk_size < self.max_length:
            raise ConfigurationError("chunk_size must be at least max_length")

    @property
    def spaced(self) -> bool:
        return not self.overlap or self.spacing > 0

    @property
    def motifs(self) -> list[str]:
        """Prohibited words that can occur in a probe without other letters than A, C, G, T."""
        words = {p.upper() for p in self.prohibited if p}
        return sorted(w for w in words if len(w) <= self.max_length and not set(w) - set("ACGT"))


def config(**settings) -> MiningConfig:
    """A MiningConfig from flat settings; concentrations may be among them."""
    salts = {k: settings.pop(k) for k in list(settings) if k in Conditions.__dataclass_fields__}
    if "prohibited" in settings:
        settings["prohibited"] = tuple(settings["prohibited"] or ())
    return MiningConfig(**settings, conditions=Conditions(**salts))


def chunks(df: DataFrame, id_col: str, seq_col: str, size: int, halo: int, before: int = 0, keep_case: bool = False) -> DataFrame:
    """(seq_id, offset, total, piece): pieces of ``size`` letters, each with ``halo`` more of what follows.

    A piece begins at ``offset``, or up to ``before`` letters ahead of it where
    there are as many.  Pieces are in upper case unless ``keep_case``; letters beyond ASCII, which are no bases, come
    out as N.  Cutting bytes takes time in proportion to the sequence, however
    many pieces it gives.  Null and empty sequences give nothing.
    """
    ascii_only = F.when(F.col("s").rlike(r"[^\x00-\x7F]"), F.regexp_replace("s", r"[^\x00-\x7F]", "N")).otherwise(F.col("s"))
    rows = df.select(df[id_col].alias("seq_id"), df[seq_col].alias("s")).where("s <> ''").select("seq_id", ascii_only.cast("binary").alias("s"))
    starts = F.sequence(F.lit(0), F.octet_length("s") - 1, F.lit(size))
    ahead = lambda o: F.least(o, F.lit(before))
    piece = lambda o: F.substr("s", o + 1 - ahead(o), ahead(o) + (size + halo))
    pieces = F.transform(starts, lambda o: F.struct(o.alias("offset"), piece(o).alias("piece")))
    cut = rows.select("seq_id", F.octet_length("s").alias("total"), F.explode(pieces).alias("x"))
    text = F.col("x.piece").cast("string")
    return cut.select("seq_id", "x.offset", "total", (text if keep_case else F.upper(text)).alias("piece"))


_CODE = np.full(256, 4, np.uint8)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    for _c in _pair:
        _CODE[_c] = _i


def _windows(values: np.ndarray, width: int, n: int) -> np.ndarray:
    """Sums of ``values[i : i + width]`` for i below n."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[width : width + n] - sums[:n]


class _Grid:
    """Every window of a flat array of base codes: energies and flags by length."""

    def __init__(self, code: np.ndarray, cfg: MiningConfig):
        self.code, self.cfg = code, cfg
        dh, ds = thermo.pair_tables()
        self.end_h, self.end_s = thermo.terminal_tables()
        pair = 5 * code[:-1].astype(np.int32) + code[1:]
        self.sums = [np.concatenate([[0], np.cumsum(x[pair], dtype=np.int64)]) for x in (dh, ds)]
        self.bad = np.concatenate([[0], np.cumsum(code == 4)])
        self.gc = np.concatenate([[0], np.cumsum((code == 1) | (code == 2))])
        self.flags: list[tuple[int, np.ndarray]] = []
        if cfg.max_homopolymer is not None:
            r = cfg.max_homopolymer + 1
            if r == 1:
                same = np.ones(len(code), bool)
            else:
                same = _windows((code[1:] == code[:-1]), r - 1, max(len(code) - r + 1, 0)) == r - 1
            self.flags.append((r, np.concatenate([[0], np.cumsum(same)])))
        for motif in cfg.motifs:
            m = len(motif)
            here = np.ones(max(len(code) - m + 1, 0), bool)
            for i, b in enumerate(motif):
                here &= code[i : i + len(here)] == "ACGT".index(b)
            self.flags.append((m, np.concatenate([[0], np.cumsum(here)])))

    def length(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Tm of the windows of some length that begin at the places, and whether each is allowed."""
        c = self.cfg.conditions
        first, last = self.code[at], self.code[at + size - 1]
        h, s = (sums[at + size - 1] - sums[at] for sums in self.sums)
        h = h + self.end_h[first] + self.end_h[last]
        s = s + self.end_s[first] + self.end_s[last]
        tm = (h / 10 * 1000) / (s / 10 + c.salt_term(size) + c.strand_term) - thermo.KELVIN - c.depression
        ok = self.bad[at + size] == self.bad[at]
        for width, sums in self.flags:
            if width <= size:
                ok &= sums[at + size - width + 1] == sums[at]
        return tm, ok & (tm >= self.cfg.min_tm) & (tm <= self.cfg.max_tm)


def _choose(grid: _Grid, at: np.ndarray, cfg: MiningConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and Tm of the probes taken at the possible starts."""
    size, tm, gap = np.zeros(len(at), np.int32), np.zeros(len(at)), np.full(len(at), np.inf)
    every: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for length in range(cfg.min_length, cfg.max_length + 1):
        t, ok = grid.length(at, length)
        if cfg.exhaustive:
            every.append((at[ok], np.full(int(ok.sum()), length, np.int32), t[ok]))
            continue
        if cfg.tm_target is None:
            better = ok & (size == 0)
        else:
            far = np.abs(t - cfg.tm_target)
            better = ok & (far < gap)
            gap[better] = far[better]
        size[better], tm[better] = length, t[better]
    if cfg.exhaustive:
        place, size, tm = (np.concatenate(x) for x in zip(*every))
        order = np.lexsort((size, place))
        place, size, tm = place[order], size[order], tm[order]
    else:
        taken = size > 0
        place, size, tm = at[taken], size[taken], tm[taken]
    # Composition is judged after a length is chosen: a start whose choice fails is lost.
    gc = (grid.gc[place + size] - grid.gc[place]) / size * 100
    fine = (gc >= cfg.min_gc - 1e-9) & (gc <= cfg.max_gc + 1e-9)
    return place[fine], size[fine], tm[fine]


def mine(df: DataFrame, id_col: str = "seq_id", seq_col: str = "seq", cfg: MiningConfig = MiningConfig()) -> DataFrame:
    """(seq_id, start, stop, probe_seq, tm) of the probes of every sequence, 0-based and half open.

    Starts run to ``length - max_length``.  Each start takes its shortest
    allowed length, or that of the Tm nearest ``tm_target`` (the shorter of
    equals), or every one if ``exhaustive``.  Bounds of Tm are inclusive and
    hold before rounding to 2 decimals.  Null, empty and short sequences give
    nothing; rows with a null id are mined like others; equal rows each give
    their probes.  With ``overlap=False`` or ``spacing`` ids must be unique.
    """
    return mine_pieces(chunks(df, id_col, seq_col, cfg.chunk_size, cfg.max_length - 1), cfg)


def mine_pieces(pieces: DataFrame, cfg: MiningConfig = MiningConfig()) -> DataFrame:
    """As mine(), of sequences that are cut already as chunks() cuts them, by ``chunk_size`` with a halo of ``max_length - 1``."""
    schema = T._parse_datatype_string(PROBE_SCHEMA)
    schema = T.StructType([T.StructField("seq_id", pieces.schema["seq_id"].dataType), *schema.fields[1:]])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, held = 0, 0
            lengths = [len(x) for x in batch.column(3).to_pylist()]
            for i, n in enumerate(lengths):
                held += n + 1
                if held >= 500_000 or i == len(lengths) - 1:
                    yield from _search(batch.slice(low, i + 1 - low))
                    low, held = i + 1, 0

    def _search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(3).to_pylist()
        offset, total = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(sizes + 1) - sizes - 1
        flat = "\n".join(texts)
        code = _CODE[np.frombuffer(flat.encode("ascii", "replace"), np.uint8)]
        # Starts of this chunk only, and none whose longest probe leaves the sequence.
        count = np.clip(np.minimum(total - offset - cfg.max_length + 1, cfg.chunk_size), 0, None)
        if not count.sum():
            return
        row = np.repeat(np.arange(len(texts)), count)
        at = np.repeat(base - (np.cumsum(count) - count), count) + np.arange(len(row))
        place, size, tm = _choose(_Grid(code, cfg), at, cfg)
        row = np.searchsorted(base, place, "right") - 1
        start = (place - base[row] + offset[row]).astype(np.int32)
        words = [flat[a : a + n] for a, n in zip(place.tolist(), size.tolist())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(row)),
                pa.array(start),
                pa.array(start + size, pa.int32()),
                pa.array(words, pa.string()),
                pa.array(np.round(tm, 2)),
            ],
            names=schema.fieldNames(),
        )

    found = pieces.mapInArrow(search, schema)
    if cfg.spaced:
        found = select_spaced(found, "seq_id", "start", "stop", cfg.spacing, cfg.max_length)
    return found


def tm_grid(df: DataFrame, id_col: str, seq_col: str, cfg: MiningConfig = MiningConfig(), summary: bool = True) -> DataFrame:
    """Tm of every window: (seq_id, start, length, tm), or by sequence and length its count, extremes and mean.

    Windows with other letters than A, C, G, T don't count.  The summary is
    added up within each batch before it is shuffled.
    """
    pieces = chunks(df, id_col, seq_col, cfg.chunk_size, cfg.max_length - 1)
    key = T.StructField("seq_id", df.schema[id_col].dataType)
    i, d = T.IntegerType(), T.DoubleType()
    fields = [("length", i), ("n", T.LongType()), ("low", d), ("high", d), ("total", d)] if summary else [("start", i), ("length", i), ("tm", d)]
    schema = T.StructType([key, *(T.StructField(n, t) for n, t in fields)])
    loose = replace(cfg, min_tm=-1e9, max_tm=1e9, max_homopolymer=None, prohibited=())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                offset, total, text = (batch.column(c)[r].as_py() for c in (1, 2, 3))
                code = _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
                if len(code) < 2:
                    continue
                grid = _Grid(code, loose)
                for size in range(cfg.min_length, cfg.max_length + 1):
                    at = np.arange(max(min(total - offset - cfg.max_length + 1, cfg.chunk_size), 0))
                    tm, ok = grid.length(at, size)
                    tm, at = tm[ok], at[ok]
                    if not len(tm):
                        continue
                    if summary:
                        cols = [[size], [len(tm)], [tm.min()], [tm.max()], [tm.sum()]]
                    else:
                        cols = [at + offset, np.full(len(tm), size), tm]
                    kinds = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([r] * len(cols[0]))),
                            *(pa.array(np.asarray(c), kind) for c, kind in zip(cols, kinds)),
                        ],
                        names=schema.fieldNames(),
                    )

    found = pieces.mapInArrow(search, schema)
    if not summary:
        return found
    return found.groupBy("seq_id", "length").agg(
        F.sum("n").alias("n_windows"),
        F.min("low").alias("min_tm"),
        F.max("high").alias("max_tm"),
        (F.sum("total") / F.sum("n")).alias("mean_tm"),
    )
