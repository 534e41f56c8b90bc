"""Similarity of probes to a genome: complete seed-and-extend search with joins.

A seed is a stretch of letters a probe and the genome have in common.  Any seed
of ``seed`` letters holds every word of ``WORD`` letters that begins in a run of
``seed - WORD + 1`` places, so it is enough to take all words on one side and
each ``stride``-th on the other.  Words are whole numbers, the smaller of both
strands', and each carries the letters around it: what a join by word finds is
extended and scored at once, in Arrow batches, without a second join.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybrispark.errors import ConfigurationError, ReferenceIndexError
from hybrispark.operators import bases, gaps
from hybrispark.operators.gaps import MATCH, MISMATCH
from hybrispark.operators.mining import chunks
from hybrispark.operators.sam import fetch_sequences
from hybrispark.session import checkpointed


@dataclass(frozen=True)
class Preset:
    """Length of seeds and how alignments are scored."""

    seed: int = 20
    local: bool = True

    def least(self, length: Column) -> Column:
        """The lowest score that counts for a probe of some length."""
        if self.local:
            return F.lit(20.0) + 8.0 * F.log(length.cast("double"))
        return F.lit(-0.6) - 0.6 * length


#: Usual presets of the public aligner: seed lengths by name, fixed values.  The
#: search is complete, so the presets' limits of effort have no counterpart.
PRESETS = {
    "very-fast": Preset(22, False),
    "fast": Preset(22, False),
    "sensitive": Preset(22, False),
    "very-sensitive": Preset(20, False),
    "very-fast-local": Preset(25, True),
    "fast-local": Preset(22, True),
    "sensitive-local": Preset(20, True),
    "very-sensitive-local": Preset(20, True),
}
#: Letters of a word; odd, so that no word is its own reverse complement.
WORD = 17
#: The longest probe whose surroundings go with every word; longer ones are fetched.
NEAR = 256
#: Places of a word in the genome beyond which its pairs are divided over several tasks.
HOT = 256
#: Such words up to which their table is broadcast; it holds twelve bytes a word.
MOST_HOT = 200_000

def word_length(seed: int) -> int:
    """Letters of the words that stand for seeds of some length."""
    return min(WORD, seed - 1 + seed % 2)


def _ascii(texts: list[str]) -> bytes:
    return "".join(texts).encode("ascii", "replace")


def words(base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of the word that begins at each place, whether it is turned, and whether it is whole.

    The code is the smaller of the word's own and its reverse complement's.
    """
    own, whole = bases.words(base, k)
    other = bases.turned_words(base, k)
    return np.minimum(own, other), other < own, whole


def _stretch_codes(base: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ``w`` letters that begin at each place, as they are and turned; -1 with other letters."""
    n = max(len(base) - w + 1, 0)
    own, other = np.zeros(n, np.int32), np.zeros(n, np.int32)
    bad = np.zeros(n, bool)
    for i in range(w):
        letter = base[i : i + n].astype(np.int32)
        bad |= letter == 4
        own = (own << 2) | (letter & 3)
        other |= (3 - (letter & 3)) << (2 * i)
    own[bad] = other[bad] = -1
    return own, other


def _binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as binary values."""
    n, width = matrix.shape
    offsets = (np.arange(n + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


#: Bits of a seed's number, of which the first PART_BITS say where it is counted and the first TABLE_BITS its place in a table.
NUMBER_BITS, PART_BITS, TABLE_BITS = 36, 8, 28
#: Odd numbers by which a number is multiplied for its places in a table.
_FACTORS = (1, 0x9E3779B1, 0x85EBCA77)
_NONE = np.int64(1) << NUMBER_BITS


def seed_numbers(code: np.ndarray, whole: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word, and that of the seed of ``w`` words that begins with it: the least of its words'.

    Equal seeds of either strand have equal numbers.  Words and seeds that
    aren't whole have the number _NONE, which is greater than any.
    """
    mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    number = np.where(whole, (mixed >> np.uint64(64 - NUMBER_BITS)).astype(np.int64), _NONE)
    n = max(len(number) - w + 1, 0)
    least, most = number[:n].copy(), number[:n].copy()
    for i in range(1, w):
        np.minimum(least, number[i : i + n], out=least)
        np.maximum(most, number[i : i + n], out=most)
    least[most == _NONE] = _NONE
    return number, least


def seed_sums(number: np.ndarray, least: np.ndarray, w: int) -> np.ndarray:
    """A number of each seed made of all its ``w`` words; equal for equal seeds of either strand, _NONE for those not whole."""
    sums = np.concatenate([[0], np.cumsum(number)])
    n = len(least)
    return np.where(least < _NONE, (sums[w : w + n] - sums[:n]) & (_NONE - 1), _NONE)


def table_places(rest: np.ndarray, j: int) -> np.ndarray:
    """The ``j``-th place of numbers, given without the bits of their part, in the part's table."""
    mixed = rest.astype(np.uint64) * np.uint64(_FACTORS[j]) & np.uint64((1 << (NUMBER_BITS - PART_BITS)) - 1)
    return (mixed >> np.uint64(NUMBER_BITS - TABLE_BITS)).astype(np.int64)


def _telling(number: np.ndarray, least: np.ndarray, w: int) -> np.ndarray:
    """Whether each word has the least number of a seed it is in; of equal ones all have."""
    out = np.zeros(len(number), bool)
    for i in range(w):
        out[i : i + len(least)] |= number[i : i + len(least)] == least
    return out & (number < _NONE)


@dataclass(frozen=True)
class SharedSeeds:
    """A table of bits in which all seeds of some kind are; some others may be in it, too."""

    held: Broadcast
    key: str
    w: int

    _tables: ClassVar[dict] = {}

    def table(self) -> np.ndarray:
        if self.key not in self._tables:
            self._tables.clear()
            bits = np.zeros(1 << TABLE_BITS >> 3, np.uint8)
            size = len(bits) >> PART_BITS
            for part, packed in self.held.value:
                bits[part * size : (part + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)
            self._tables[self.key] = bits
        return self._tables[self.key]

    def seeds(self, least: np.ndarray) -> np.ndarray:
        """Whether each seed, by its number, is in the table."""
        table, size = self.table(), NUMBER_BITS - PART_BITS
        some = np.flatnonzero(least < _NONE)
        for j in range(len(_FACTORS)):
            number = least[some]
            at = ((number >> size) << (TABLE_BITS - PART_BITS)) + table_places(number & ((1 << size) - 1), j)
            some = some[((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)]
        out = np.zeros(len(least), bool)
        out[some] = True
        return out

    def words(self, code: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Whether each word is in a seed of the table."""
        found = self.seeds(seed_numbers(code, whole, self.w)[1])
        out = np.zeros(len(code), bool)
        for i in range(self.w):
            out[i : i + len(found)] |= found
        return out


_INDEX = "seed long, align_seqid string, pos int, turned boolean, before int, after int, around binary"


@dataclass(frozen=True)
class SeedIndex:
    """The words of a genome, what they were made with, and the words at many places."""

    words: DataFrame
    hot: DataFrame
    seed: int
    reach: int
    every: int

    @property
    def side(self) -> int:
        """Letters of the genome before and behind every word."""
        return self.reach - word_length(self.seed)

    def check(self, seed: int, longest: int, band: int = 0) -> None:
        """An error unless probes of a length can be searched by seeds of a length."""
        if self.seed != seed:
            raise ReferenceIndexError(f"the index has seeds of {self.seed} letters, not {seed}")
        if min(longest, NEAR) + 2 * band > self.reach:
            raise ReferenceIndexError(f"the index serves probes of up to {self.reach} letters, not {longest}")


def build_seed_index(
    genome: DataFrame, seed: int = 20, id_col: str = "seq_id", seq_col: str = "seq", reach: int = 64, every: int = 1, piece: int = 16_384, only: SharedSeeds | None = None
) -> SeedIndex:
    """Every word of a genome with the letters around it, for probes of up to ``reach`` letters.

    ``every=1`` takes all words and lets probes take each stride-th; that suits
    many probes.  ``every`` equal to ``seed - word_length(seed) + 1`` makes a
    small index and lets probes take all, which suits few probes and a large
    genome.  Words with other letters than A, C, G, T are left out, and with
    ``only`` those in none of its seeds.
    """
    k = word_length(seed)
    w = seed - k + 1
    if every not in (1, w):
        raise ConfigurationError(f"every must be 1 or {w}")
    side = reach - k if reach > k else 0
    ahead, behind = max(side, w), max(k + side, k + w)
    pieces = chunks(genome, id_col, seq_col, piece, behind, ahead).select(F.col("seq_id").cast("string").alias("seq_id"), "offset", "total", "piece")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for r, (offset, total, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                letters = np.frombuffer(_ascii([text]), np.uint8)
                base = bases.CODE[letters]
                low = offset - min(offset, ahead)
                code, turned, whole = words(base, k)
                place = np.arange(offset - low, min(offset - low + piece, len(code)))
                place = place[whole[place]]
                if only is not None:
                    place = place[only.words(code, whole)[place]]
                if every > 1:
                    place = place[(place + low) % every == 0]
                if not len(place):
                    continue
                own, other = _stretch_codes(np.concatenate([np.full(w, 4, np.uint8), base, np.full(w, 4, np.uint8)]), w)
                # In ``own`` a stretch that begins at place p of the text is at p + w.
                before, after = own[place], other[place + k + w]
                at = place[:, None] + np.arange(-side, k + side)
                around = letters[np.clip(at, 0, len(letters) - 1)]
                around = np.where((at + low < 0) | (at + low >= total), 0, around).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(code[place]),
                        ids.take(pa.array(np.full(len(place), r))),
                        pa.array((place + low).astype(np.int32)),
                        pa.array(turned[place]),
                        pa.array(before),
                        pa.array(after),
                        _binary(around),
                    ],
                    names=["seed", "align_seqid", "pos", "turned", "before", "after", "around"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for offset, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code, _, whole = words(bases.CODE[np.frombuffer(_ascii([text]), np.uint8)], k)
                if only is not None:
                    whole = whole & only.words(code, whole)
                parts.append(code[:piece][whole[:piece]])
            code, n = np.unique(np.concatenate([np.empty(0, np.int64), *parts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["seed", "n"])

    counted = chunks(genome, id_col, seq_col, piece, seed - 1).select("offset", "piece").mapInArrow(count, "seed long, n long")
    return SeedIndex(pieces.mapInArrow(cut, _INDEX), checkpointed(_hot(counted)), seed, max(reach, k), every)


def _hot(counted: DataFrame) -> DataFrame:
    """(seed, parts) of the words at more than HOT places; counted in part before the shuffle."""
    counts = counted.groupBy("seed").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    return counts.select("seed", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))


def save_seed_index(index: SeedIndex, path: str, buckets: int | None = None) -> None:
    """Write an index, its words at many places and its parameters."""
    rows = index.words.repartition(buckets, "seed") if buckets else index.words
    rows.write.mode("overwrite").parquet(f"{path}/words")
    spark = index.words.sparkSession
    index.hot.write.mode("overwrite").parquet(f"{path}/hot")
    meta = spark.createDataFrame([(index.seed, index.reach, index.every)], "seed int, reach int, every int")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_seed_index(spark: SparkSession, path: str, seed: int | None = None) -> SeedIndex:
    """A written index; an error if it is incomplete or has seeds of another length."""
    try:
        meta = spark.read.parquet(f"{path}/meta").first()
        index = SeedIndex(spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/hot"), meta["seed"], meta["reach"], meta["every"])
    except Exception as e:
        raise ReferenceIndexError(f"no whole seed index at {path}") from e
    if seed is not None and seed != index.seed:
        raise ReferenceIndexError(f"the index {path} has seeds of {index.seed} letters, not {seed}")
    return index


def _probe_words(q: DataFrame, seed: int, every: int) -> DataFrame:
    """(seed, q, i, flipped, lead): words of each probe, the place of each, and the letters before it."""
    k = word_length(seed)
    w = seed - k + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            low = 0
            while low < len(texts):
                high, held = low, 0
                while high < len(texts) and (high == low or held + len(texts[high]) < 1_000_000):
                    held += len(texts[high]) + w
                    high += 1
                yield from _cut(batch.column(0).slice(low, high - low), texts[low:high])
                low = high

    def _cut(column: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(t) for t in texts], np.int64)
        # Signs between the texts end every word and every stretch.
        base = bases.CODE[np.frombuffer(_ascii(["\n" * w + t for t in texts]), np.uint8)]
        code, turned, whole = words(base, k)
        first = np.cumsum(sizes + w) - sizes
        owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - k + 1, 0))
        count = np.maximum(sizes - k + 1, 0)
        i = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        place = first[owner] + i
        kept = whole[place]
        if every == 1:
            kept &= i % w == 0
        owner, i, place = owner[kept], i[kept], place[kept]
        if not len(owner):
            return
        own, _ = _stretch_codes(base, w)
        lead = own[place - w]
        lead[lead < 0] = -2
        yield pa.RecordBatch.from_arrays(
            [pa.array(code[place]), column.take(pa.array(owner)), pa.array(i.astype(np.int32)), pa.array(turned[place]), pa.array(lead)],
            names=["seed", "q", "i", "flipped", "lead"],
        )

    return q.mapInArrow(cut, "seed long, q string, i int, flipped boolean, lead int")


def _hits(q: DataFrame, index: SeedIndex) -> DataFrame:
    """Pairs of a probe and a place that share a word, one for each stretch they have in common.

    Where the letters before a word are the same as well, the word before it
    is found, too, so that only the first of a common stretch is kept.  Pairs
    of a word at many places are divided by place, and so are its probes.
    """
    asked, places, keys = _probe_words(q, index.seed, index.every), index.words, ["seed"]
    many = index.hot.count()
    if many:
        hot = F.broadcast(index.hot) if many <= MOST_HOT else index.hot
        parts = F.coalesce("parts", F.lit(1))
        wide = F.ceil(parts / 16).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        share = lambda n, *of: F.pmod(F.xxhash64(*of), n).cast("int")
        places = places.join(hot, "seed", "left").withColumn("part", share(parts, "align_seqid", "pos")).withColumn("side", every(wide)).drop("parts")
        asked = asked.join(hot, "seed", "left").withColumn("side", share(wide, "q")).withColumn("part", every(parts)).drop("parts")
        keys += ["part", "side"]
    # Sizes are estimated before rows are multiplied, so no side may be broadcast by them.
    pairs = asked.join(places.hint("merge"), keys)
    same = F.col("flipped") == F.col("turned")
    return pairs.where(F.col("lead") != F.when(same, F.col("before")).otherwise(F.col("after")))


def _matrix(column: pa.Array, first: np.ndarray, size: np.ndarray, width: int, filler: int) -> np.ndarray:
    """``size`` letters of each value from its place ``first`` on, as rows of bytes filled up to ``width``."""
    if pa.types.is_string(column.type):
        data = column.cast(pa.binary())
        if (np.frombuffer(data.buffers()[2] or b"", np.uint8) > 127).any():
            data = pa.array([_ascii([t]) for t in column.to_pylist()], pa.binary())
    else:
        data = column
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    letters = np.frombuffer(data.buffers()[2] or b"\0", np.uint8)
    j = np.arange(width)
    at = offsets[:-1, None] + first[:, None] + j
    out = letters[np.clip(at, 0, len(letters) - 1)]
    return np.where(j < size[:, None], out, np.uint8(filler))


def _judge(same: np.ndarray, seed: int, local: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mismatch-free letters, score, and the first common stretch of a seed's length (start, end) of each row."""
    n, width = same.shape
    run = np.zeros(n, np.int32)
    begin, end = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    here, best = np.zeros(n, np.int32), np.zeros(n, np.int32)
    running = np.zeros(n, bool)
    for j in range(width):
        s = same[:, j]
        run = (run + 1) * s
        fresh = (run == seed) & (begin < 0)
        begin[fresh] = j - seed + 1
        running = (running | fresh) & s
        end[running] = j + 1
        if local:
            here = np.maximum(here + np.where(s, MATCH, MISMATCH), 0)
            best = np.maximum(best, here)
    return same.sum(1), best, begin, end


_FOUND = "probe_seq string, align_seqid string, align_start int, align_stop int, align_strand string, align_score int, mismatches int, derived_seq string"
_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


def _slices(sizes: np.ndarray, most: int = 4_000_000) -> Iterator[np.ndarray]:
    """Rows in groups of about equal size whose matrix stays small."""
    order = np.argsort(sizes, kind="stable")
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high + 1 - low) * sizes[order[high]] <= most:
            high += 1
        yield order[low:high]
        low = high


def _least(preset: Preset, size: np.ndarray) -> np.ndarray:
    return 20 + 8 * np.log(np.maximum(size, 1)) if preset.local else -0.6 - 0.6 * size


def _scores(preset: Preset, text: np.ndarray, size: np.ndarray, window: np.ndarray):
    """Mismatches, score, first common stretch and worth of probes and windows of the same width."""
    equal, best, begin, end = _judge(text == window, preset.seed, preset.local)
    wrong = size - equal
    score = best if preset.local else wrong * MISMATCH
    return wrong, score, begin, end, score >= _least(preset, size)


def _extend(hits: DataFrame, preset: Preset, side: int, band: int = 0) -> DataFrame:
    """Placements of the hits that reach the preset's least score, each once.

    A placement comes out of the hit in its first common stretch of a seed's
    length; others of the same diagonal are dropped.  ``side`` letters of the
    genome go before and behind every word.
    """
    columns = hits.select("q", "i", "flipped", "align_seqid", "pos", "turned", "around")
    return columns.mapInArrow(_extender(preset, side, band), _found_schema(band))


def _found_schema(band: int) -> str:
    return f"{_FOUND}, align_cigar string" if band else _FOUND


def _extender(preset: Preset, side: int, band: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What _extend() does with batches of hits."""
    k = word_length(preset.seed)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, i = batch.column(0), batch.column(1).to_numpy().astype(np.int64)
            flipped = batch.column(2).to_numpy(zero_copy_only=False) != batch.column(5).to_numpy(zero_copy_only=False)
            pos = batch.column(4).to_numpy().astype(np.int64)
            size = np.array([len(t) for t in q.to_pylist()], np.int64)
            lead = np.where(flipped, size - k - i, i)
            for rows in _slices(size, 500_000 if band else 4_000_000):
                n, width, turned = size[rows], int(size[rows].max()), flipped[rows]
                take = pa.array(rows)
                # With gaps, as many letters more on both sides as the ends can move.
                more = 2 * band
                wide = _matrix(batch.column(6).take(take), side - more - lead[rows], n + 2 * more, width + 2 * more, 0)
                if turned.any():
                    # Turned windows are read from their last letter to their first.
                    j = n[turned, None] + 2 * more - 1 - np.arange(width + 2 * more)
                    back = np.take_along_axis(wide[turned], np.maximum(j, 0), 1)
                    wide[turned] = np.where(j >= 0, bases.TURN[back], 0)
                filled = np.arange(width) < n[:, None]
                window = np.where(filled, wide[:, more : more + width], 0)
                asked = q.take(take)
                text = _matrix(asked, np.zeros(len(n), np.int64), n, width, 1)
                wrong, score, begin, end, good = _scores(preset, text, n, window)
                at = i[rows]
                within = ((window > 0) | ~filled).all(1)
                seeded = (begin >= 0) & (begin <= at) & (at < end)
                start = (pos[rows] - lead[rows]).astype(np.int64)
                ids = batch.column(3).take(take)
                if band:
                    yield from _with_gaps(preset, band, text, n, wide, seeded, within & good, score, wrong, start, turned, asked, ids)
                    continue
                g = np.flatnonzero(good & within & seeded)
                if not len(g):
                    continue
                keep = pa.array(g)
                yield pa.RecordBatch.from_arrays(
                    [
                        asked.take(keep),
                        ids.take(keep),
                        pa.array(start[g].astype(np.int32)),
                        pa.array((start + n)[g].astype(np.int32)),
                        pa.array(np.where(turned[g], "-", "+").tolist(), pa.string()),
                        pa.array(score[g].astype(np.int32)),
                        pa.array(wrong[g].astype(np.int32)),
                        _strings(window[g], n[g]),
                    ],
                    names=_NAMES,
                )

    return extend


def _strings(letters: np.ndarray, size: np.ndarray) -> pa.Array:
    """The first ``size`` letters of each row as texts."""
    flat = letters[np.arange(letters.shape[1]) < size[:, None]]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _with_gaps(preset, band, text, n, wide, seeded, plain, score, wrong, start, turned, asked, ids) -> Iterator[pa.RecordBatch]:
    """Placements with gaps where these score higher, with their operations.

    As in intervals of SAM lines, clips, insertions and deletions all count as
    length; what lies beyond the sequence is cut off.
    """
    some = np.flatnonzero(seeded)
    best = gaps.banded_scores(text[some], n[some], wide[some, band : wide.shape[1] - band], band, preset.local)
    plain_score = np.where(plain[some], score[some], -(1 << 28))
    reached = (np.maximum(best, plain_score) >= _least(preset, n[some]))
    rows = []
    gapped = some[reached & (best > plain_score)]
    traced = dict(zip(gapped.tolist(), zip(*gaps.traces(text[gapped], n[gapped], wide[gapped, band : wide.shape[1] - band], band, preset.local)))) if len(gapped) else {}
    for r, points, alone in zip(some[reached].tolist(), best[reached].tolist(), plain_score[reached].tolist()):
        size = int(n[r])
        if points > alone:
            ops, column, bad = traced[r]
            first = int(column) + band - (len(ops) - len(ops.lstrip("S")))
            bad = int(bad)
        else:
            points, first, bad = alone, 2 * band, int(wrong[r])
            ops = _clipped(text[r, :size] == wide[r, first : first + size]) if preset.local else "M" * size
        if turned[r]:
            # Length is counted from the smaller coordinate, the end of a turned window.
            first -= ops.count("I")
        last = first + len(ops)
        row = wide[r]
        low, high = max(first, 0), min(last, size + 4 * band)
        while low < high and row[low] == 0:
            low += 1
        while high > low and row[high - 1] == 0:
            high -= 1
        begin = start[r] + size + 2 * band - high if turned[r] else start[r] - 2 * band + low
        forms = ops[::-1] if turned[r] else ops
        rows.append((r, begin, begin + high - low, points, bad, row[low:high].tobytes().decode(), gaps.cigar(forms)))
    if rows:
        at, begin, stop, points, bad, derived, forms = zip(*rows)
        keep = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [
                asked.take(keep),
                ids.take(keep),
                pa.array(begin, pa.int32()),
                pa.array(stop, pa.int32()),
                pa.array(["-" if turned[r] else "+" for r in at], pa.string()),
                pa.array(points, pa.int32()),
                pa.array(bad, pa.int32()),
                pa.array(derived, pa.string()),
                pa.array(forms, pa.string()),
            ],
            names=[*_NAMES, "align_cigar"],
        )


def _clipped(same: np.ndarray) -> str:
    """The operations of the best stretch of a diagonal, the first of equals."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, MATCH, MISMATCH))])
    lows = np.minimum.accumulate(sums)
    end = int((sums - lows).argmax())
    begin = int(np.flatnonzero(sums[: end + 1] == lows[end])[-1])
    return "S" * begin + "M" * (end - begin) + "S" * (len(same) - end)


def _fetch_and_score(q: DataFrame, genome: DataFrame, index: SeedIndex, preset: Preset) -> DataFrame:
    """Placements of long probes: their diagonals once each, windows fetched by blocks."""
    k = word_length(preset.seed)
    n = F.length("q")
    turned = F.col("flipped") != F.col("turned")
    start = F.col("pos") - F.when(turned, n - k - F.col("i")).otherwise(F.col("i"))
    hits = _hits(q, index)
    bed = hits.select(
        F.col("q").alias("probe_seq"), "align_seqid", start.alias("align_start"), (start + n).alias("align_stop"), F.when(turned, "-").otherwise("+").alias("align_strand")
    )
    cut = fetch_sequences(bed.where("align_start >= 0"), genome).where(F.length("derived_seq") == F.length("probe_seq"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.array([len(t) for t in batch.column(0).to_pylist()], np.int64)
            for rows in _slices(size):
                part = batch.take(pa.array(rows))
                width = int(size[rows].max())
                window, text = (_matrix(part.column(c), np.zeros(len(rows), np.int64), size[rows], width, filler) for c, filler in ((5, 0), (0, 1)))
                wrong, points, begin, _, good = _scores(preset, text, size[rows], window)
                g = pa.array(np.flatnonzero(good & (begin >= 0)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).take(g) for c in range(5)),
                        pa.array(points.astype(np.int32)).take(g),
                        pa.array(wrong.astype(np.int32)).take(g),
                        part.column(5).take(g),
                    ],
                    names=_NAMES,
                )

    return cut.select("probe_seq", "align_seqid", "align_start", "align_stop", "align_strand", "derived_seq").mapInArrow(score, _FOUND)


def align(
    probes: DataFrame,
    genome: DataFrame,
    seq_col: str = "probe_seq",
    preset: str | Preset = "very-sensitive-local",
    k: int | None = 100,
    index: SeedIndex | None = None,
    longest: int | None = None,
    band: int = 0,
) -> DataFrame:
    """Alignments of every distinct probe sequence on both strands.

    Columns probe_seq, align_seqid, align_start, align_stop, align_strand,
    align_score, mismatches, derived_seq (bases of the genome, on the probe's
    strand).  Complete for placements that share a seed with the probe: every
    one reaching the preset's least score comes out, the ``k`` best of a probe
    by score, then sequence, start and strand; ``k=None`` gives all.  Local
    scores take the best stretch of the diagonal, its ends clipped.  The full
    length of the probe must lie within the sequence.  Null, empty and short
    probes align nowhere; letters other than A, C, G, T match themselves but
    make no seed.

    ``longest`` is the length of the longest probe, found by an aggregate where
    it isn't given.  Probes of more than NEAR letters have their windows
    fetched; shorter ones find them beside the index's words.

    ``band`` allows gaps: a placement may leave its seed's diagonal by so many
    letters where that scores higher, and ``align_cigar`` tells how.  Its
    interval is that of its SAM line: clips, insertions and deletions count as
    length.  Gaps are for probes of up to NEAR letters; longer ones with a band
    are an error.
    """
    preset = PRESETS[preset] if isinstance(preset, str) else preset
    q = probes.select(F.upper(F.col(seq_col)).alias("q")).where("q IS NOT NULL").distinct()
    if longest is None:
        longest = q.agg(F.max(F.length("q"))).first()[0] or 0
    if band and longest > NEAR:
        raise ConfigurationError(f"gaps are for probes of up to {NEAR} letters, not {longest}")
    if index is None:
        index = build_seed_index(genome, preset.seed, reach=max(min(longest, NEAR), preset.seed) + 2 * band)
    index.check(preset.seed, longest, band)
    near = q if longest <= NEAR else q.where(F.length("q") <= NEAR)
    found = _extend(_hits(near, index), preset, index.side, band)
    if band:
        # Seeds on both sides of a gap find the same placement.
        found = found.distinct()
    if longest > NEAR:
        found = found.unionByName(_fetch_and_score(q.where(F.length("q") > NEAR), genome, index, preset))
    if k is None:
        return found
    return _best(found, k, band)


def _best(found: DataFrame, k: int, band: int) -> DataFrame:
    """The ``k`` best placements of each probe."""
    order = Window.partitionBy("probe_seq").orderBy(F.desc("align_score"), "align_seqid", "align_start", "align_strand", *(["align_stop", "align_cigar"] if band else []))
    return found.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")


def gapped_score(query: str, target: str, band: int = 3, local: bool = True) -> int:
    """Score of the best alignment of two texts within a band of diagonals, with affine gaps."""
    return gapped_scores([query], [target], band, local)[0]


def gapped_scores(queries: list[str], targets: list[str], band: int = 3, local: bool = True) -> list[int]:
    """As gapped_score(), for many pairs at once; 0 where either is empty."""
    size = np.array([len(q) for q in queries])
    out = np.zeros(len(size), np.int64)
    for rows in _slices(size):
        width = int(size[rows].max(initial=0))
        if not width:
            continue
        text = np.ones((len(rows), width), np.uint8)
        around = np.zeros((len(rows), width + 2 * band), np.uint8)
        for x, r in enumerate(rows.tolist()):
            text[x, : size[r]] = np.frombuffer(_ascii([queries[r]]), np.uint8)
            letters = np.frombuffer(_ascii([targets[r]]), np.uint8)[: width + band]
            around[x, band : band + len(letters)] = letters
        scores = gaps.banded_scores(text, size[rows], around, band, local)
        out[rows] = np.where([bool(targets[r]) and bool(queries[r]) for r in rows.tolist()], scores, 0)
    return out.tolist()


def add_gapped_score(alignments: DataFrame, band: int = 3, local: bool = True, out: str = "gapped_score") -> DataFrame:
    """Alignments with the score of their best alignment with gaps, in Arrow batches."""

    @F.pandas_udf("int")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        known = (q.notna() & t.notna()).to_numpy()
        found = np.full(len(q), None, object)
        found[known] = gapped_scores(q[known].tolist(), t[known].tolist(), band, local)
        return pd.Series(found, dtype="Int32")

    return alignments.withColumn(out, score("probe_seq", "derived_seq"))
