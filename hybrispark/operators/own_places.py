"""Alignment of a genome's own probes: what stands once needs no search.

A probe that was mined at a place is found there again.  It is found elsewhere
only if it has a seed in common with another place, so it is enough to know
which seeds do not stand alone.  Seeds are told first by the least number of
their words, about two bytes of which are shuffled, then, where that is found
twice, by all their words; no letters are shuffled for them.  Only probes with a
shared seed are searched, and only in words of such seeds.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybrispark.operators import bases
from hybrispark.operators.alignment import (
    _FACTORS, NUMBER_BITS, PART_BITS, PRESETS, TABLE_BITS, Preset, SharedSeeds, _ascii, _binary, _extender, _found_schema, _telling, align, build_seed_index, seed_numbers, seed_sums,
    table_places, word_length, words,
)
from hybrispark.operators.mining import MiningConfig, _choose, _Grid, chunks
from hybrispark.session import written

#: Numbers that a task holds before it gives them out.
HELD = 1_000_000


class _Piece:
    """A piece of a sequence: its letters, the numbers of its seeds, and the probes that begin in it."""

    def __init__(self, offset: int, total: int, text: str, size: int, before: int, seed: int):
        self.text, self.total = text, total
        self.k = word_length(seed)
        self.w = seed - self.k + 1
        self.low = offset - min(offset, before)
        self.own = offset - self.low, min(offset - self.low + size, total - self.low)
        self.letters = np.frombuffer(_ascii([text]), np.uint8)
        self.base = bases.CODE[self.letters]
        code, _, whole = words(self.base, self.k)
        self.number, self.least = seed_numbers(code, whole, self.w)
        self.telling = _telling(self.number, self.least, self.w)

    def numbers(self) -> np.ndarray:
        """Numbers that tell a seed, of the words that begin in the piece itself."""
        low, high = self.own
        return self.number[low:high][self.telling[low:high]]

    def seeds(self, some: SharedSeeds) -> np.ndarray:
        """Numbers of all words of the seeds that begin in the piece itself and whose least number is in a table."""
        low, high = self.own
        at = np.arange(low, min(high, len(self.least)))
        at = at[some.seeds(self.least[at])]
        sums = seed_sums(self.number, self.least, self.w)[at]
        # A seed that is its own reverse complement stands at its place twice.
        mirrored = np.ones(len(at), bool)
        for a in range(self.w // 2):
            mirrored &= self.number[at + a] == self.number[at + self.w - 1 - a]
        return np.concatenate([sums, sums[mirrored]]) if self.w > 1 else sums

    def probes(self, cfg: MiningConfig) -> tuple[np.ndarray, list[str]]:
        """Places in the piece and letters of the probes mined in it."""
        low, high = self.own
        at = np.arange(low, min(high, self.total - self.low - cfg.max_length + 1))
        if not len(at):
            return at, []
        place, size, _ = _choose(_Grid(self.base, cfg), at, cfg)
        return place, [self.text[a : a + n] for a, n in zip(place.tolist(), size.tolist())]


def _least_of(texts: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Of texts end to end: numbers of words and seeds, where each text begins and how many seeds it has, and words in a seed."""
    k = word_length(seed)
    w = seed - k + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    code, _, whole = words(bases.CODE[np.frombuffer(_ascii([t + "\n" for t in texts]), np.uint8)], k)
    number, least = seed_numbers(code, whole, w)
    return number, least, np.cumsum(sizes + 1) - sizes - 1, np.maximum(sizes - seed + 1, 0), w


def _any_shared(texts: list[str], seed: int, shared: SharedSeeds) -> np.ndarray:
    """Whether each text has a shared seed."""
    number, least, first, count, w = _least_of(texts, seed)
    sums = np.concatenate([[0], np.cumsum(shared.seeds(seed_sums(number, least, w)))])
    return sums[np.minimum(first + count, len(sums) - 1)] > sums[np.minimum(first, len(sums) - 1)]


#: Values of the bits of a packed number before its last two bytes.
_HIGH = 1 << (NUMBER_BITS - PART_BITS - 16)


def _packed(rest: np.ndarray) -> bytes:
    """Sorted numbers: how many, the bits before the last two bytes as a one behind as many zeros as they grow by, and the last two bytes."""
    n = len(rest)
    steps = np.zeros(n + _HIGH, np.uint8)
    steps[(rest >> 16) + np.arange(n)] = 1
    return n.to_bytes(4, "little") + np.packbits(steps).tobytes() + (rest & 0xFFFF).astype("<u2").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    """The numbers that _packed() was given."""
    n = int.from_bytes(blob[:4], "little")
    end = 4 + (n + _HIGH + 7) // 8
    high = np.flatnonzero(np.unpackbits(np.frombuffer(blob[4:end], np.uint8))) - np.arange(n)
    return (high << 16 | np.frombuffer(blob[end:], "<u2")).astype(np.uint32)


def _split(parts: list[np.ndarray], asked: bool) -> Iterator[pa.RecordBatch]:
    """Numbers by their first bits, the rest of each packed."""
    number = np.sort(np.concatenate(parts))
    part = number >> (NUMBER_BITS - PART_BITS)
    cut = np.flatnonzero(np.diff(part, prepend=-1)) if len(number) else np.empty(0, np.int64)
    rest = number & ((1 << (NUMBER_BITS - PART_BITS)) - 1)
    blobs = [_packed(rest[a:b]) for a, b in zip(cut, [*cut[1:], len(number)])]
    if blobs:
        yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array([asked] * len(blobs)), pa.array(blobs, pa.binary())], names=["part", "asked", "numbers"])


_NUMBERS = "part int, asked boolean, numbers binary"


def shared_seeds(pieces: DataFrame, given: DataFrame | None, cfg: MiningConfig, seed: int, size: int, before: int, change: Callable[[str], str] | None) -> SharedSeeds:
    """The seeds that stand at two places of the genome, or at one and in a given or changed probe, other than its own.

    Words are too short to stand alone in a large genome, so that the seeds
    whose least word is found twice are counted once more by all their words.
    """

    def counted(some: SharedSeeds | None) -> DataFrame:
        """Numbers that tell a seed by its least word; with a table of these those of the seeds themselves."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[bool, list[np.ndarray]] = {False: [], True: []}

            def take(asked: bool, number: np.ndarray) -> Iterator[pa.RecordBatch]:
                held[asked].append(number)
                if sum(map(len, held[asked])) >= HELD:
                    yield from _split(held[asked], asked)
                    held[asked] = []

            for batch in batches:
                for offset, total, text in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                    piece = _Piece(offset, total, text, size, before, seed)
                    yield from take(False, piece.numbers() if some is None else piece.seeds(some))
                    if change:
                        yield from take(True, _changed(piece, some))
            for asked, parts in held.items():
                if parts:
                    yield from _split(parts, asked)

        numbers = pieces.mapInArrow(count, _NUMBERS)
        return numbers if given is None else numbers.unionByName(given.mapInArrow(_count_texts(seed, some), _NUMBERS))

    def _changed(piece: _Piece, some: SharedSeeds | None) -> np.ndarray:
        """Numbers of the changed probes' seeds, but those of seeds that stay where they are."""
        place, texts = piece.probes(cfg)
        if not len(place):
            return np.empty(0, np.int64)
        made = [change(t) for t in texts]
        number, least, first, count, w = _least_of(made, seed)
        was, size = (np.array([len(t) for t in x], np.int64) for x in (texts, made))
        flat = np.frombuffer(_ascii([t + "\n" for t in made]), np.uint8)
        j = np.arange(size.max() + 1)
        # Signs between the texts end what is common.
        same = lambda a, b: (flat[np.minimum(a, len(flat) - 1)] != piece.letters[np.clip(b, 0, len(piece.letters) - 1)]).argmax(1)
        left = same(first[:, None] + j, place[:, None] + j)
        right = same((first + size - 1)[:, None] - j, (place + was - 1)[:, None] - j)
        # Behind the change a seed of the own place would be one of another diagonal, which is for the search.
        right = np.where(right < seed, right, 0)
        j = np.arange(size.max())
        if some is not None:
            new = (j < count[:, None]) & (j + seed > left[:, None])
            at = (first[:, None] + j)[new]
            return seed_sums(number, least, w)[at[some.seeds(least[at])]]
        telling = _telling(number, least, w)
        for low, high, move in ((0 * size, left, 0 * size), (size - right, size, was - size)):
            kept = (j >= low[:, None]) & (j + piece.k <= high[:, None])
            at, there = (first[:, None] + j)[kept], ((place + move)[:, None] + j)[kept]
            telling[at] &= ~piece.telling[there]
        return number[telling]

    def twice(here: np.ndarray, asked: np.ndarray) -> np.ndarray:
        return np.concatenate([here[1:][here[1:] == here[:-1]], here[np.isin(here, asked)]])

    return _table(counted(_table(counted(None), seed, twice)), seed, twice)


def _count_texts(seed: int, some: SharedSeeds | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers that tell a seed of texts; with a table of these those of the seeds themselves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                number, least, _, _, w = _least_of(texts, seed)
                yield from _split([number[_telling(number, least, w)] if some is None else seed_sums(number, least, w)[some.seeds(least)]], True)

    return count


def _table(numbers: DataFrame, seed: int, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> SharedSeeds:
    """The table of what is chosen of each part's sorted numbers, those of the genome and those asked for."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[bytes]] = {}
        for batch in batches:
            for part, asked, blob in zip(*(batch.column(c).to_pylist() for c in range(3))):
                held.setdefault((part, asked), []).append(blob)
        for part in sorted({p for p, _ in held}):
            found = chosen(*(np.sort(np.concatenate([np.empty(0, np.uint32), *map(_unpacked, held.get((part, a), []))])) for a in (False, True)))
            if len(found):
                bits = np.zeros(1 << (TABLE_BITS - PART_BITS), np.uint8)
                for j in range(len(_FACTORS)):
                    bits[table_places(found, j)] = 1
                packed = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["part", "bits"])

    # At most 2 ** PART_BITS parts of a table of 2 ** TABLE_BITS bits, however many seeds there are.
    table = [(r["part"], bytes(r["bits"])) for r in numbers.repartition("part").mapInArrow(meet, "part int, bits binary").collect()]
    return SharedSeeds(numbers.sparkSession.sparkContext.broadcast(table), uuid4().hex, seed - word_length(seed) + 1)


def align_mined(
    genome: DataFrame,
    cfg: MiningConfig = MiningConfig(),
    given: DataFrame | None = None,
    preset: str | Preset = "very-sensitive-local",
    k: int | None = 100,
    longest: int | None = None,
    band: int = 0,
    change: Callable[[str], str] | None = None,
    piece: int = 65_536,
) -> DataFrame:
    """As align(), of all probes mined from ``genome`` (seq_id, seq; ids are unique) and of the ``given`` ones (probe_seq) to it.

    ``change`` makes the probe to be aligned of a mined one; it must leave the
    letters at its start as they are, a seed's length at least.
    Mining is without spacing, and no probe is longer than NEAR.
    """
    preset = PRESETS[preset] if isinstance(preset, str) else preset
    longest = longest or cfg.max_length
    word = word_length(preset.seed)
    side = max(longest + 2 * band, preset.seed) - word
    before = max(side, preset.seed)
    # Written once: counting, indexing and searching would each shuffle it again.
    genome = written(genome.select(F.col("seq_id").cast("string").alias("seq_id"), "seq"))
    pieces = chunks(genome, "seq_id", "seq", piece, max(cfg.max_length, word + side, preset.seed) + preset.seed, before)
    if given is not None:
        given = given.select(F.upper("probe_seq").alias("q")).where("q <> ''")
    shared = shared_seeds(pieces, given, cfg, preset.seed, piece, before, change)
    extend = _extender(preset, side, band)

    def mined(batch: pa.RecordBatch, alone: bool):
        """Pieces with the places and letters of their probes that do or don't stand alone."""
        for r, (offset, total, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
            part = _Piece(offset, total, text, piece, before, preset.seed)
            place, texts = part.probes(cfg)
            if not len(place):
                continue
            texts = [change(t) for t in texts] if change else texts
            taken = _any_shared(texts, preset.seed, shared) != alone
            if taken.any():
                yield r, part, place[taken], [t for t, x in zip(texts, taken.tolist()) if x]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, part, place, texts in mined(batch, True):
                n = len(place)
                at = place[:, None] + np.arange(-side, word + side)
                around = part.letters[np.clip(at, 0, len(part.letters) - 1)]
                around = np.where((at + part.low < 0) | (at + part.low >= part.total), 0, around).astype(np.uint8)
                no = pa.array(np.zeros(n, bool))
                hits = [pa.array(texts, pa.string()), pa.array(np.zeros(n, np.int32)), no, batch.column(0).take(pa.array(np.full(n, r))), pa.array((place + part.low).astype(np.int32)), no, _binary(around)]
                yield from extend(iter([pa.RecordBatch.from_arrays(hits, names=["q", "i", "flipped", "align_seqid", "pos", "turned", "around"])]))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, texts in mined(batch, False):
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["probe_seq"])

    def sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = _any_shared(texts, preset.seed, shared) if texts else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(found))], names=["probe_seq"])

    asked = pieces.mapInArrow(repeated, "probe_seq string")
    if given is not None:
        asked = asked.unionByName(given.mapInArrow(sharing, "probe_seq string"))
    asked = written(asked.distinct())
    # Their own places have seeds that stand there only.
    wanted = _table(asked.mapInArrow(_count_texts(preset.seed), _NUMBERS), preset.seed, lambda _, asked: asked)
    index = build_seed_index(genome, preset.seed, reach=side + word, only=wanted)
    searched = align(asked, genome, preset=preset, k=k, index=index, longest=longest, band=band)
    return pieces.mapInArrow(alone, _found_schema(band)).unionByName(searched)
