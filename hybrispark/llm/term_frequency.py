"""Frequency of every distinct term over a whole collection.

Pairs of term and record are sorted in runs within each task and scanned for
run lengths (occurrences) and distinct records, so that a term sends one row a
run however often it occurs.  The rows are range-partitioned by term, sorted
externally and scanned once more.  A record too long for one run keeps its
identifier in its rows, so that the last scan counts it once a term.

Terms are stretches of letters or what a pattern finds.  Stretches of up to 31
bases are sorted as numbers, all others as texts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybrispark.operators import bases

DNA = "ACGT"
#: Characters worked on at once; a longer text is cut, with its identifier kept.
SLICE = 4_000_000


@dataclass(frozen=True)
class Terms:
    """What the terms of a text are: its stretches of ``k`` letters of an alphabet, or what a pattern finds.

    White space is removed and letters are taken in upper case for stretches;
    any other character ends one.  Without an alphabet every character counts.
    A pattern is applied to the text in lower case.  A text cut for its length
    is cut for a pattern behind the last white space, which no match of a
    pattern may hold.
    """

    k: int = 18
    alphabet: str | None = DNA
    pattern: str | None = None

    def __post_init__(self):
        if self.pattern is None and self.k < 1:
            raise ValueError("k must be at least 1")

    @property
    def packed(self) -> bool:
        return self.pattern is None and self.alphabet == DNA and self.k <= bases.MOST

    def prepare(self, text: str) -> str:
        return text.lower() if self.pattern is not None else "".join(text.split()).upper()

    def cuts(self, text: str, most: int) -> Iterator[str]:
        """A prepared text in parts that hold each of its terms once."""
        at = 0
        while len(text) - at > most:
            if self.pattern is None:
                yield text[at : at + most + self.k - 1]
                at += most
                continue
            end = max(text.rfind(c, at + 1, at + most) for c in " \n\t")
            # Without a blank in reach the part goes on to the next one.
            if end < 0:
                found = re.compile(r"\s").search(text, at + most)
                end = found.start() if found else len(text)
            yield text[at:end]
            at = end
        if at < len(text):
            yield text[at:]

    def find(self, parts: list[str]) -> tuple[np.ndarray | list[str], np.ndarray]:
        """All terms of prepared texts, and the number of the text each is in."""
        if self.packed:
            code, whole = bases.words(bases.to_codes("\n".join(parts)), self.k)
            record = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])[: len(code)]
            return code[whole], record[whole]
        if self.pattern is not None:
            find = re.compile(self.pattern).finditer
            terms = [[m.group() for m in find(p)] for p in parts]
        else:
            k = self.k
            stretch = re.compile(f"[{re.escape(self.alphabet.upper())}]+" if self.alphabet is not None else "(?s:.+)").finditer
            terms = [[w[i : i + k] for w in (m.group() for m in stretch(p)) for i in range(len(w) - k + 1)] for p in parts]
        return [t for some in terms for t in some], np.repeat(np.arange(len(parts)), [len(some) for some in terms])


def count_run(terms: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms with their occurrences and distinct records, by run lengths of the sorted pairs."""
    if not len(terms):
        return terms, terms, terms
    order = np.lexsort((records, terms))
    terms, records = terms[order], records[order]
    new_term = np.ones(len(terms), bool)
    new_term[1:] = terms[1:] != terms[:-1]
    new_pair = new_term.copy()
    new_pair[1:] |= records[1:] != records[:-1]
    heads = np.flatnonzero(new_term)
    occurrences = np.diff(np.append(heads, len(terms)))
    return terms[heads], occurrences, np.add.reduceat(new_pair.astype(np.int64), heads)


class _Run:
    """Pairs held by a task until they are counted."""

    def __init__(self, kind: Terms, bounds: list):
        self.kind, self.bounds = kind, bounds
        self.terms: list = []
        self.owners: list[np.ndarray] = []
        self.held = self.seen = 0

    def add(self, parts: list[str]) -> None:
        terms, owner = self.kind.find(parts)
        self.terms.append(terms)
        self.owners.append(owner + self.seen)
        self.seen += len(parts)
        self.held += len(terms)

    def count(self, record: str | None = None) -> pa.RecordBatch:
        owner = np.concatenate(self.owners)
        if self.kind.packed:
            term, n, records = count_run(np.concatenate(self.terms), owner)
            column, place = pa.array(term), np.searchsorted(np.array(self.bounds, np.int64), term, "right")
        else:
            coded = pa.array([t for some in self.terms for t in some], pa.string()).dictionary_encode()
            code, n, records = count_run(coded.indices.to_numpy().astype(np.int64), owner)
            column = coded.dictionary.take(pa.array(code))
            place = np.array([bisect_right(self.bounds, t) for t in column.to_pylist()])
        if record is not None:
            records = np.zeros_like(records)
        self.terms, self.owners, self.held, self.seen = [], [], 0, 0
        columns = [column, pa.array([record] * len(n), pa.string()), pa.array(n.astype(np.int64)), pa.array(records.astype(np.int64)), pa.array(place.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["term", "record", "n", "records", "place"])


def _bounds(texts: DataFrame, n: int, kind: Terms, parts: int) -> list:
    """Terms that divide all of them into about equal parts; they decide where a term is counted, not what.

    They come from up to five terms each of about 5,000 of ``n`` texts, or 20 a part.
    """
    rows = max(5_000, 20 * parts)
    if parts < 2 or not n:
        return []

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = []
            for text in batch.column(0).to_pylist():
                part = next(kind.cuts(kind.prepare(text), 20_000), "")
                got = kind.find([part])[0]
                some = got[:: max(1, -(-len(got) // 5))]
                found.extend(some if kind.packed else (t[:64] for t in some))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64() if kind.packed else pa.string())], names=["term"])

    sampled = texts.sample(min(1.0, rows / n), 7).mapInArrow(some, f"term {'long' if kind.packed else 'string'}")
    got = sorted(r[0] for r in sampled.collect())
    return sorted({got[len(got) * i // parts] for i in range(1, parts)}) if got else []


def term_frequency(
    df: DataFrame,
    id_col: str,
    text_col: str,
    k: int = 18,
    common_records: int = 10,
    common_share: float = 0.002,
    pairs_per_run: int = 2_000_000,
    alphabet: str | None = DNA,
    pattern: str | None = None,
) -> DataFrame:
    """(term, n_occurrences, n_records, mark) of every term.

    Terms are the k-letter stretches of ``alphabet`` (see Terms), of any
    length, or the matches of ``pattern``.  A record is a distinct id; rows
    with a null id are no records.  Deliveries of an id with different texts
    count as one record with the greatest of them, in code point order.
    ``mark`` is ``rare`` for a term that occurs once in all, ``common`` for one
    in at least ``common_records`` records that are at least ``common_share``
    of all distinct ids (those without terms included), else null.  Null, empty
    and too short texts have no terms; an empty table gives an empty result.

    A task holds the pairs of about ``pairs_per_run`` terms, and a text of more
    than SLICE characters only part by part.
    """
    kind = Terms(k, alphabet, pattern)
    spark = df.sparkSession
    named = df.select(df[id_col].alias("__id"), df[text_col].alias("__text")).where("__id IS NOT NULL")
    total = named.agg(F.countDistinct("__id"))
    texts = named.where("__text IS NOT NULL")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(texts.select("__text"), df.count(), kind, parts)
    records = texts.groupBy("__id").agg(F.max("__text").alias("__text"))
    # The id is needed for long texts only.
    records = records.select("__text", F.when(F.length("__text") > SLICE, F.col("__id").cast("string")).alias("__id"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Run(kind, bounds)
        for batch in batches:
            waiting, held = [], 0
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = kind.prepare(text)
                if name is not None:
                    alone = _Run(kind, bounds)
                    for part in kind.cuts(text, min(SLICE, pairs_per_run)):
                        alone.add([part])
                        if alone.held >= pairs_per_run:
                            yield alone.count(name)
                    if alone.held:
                        yield alone.count(name)
                    continue
                waiting.append(text)
                held += len(text)
                if held >= SLICE:
                    run.add(waiting)
                    waiting, held = [], 0
                    if run.held >= pairs_per_run:
                        yield run.count()
            if waiting:
                run.add(waiting)
                if run.held >= pairs_per_run:
                    yield run.count()
        if run.held:
            yield run.count()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows arrive sorted by term and record; the last term of a batch may go on in the next.
        last: tuple[pa.Array, int, int, str | None] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            term, record = batch.column(0), batch.column(1)
            code = term.to_numpy() if kind.packed else term.dictionary_encode().indices.to_numpy()
            heads = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            n, records = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            if record.null_count < len(record):
                # A long record counts where its first row of a term stands.
                name = record.dictionary_encode().indices.fill_null(-1).to_numpy()
                fresh = np.append(True, (code[1:] != code[:-1]) | (name[1:] != name[:-1])) & (name >= 0)
                if last is not None and last[3] is not None and term[0].as_py() == last[0][0].as_py() and record[0].as_py() == last[3]:
                    fresh[0] = False
                records = records + fresh
            n, records = np.add.reduceat(n, heads), np.add.reduceat(records, heads)
            term = term.take(pa.array(heads))
            if last is not None:
                if last[0][0].as_py() == term[0].as_py():
                    n[0] += last[1]
                    records[0] += last[2]
                else:
                    yield _counts(last[0], np.array([last[1]]), np.array([last[2]]))
            last = (term.slice(len(term) - 1), int(n[-1]), int(records[-1]), record[len(record) - 1].as_py())
            yield _counts(term.slice(0, len(term) - 1), n[:-1], records[:-1])
        if last is not None:
            yield _counts(last[0], np.array([last[1]]), np.array([last[2]]))

    form = "long" if kind.packed else "string"
    counted = (
        records.mapInArrow(runs, f"term {form}, record string, n long, records long, place int")
        .repartitionById(parts, F.col("place"))
        .drop("place")
        .sortWithinPartitions("term", "record")
        .mapInArrow(scan, f"term {form}, n_occurrences long, n_records long")
    )
    least = F.greatest(F.lit(float(common_records)), F.lit(common_share) * total.scalar())
    return counted.select(
        (decode_term(F.col("term"), k) if kind.packed else F.col("term")).alias("term"),
        "n_occurrences",
        "n_records",
        F.when(F.col("n_occurrences") == 1, "rare").when(F.col("n_records") >= least, "common").alias("mark"),
    )


def decode_term(code: Column, k: int) -> Column:
    """The letters of a packed term."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def _counts(term: pa.Array, n: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([term, pa.array(n), pa.array(records)], names=["term", "n_occurrences", "n_records"])
