"""Evaluation texts that leaked into training text.

The test items are a stated query set; their inverted index with BM25 impacts
is broadcast, in blocks of items of a bounded size.  Every training passage (a
window of words) is a query against it.  Retrieval is block-max WAND over
whole batches of passages: bounds from the terms' highest impacts drop most
passages, bounds from the highest impacts of each block of postings drop most
blocks, and only what is left is scored.  The threshold of an item is the
lowest score any passage holding ``n`` of its consecutive words can have, so
nothing is lost; what is retrieved is then verified word by word.
"""

from __future__ import annotations

import html
import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_K1, _B = 1.2, 0.75
_SURE = 1 - 1e-9
_tag = re.compile(r"</?[A-Za-z][^<>]*>")
_invisible = re.compile("[\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")
#: A word divided by a line break, behind a hyphen; quoted lines begin with a sign of their own.
_divided = re.compile(
    r"(?<=\w)[-\u00ad‐‑][^\S\r\n]*(?:\r\n|[\r\n\u0085\u2028\u2029])(?:[^\S\r\n]|[>|])*(?=\w)"
)
_word = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """The text without markup, invisible characters, case and differences of form."""
    if "<" in text:
        text = _tag.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        if "-" in text:
            text = _divided.sub("", text)
        return text.lower()
    text = _divided.sub("", _invisible.sub("", text)).replace("\u00ad", "")
    return unicodedata.normalize("NFKC", text).casefold()


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits of a text, in one form."""
    return _word.findall(plain(text)) if text else []


@dataclass
class ItemIndex:
    """Inverted index of test items; impacts are divided by the threshold of their item."""

    n: int
    terms: dict[str, int]
    item_ids: list
    highest: np.ndarray  # by term; a last 0 for other words
    term_block: np.ndarray  # first block of each term
    block_of: np.ndarray  # which block of items a block of postings belongs to
    block_max: np.ndarray
    block_posting: np.ndarray  # first posting of each block
    posting_item: np.ndarray
    posting_impact: np.ndarray
    passages: list[frozenset[bytes]]  # by item, each n consecutive words

    @property
    def n_blocks(self) -> int:
        return int(self.block_of.max(initial=0)) + 1


def build_index(items: list[tuple[object, str | None]], n: int, block_size: int = 32, segment: int = 2_000) -> ItemIndex:
    """Index the items of at least ``n`` words, long ones in segments that share ``n - 1`` words."""
    kept = []
    for i, text in items:
        found = words_of(text)
        if len(found) >= n:
            kept += [(i, found[a : a + segment + n - 1]) for a in range(0, max(len(found) - n + 1, 1), segment)]
    terms: dict[str, int] = {}
    coded = [np.array([terms.setdefault(w, len(terms)) for w in ws], np.int32) for _, ws in kept]
    count = len(kept)
    document_frequency = Counter(int(t) for c in coded for t in set(c.tolist()))
    mean = sum(map(len, coded)) / count if count else 1
    postings: list[list[tuple[int, float]]] = [[] for _ in terms]
    for item, c in enumerate(coded):
        impact = {}
        for t, tf in Counter(c.tolist()).items():
            idf = math.log(1 + (count - document_frequency[t] + 0.5) / (document_frequency[t] + 0.5))
            impact[t] = idf * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * len(c) / mean))
        least = min(sum(impact[t] for t in set(c[i : i + n].tolist())) for i in range(len(c) - n + 1))
        for t, x in impact.items():
            postings[t].append((item, x / least))
    term_block, block_of, block_max, block_posting, who, how = [0], [], [], [], [], []
    for plist in postings:
        for k, (item, x) in enumerate(plist):
            if k == 0 or item // block_size != block_of[-1]:
                block_of.append(item // block_size)
                block_max.append(x)
                block_posting.append(len(who))
            block_max[-1] = max(block_max[-1], x)
            who.append(item)
            how.append(x)
        term_block.append(len(block_of))
    block_posting.append(len(who))
    return ItemIndex(
        n,
        terms,
        [i for i, _ in kept],
        np.array([*(max(x for _, x in p) for p in postings), 0.0]),
        np.array(term_block, np.int64),
        np.array(block_of, np.int64),
        np.array(block_max),
        np.array(block_posting, np.int64),
        np.array(who, np.int64),
        np.array(how),
        [frozenset(c[i : i + n].tobytes() for i in range(len(c) - n + 1)) for c in coded],
    )


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry its places first .. first + size - 1: the number of the entry, and the place."""
    owner = np.repeat(np.arange(len(first)), size)
    return owner, np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(owner))


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(key, return_inverse=True)
    return keys, np.bincount(where, value, len(keys))


def retrieve(index: ItemIndex, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (passage, item) whose BM25 score reaches the item's threshold.

    ``code`` has the term of each word (-1 for others), passages are
    ``code[start:end]``.
    """
    sums = np.concatenate([[0.0], np.cumsum(index.highest[code])])
    alive = np.flatnonzero(sums[ends] - sums[starts] >= _SURE)
    passages, items = [], []
    for at in range(0, len(alive), 512):
        some = alive[at : at + 512]
        owner, place = _spread(starts[some], ends[some] - starts[some])
        known = code[place] >= 0
        pair = np.unique(owner[known] * len(index.terms) + code[place][known])
        passage, term = pair // len(index.terms), pair % len(index.terms)
        # The pivot: a passage's terms of least impact that together can't reach
        # the threshold make no candidate, so their blocks are opened only where
        # a term from the pivot on has one.
        order = np.lexsort((index.highest[term], passage))
        passage, term = passage[order], term[order]
        highest = index.highest[term]
        head = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        total = np.cumsum(highest)
        before = np.repeat(total[head] - highest[head], np.diff(np.append(head, len(term))))
        pivot = total - before >= _SURE
        first = index.term_block[term]
        entry, block = _spread(first[pivot], (index.term_block[term + 1] - first)[pivot])
        candidates = np.unique(passage[pivot][entry] * index.n_blocks + index.block_of[block])
        if not len(candidates):
            continue
        entry, block = _spread(first, index.term_block[term + 1] - first)
        key = passage[entry] * index.n_blocks + index.block_of[block]
        near = np.minimum(np.searchsorted(candidates, key), len(candidates) - 1)
        left = candidates[near] == key
        entry, block, key = entry[left], block[left], key[left]
        keys, bound = _sums(key, index.block_max[block])
        keys = keys[bound >= _SURE]
        if not len(keys):
            continue
        near = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        left = keys[near] == key
        entry, block = entry[left], block[left]
        first = index.block_posting[block]
        which, posting = _spread(first, index.block_posting[block + 1] - first)
        keys, score = _sums(
            passage[entry][which] * len(index.item_ids) + index.posting_item[posting], index.posting_impact[posting]
        )
        keys = keys[score >= _SURE]
        passages.append(some[keys // len(index.item_ids)])
        items.append(keys % len(index.item_ids))
    if not passages:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(passages), np.concatenate(items)


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 12,
    passage_words: int = 20,
    index_chars: int = 8_000_000,
    slice_chars: int = 1_000_000,
) -> DataFrame:
    """(doc id, item id) of each document that holds at least ``n`` consecutive words of an item.

    Words are runs of letters and digits in one form, whatever stands between
    them.  Items of fewer than ``n`` words, null and empty texts give nothing;
    several rows of a document count as one.  Ids may be null.  Without items
    or documents the result is empty.  The index is built over about
    ``index_chars`` characters of items at a time: a larger set of items is
    queried in blocks, each over all documents.
    """
    spark = docs.sparkSession
    wanted = items.select(items[item_id].alias("__i"), items[item_text].alias("__t")).where("__t IS NOT NULL")
    total = wanted.agg(F.sum(F.length("__t").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // index_chars))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        index = build_index(list(zip(frame["__i"].tolist(), frame["__t"].tolist())), n)
        return pd.DataFrame({"index": [pickle.dumps(index)]})

    # Indexes are made by the executors, a block of items each; they pass the driver one after another.
    block = F.pmod(F.xxhash64("__i", "__t"), F.lit(blocks))
    numbered = wanted.withColumn("__b", block)
    if isinstance(items.schema[item_id].dataType, (T.LongType, T.IntegerType)):
        numbered = numbered.withColumn("__i", F.coalesce(F.col("__i").cast("string"), F.lit("")))
    built = numbered.groupBy("__b").applyInPandas(build, "index binary")
    schema = T.StructType(
        [
            T.StructField(doc_id, docs.schema[doc_id].dataType),
            T.StructField(item_id if item_id != doc_id else f"item_{item_id}", items.schema[item_id].dataType),
        ]
    )
    item_type = to_arrow_type(schema[1].dataType)
    whole = isinstance(schema[1].dataType, (T.LongType, T.IntegerType))
    texts = docs.select(docs[doc_id], docs[doc_text]).where(docs[doc_text].isNotNull())
    item_of = (lambda x: int(x) if x else None) if whole else (lambda x: x)
    step = passage_words - n + 1
    if step < 1:
        raise ValueError("passages must be longer than n words")
    result = None
    for row in built.toLocalIterator():
        shared = spark.sparkContext.broadcast(bytes(row["index"]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index: ItemIndex = pickle.loads(shared.value)
            if not index.item_ids:
                return
            get = index.terms.get
            for batch in batches:
                codes: list[np.ndarray] = []
                rows: list[int] = []
                held = 0
                for i, text in enumerate(batch.column(1).to_pylist()):
                    # Word by word where a list of all words would be large.
                    found = words_of(text) if len(text) < slice_chars else (m.group() for m in _word.finditer(plain(text)))
                    codes.append(np.fromiter((get(w, -1) for w in found), np.int32))
                    rows.append(i)
                    held += len(text)
                    if held >= slice_chars:
                        yield from found_in(index, batch, codes, rows)
                        codes, rows, held = [], [], 0
                if codes:
                    yield from found_in(index, batch, codes, rows)

        def found_in(index, batch, codes, rows) -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(c) for c in codes], np.int64)
            code = np.concatenate(codes)
            base = np.cumsum(sizes) - sizes
            count = np.where(sizes >= n, (np.maximum(sizes - n, 0)) // step + 1, 0)
            owner, k = _spread(np.zeros(len(codes), np.int64), count)
            starts = base[owner] + k * step
            ends = np.minimum(starts + passage_words, (base + sizes)[owner])
            pairs = set()
            for p, item in zip(*(x.tolist() for x in retrieve(index, code, starts, ends))):
                row = rows[owner[p]]
                if (row, item) in pairs:
                    continue
                words = code[starts[p] : ends[p]].tobytes()
                grams = index.passages[item]
                if any(words[a : a + 4 * n] in grams for a in range(0, len(words) - 4 * n + 1, 4)):
                    pairs.add((row, item))
            if pairs:
                at, which = zip(*sorted(pairs))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array([item_of(index.item_ids[x]) for x in which], item_type)],
                    names=schema.fieldNames(),
                )

        found = texts.mapInArrow(search, schema)
        result = found if result is None else result.unionByName(found)
    return spark.createDataFrame([], schema) if result is None else result.distinct()
