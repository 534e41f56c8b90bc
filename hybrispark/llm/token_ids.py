"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Texts are cut into pre-tokens by numpy over character classes; all pre-tokens
of a slice walk a minimal acyclic automaton of frequent words together, whose
outputs are token ids.  Words it doesn't hold are merged exactly, by the ranks
of the vocabulary, and remembered.  The ids are those of the public tokenizer
whatever the automaton holds; its words only decide how much merging is left.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybrispark.llm import lexicon
from hybrispark.session import checkpoint_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public tokenizer's pattern of pre-tokens, a fixed value; cut_points() follows it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE, _LETTER, _NUMBER, _OTHER, _BREAK = range(5)
#: Characters of Unicode's White_Space property, a fixed value.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_REMEMBERED = 300_000


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = _SPACE
    return table


def cut_points(chars: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every pre-token; ``breaks`` are places of characters between texts."""
    kind = _classes()[chars]
    kind[breaks] = _BREAK
    n = len(chars)
    begins = np.zeros(n + 1, bool)
    begins[0] = begins[n] = True
    begins[1:n] = kind[1:] != kind[:-1]
    begins[breaks] = True
    begins[breaks + 1] = True
    # The last blank before a word, number or sign belongs to it; other white
    # space before it stands alone, apart from the rest of its run.
    follows = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _BREAK))
    begins[follows] = True
    begins[follows[chars[follows] == 0x20] + 1] = False
    # Contractions: a lone apostrophe that no blank precedes takes the letters after it.
    q = np.flatnonzero((chars == 0x27) & (kind == _OTHER))
    if len(q):
        q = q[(q + 1 < n)]
        before = np.where(q > 0, q - 1, 0)
        alone = (kind[q + 1] == _LETTER) & ((q == 0) | ((kind[before] != _OTHER) & (chars[before] != 0x20)) | (kind[before] == _BREAK))
        q = q[alone]
        one = chars[q + 1]
        two = np.where((q + 2 < n), chars[np.minimum(q + 2, n - 1)], 0)
        two[(kind[np.minimum(q + 2, n - 1)] != _LETTER)] = 0
        size = np.where(np.isin(one, [ord(c) for c in "sdmt"]), 1, 0)
        for a, b in ("ll", "ve", "re"):
            size[(one == ord(a)) & (two == ord(b))] = 2
        q, size = q[size > 0], size[size > 0]
        begins[q + 1] = False
        begins[q + 1 + size] = True
    points = np.flatnonzero(begins)
    starts, ends = points[:-1], points[1:]
    words = kind[starts] != _BREAK
    return starts[words], ends[words]


@functools.lru_cache(2)
def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


class Encoder:
    """Encodes lists of texts; made once a Python worker."""

    def __init__(self, vocabulary: str, automaton: str):
        self.tokenizer, _ = _tokenizer(vocabulary)
        self.lex = lexicon.load(automaton)
        self.merged: dict[bytes, list[int]] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        joined = "\n".join(texts)
        data = np.frombuffer(joined.encode(), np.uint8)
        if len(data) == len(joined):
            chars, places = data, None
        else:
            chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            width = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
            places = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        lengths = np.array([len(t) for t in texts], np.int64)
        text_ends = np.cumsum(lengths + 1) - 1
        if not len(chars):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        starts, ends = cut_points(chars, text_ends[:-1])
        owner = np.searchsorted(text_ends, starts, "left")
        if places is not None:
            starts, ends = places[starts], places[ends]
        word = lexicon.find(self.lex, data, starts, ends)
        offset, ids = self.lex["offset"], self.lex["ids"]
        unseen = np.flatnonzero(word < 0)
        source = offset[word]
        size = offset[word + 1] - source
        if len(unseen):
            extra, first = [], []
            merged, raw = self.merged, data.tobytes()
            at, merge = len(ids), self.tokenizer._encode_single_piece
            for a, b in zip(starts[unseen].tolist(), ends[unseen].tolist()):
                piece = raw[a:b]
                known = merged.get(piece)
                if known is None:
                    if len(merged) >= _REMEMBERED:
                        merged.clear()
                    known = merged[piece] = merge(piece)
                first.append(len(known))
                extra.extend(known)
            size[unseen] = first
            source[unseen] = at + np.concatenate([[0], np.cumsum(first)[:-1]])
            ids = np.concatenate([ids, np.array(extra, np.int32)])
        total = np.cumsum(size, dtype=np.int64)
        gather = np.repeat(source - (total - size), size) + np.arange(total[-1] if len(total) else 0)
        return ids[gather], np.bincount(owner, size, len(texts)).astype(np.int64)


@functools.lru_cache(2)
def _encoder(vocabulary: str, automaton: str) -> Encoder:
    return Encoder(vocabulary, automaton)


def compile_lexicon(df: DataFrame, text_col: str, vocabulary: str, sample_rows: int, words: int, sample_chars: int = 8_000_000) -> bytes:
    """The automaton as a file: all whole words of the vocabulary and the most frequent words of some texts.

    The texts come to the driver: ``sample_rows`` at most, none longer than
    their share of ``sample_chars``.
    """
    tokenizer, ranks = _tokenizer(vocabulary)
    merge = tokenizer._encode_single_piece
    entries = {piece: merge(piece) for piece in ranks}
    counts: Counter[bytes] = Counter()
    short = df.select(text_col).where(F.length(df[text_col]) <= sample_chars // sample_rows)
    texts = [r[0] for r in short.limit(sample_rows).toLocalIterator()]
    for part, _ in text_slices(texts, 1_000_000):
        joined = "\n".join(part)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(chars):
            continue
        starts, ends = cut_points(chars, np.cumsum([len(t) + 1 for t in part])[:-1] - 1)
        counts.update(joined[a:b] for a, b in zip(starts.tolist(), ends.tolist()) if b - a <= 32)
    for piece, n in counts.most_common(words):
        if n > 1:
            entries.setdefault(piece.encode(), merge(piece.encode()))
    return lexicon.dump(lexicon.build(entries))


def _publish(spark: SparkSession, content: bytes) -> str:
    """Put a file into the shared folder and let every machine fetch a copy of its own; its name.

    The name tells the content, so that equal ones are written and fetched
    once.  The file is deleted when the session's machine ends.
    """
    sc = spark.sparkContext
    name = f"lexicon-{hashlib.sha256(content).hexdigest()[:24]}.bin"
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        fs.deleteOnExit(path)
    if not any(str(f).rsplit("/", 1)[-1] == name for f in sc.listFiles):
        sc.addFile(path.toString())
    return name


def text_slices(texts: list[str | None], most: int) -> Iterator[tuple[list[str], list[int]]]:
    """Lists of about ``most`` characters, and the number of the text of each entry.

    A longer text is cut before a blank that follows another character, where
    a pre-token always begins; it comes alone, in several entries.
    """
    part: list[str] = []
    owners: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and held + len(t) > most:
            yield part, owners
            part, owners, held = [], [], 0
        a = 0
        while len(t) - a > 2 * most:
            b = a + most
            while (b := t.find(" ", b)) >= 0 and t[b - 1].isspace():
                b += 1
            if b < 0:
                break
            part.append(t[a:b])
            owners.append(i)
            a = b
        part.append(t[a:] if a else t)
        owners.append(i)
        held += len(t)
    if part:
        yield part, owners


def token_ids(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    lexicon_words: int = 30_000,
    lexicon_rows: int = 1_000,
    slice_chars: int = 1_000_000,
) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens, one row a row of ``df``.

    An empty and a null text both give an empty list; a null id is kept; equal
    rows each give theirs.  Texts of any length are encoded whole, in slices of
    ``slice_chars``.  ``vocabulary`` is a file of ranks at the same path on
    every machine.  ``lexicon_rows`` bounds the texts whose frequent words the
    automaton holds beside the vocabulary's; no result depends on it.
    """
    spark = df.sparkSession
    schema = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )
    name = _publish(spark, compile_lexicon(df, text_col, vocabulary, lexicon_rows, lexicon_words))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, SparkFiles.get(name))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part, owners in text_slices(texts, slice_chars):
                ids, sizes = _encode_parts(encoder, part, slice_chars)
                low, high = owners[0], owners[-1] + 1
                per_text = np.bincount(np.array(owners) - low, sizes, high - low).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(per_text, dtype=np.int32)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))],
                    names=schema.fieldNames(),
                )

    return df.select(df[id_col], df[text_col]).mapInArrow(encode, schema)


def _encode_parts(encoder: Encoder, part: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Encode a slice; entries of a long text one at a time, to bound memory."""
    if sum(map(len, part)) <= 3 * most:
        return encoder.encode(part)
    done = [encoder.encode([p]) for p in part]
    return np.concatenate([i for i, _ in done]), np.concatenate([s for _, s in done])
