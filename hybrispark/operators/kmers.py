"""Abundance of k-letter words: an index table, lookups and the highest count per probe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybrispark.errors import ConfigurationError, ReferenceIndexError
from hybrispark.functions.seqfn import kmers, rev_comp
from hybrispark.operators import bases
from hybrispark.operators.mining import chunks


#: Letters of words up to which all possible ones fit in a table of counts: 4 ** 11 numbers, 32 MB.
DENSE = 11


def canonical(word: Column) -> Column:
    """The smaller of a word and its reverse complement."""
    return F.least(word, rev_comp(word))


def _words(df: DataFrame, id_col: str, seq_col: str, k: int, both_strands: bool) -> DataFrame:
    """(kmer) of every whole word, as texts; for words too long to be numbers."""
    # Chunks with a halo keep rows short: a word is cut in time with its place in the row.
    pieces = chunks(df, id_col, seq_col, 256, k - 1)
    found = pieces.select(F.explode(kmers("piece", k)).alias("kmer")).where(F.col("kmer").rlike("^[ACGT]+$"))
    return found.select(canonical(F.col("kmer")).alias("kmer")) if both_strands else found


def _packed(base: np.ndarray, k: int, both_strands: bool) -> tuple[np.ndarray, np.ndarray]:
    code, whole = bases.words(base, k)
    return (np.minimum(code, bases.turned_words(base, k)) if both_strands else code), whole


def count_codes(df: DataFrame, id_col: str = "seq_id", seq_col: str = "seq", k: int = 18, canonical: bool = False, piece: int = 65_536, run: int = 1_000_000) -> DataFrame:
    """(code, cnt) of every word of up to 31 letters, packed; counted within runs of about ``run`` words before the shuffle."""
    if not 1 <= k <= bases.MOST:
        raise ConfigurationError(f"packed words have 1 to {bases.MOST} letters")

    dense = k <= DENSE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        # Short words are counted in a table of all possible ones, once a task.
        table = np.zeros(4**k if dense else 0, np.int64)

        def flush() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and size < run:
                    size += len(texts[high]) + 1
                    high += 1
                code, whole = _packed(bases.to_codes("\n".join(texts[low:high])), k, canonical)
                low = high
                if dense:
                    table += np.bincount(code[whole], minlength=len(table))
                    continue
                held.append(code[whole])
                if sum(map(len, held)) >= run:
                    yield flush()
                    held = []
        if held:
            yield flush()
        seen = np.flatnonzero(table)
        for low in range(0, len(seen), 100_000):
            some = seen[low : low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some])], names=["code", "n"])

    # A chunk holds the words that begin in it, the last of which reach into its halo.
    pieces = chunks(df, id_col, seq_col, piece, k - 1).select("piece")
    counted = pieces.mapInArrow(count, "code long, n long")
    return counted.groupBy("code").agg(F.sum("n").alias("cnt"))


def build_kmer_index(
    df: DataFrame,
    id_col: str = "seq_id",
    seq_col: str = "seq",
    k: int = 18,
    canonical: bool = False,
    lower: int | None = None,
    upper: int | None = None,
    coded: bool = False,
) -> DataFrame:
    """(kmer, cnt) over all sequences, words with other letters than A, C, G, T left out.

    Words of up to 31 letters are counted as numbers, in part before the
    shuffle; ``coded`` leaves them so, as (code, cnt).  ``lower`` and ``upper``
    bound the counts kept.  Null, empty and short sequences have no words.
    """
    if k <= bases.MOST:
        counts = count_codes(df, id_col, seq_col, k, canonical)
    elif coded:
        raise ConfigurationError(f"words of more than {bases.MOST} letters have no code")
    else:
        counts = _words(df, id_col, seq_col, k, canonical).groupBy("kmer").agg(F.count("*").alias("cnt"))
    if lower is not None:
        counts = counts.where(F.col("cnt") >= lower)
    if upper is not None:
        counts = counts.where(F.col("cnt") <= upper)
    return counts if coded or k > bases.MOST else _spelt(counts, k)


def _spelt(counts: DataFrame, k: int) -> DataFrame:
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([bases.spell(batch.column(0).to_numpy(), k), batch.column(1)], names=["kmer", "cnt"])

    return counts.mapInArrow(spell, "kmer string, cnt long")


def save_kmer_index(index: DataFrame, path: str, k: int, canonical: bool = False) -> None:
    """Write an index with its parameters beside it."""
    index.write.mode("overwrite").parquet(f"{path}/counts")
    spark = index.sparkSession
    spark.createDataFrame([(k, canonical)], "k int, canonical boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_kmer_index(spark: SparkSession, path: str, k: int | None = None) -> tuple[DataFrame, int, bool]:
    """The counts of a written index, its k and whether words are canonical; an error if k differs."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta is None:
        raise ReferenceIndexError(f"no parameters beside the k-mer index {path}")
    if k is not None and meta["k"] != k:
        raise ReferenceIndexError(f"the index {path} has k={meta['k']}, not {k}")
    return spark.read.parquet(f"{path}/counts"), meta["k"], meta["canonical"]


def query_kmers(index: DataFrame, words: DataFrame, col: str = "kmer", canonical: bool = False, k: int | None = None) -> DataFrame:
    """The rows of ``words`` with the count of each word, 0 for one the index doesn't hold.

    With a coded index of words of ``k`` letters rows are joined by number, or,
    up to DENSE letters, look their word up in a table of all possible words,
    which bounds what is sent to the executors, and aren't shuffled.
    """
    key = F.upper(words[col])
    if "code" in index.columns:
        if k is None:
            raise ConfigurationError("a coded index tells nothing of k")
        if k <= DENSE:
            return _look_up(index, words, col, canonical, k)
        word = F.least(key, rev_comp(key)) if canonical else key
        digits = F.when(key.rlike(f"^[ACGT]{{{k}}}$"), F.translate(word, "ACGT", "0123"))
        keyed = words.withColumn("__k", F.conv(digits, 4, 10).cast("long"))
        counts = index.select(F.col("code").alias("__k"), F.col("cnt").cast("long").alias("cnt"))
    else:
        keyed = words.withColumn("__k", F.least(key, rev_comp(key)) if canonical else key)
        counts = index.select(F.col("kmer").alias("__k"), F.col("cnt").cast("long").alias("cnt"))
    return keyed.join(counts, "__k", "left").drop("__k").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("long")))


def _look_up(index: DataFrame, words: DataFrame, col: str, canonical: bool, k: int) -> DataFrame:
    found = index.select("code", "cnt").toArrow()
    table = np.zeros(4**k, np.int64)
    table[found.column("code").to_numpy()] = found.column("cnt").to_numpy()
    shared = words.sparkSession.sparkContext.broadcast(table)
    at = words.columns.index(col)
    schema = T.StructType([*words.schema.fields, T.StructField("cnt", T.LongType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            # Words of another length or with a line end of their own are no words of the index.
            texts = [t.upper() if t is not None and len(t) == k else "" for t in batch.column(at).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            code, whole = _packed(bases.to_codes("\n".join(texts)), k, canonical)
            first = np.cumsum(sizes + 1) - sizes - 1
            fits = sizes == k
            place = np.where(fits, first, 0)
            fits &= whole[np.minimum(place, max(len(whole) - 1, 0))] if len(whole) else False
            value = np.where(fits, counts[code[np.where(fits, place, 0)]], 0) if len(code) else np.zeros(len(texts), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=schema.fieldNames())

    return words.mapInArrow(look_up, schema)


def _probe_codes(seqs: DataFrame, k: int, canonical: bool) -> DataFrame:
    """(sequence, code) of the different words of each sequence; -1 for those with other letters."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.upper() for t in batch.column(0).to_pylist()]
            low = 0
            while low < len(texts):
                high, held = low, 0
                while high < len(texts) and held < 1_000_000:
                    held += len(texts[high]) + 1
                    high += 1
                some = texts[low:high]
                sizes = np.array([len(t) for t in some], np.int64)
                base = bases.to_codes("\n".join(some))
                code, whole = _packed(base, k, canonical)
                code = np.where(whole, code, -1)
                count = np.maximum(sizes - k + 1, 0)
                first = np.cumsum(sizes + 1) - sizes - 1
                owner = np.repeat(np.arange(len(some)), count)
                code = code[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(owner))]
                order = np.lexsort((code, owner))
                owner, code = owner[order], code[order]
                fresh = np.append(True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1]))[: len(owner)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low).take(pa.array(owner[fresh])), pa.array(code[fresh])], names=["sequence", "code"]
                )
                low = high

    return seqs.mapInArrow(cut, "sequence string, code long")


def max_kmer(index: DataFrame, probes: DataFrame, seq_col: str = "probe_seq", k: int = 18, canonical: bool = False) -> DataFrame:
    """(sequence, max_kmer) of every distinct sequence: the highest count among its words.

    Null for a sequence shorter than k.  The index may be coded, which makes
    the join one of numbers.
    """
    seqs = probes.select(F.col(seq_col).alias("sequence")).where("sequence IS NOT NULL").distinct()
    if "code" in index.columns:
        key, asked = "code", _probe_codes(seqs, k, canonical)
    else:
        key = "kmer"
        asked = seqs.select("sequence", F.explode(F.array_distinct(kmers(F.upper("sequence"), k))).alias("kmer"))
        if canonical:
            asked = asked.withColumn("kmer", F.least("kmer", rev_comp("kmer")))
    found = asked.join(index.select(key, "cnt").hint("merge"), key, "left")
    best = found.groupBy("sequence").agg(F.max(F.coalesce("cnt", F.lit(0))).cast("int").alias("max_kmer"))
    return seqs.join(best.hint("merge"), "sequence", "left")


#: Words of more than one place up to which they are sent to all executors, at sixteen bytes each.
MOST_REPEATED = 1_000_000


def add_max_kmer(
    probes: DataFrame, index: DataFrame, k: int = 18, seq_col: str = "probe_seq", canonical: bool = False, within: bool = False
) -> DataFrame:
    """The probes with ``max_kmer``, null where a sequence is null or shorter than k.

    ``within`` tells that the index holds every word of the probes, as one over
    the sequences they were cut from does.  Then words that occur once needn't
    be looked up: with a coded index, and unless it has more than
    MOST_REPEATED words of several places, the probes are neither multiplied
    nor shuffled.
    """
    if within and "code" in index.columns:
        # Asked for with a bound; one more than it tells that there are more.
        found = index.where(F.col("cnt") > 1).limit(MOST_REPEATED + 1).toArrow()
        if found.num_rows <= MOST_REPEATED:
            return _add_from_repeated(probes, found, k, seq_col, canonical)
    best = max_kmer(index, probes, seq_col, k, canonical).withColumnRenamed("sequence", "__s")
    return probes.join(best.hint("merge"), probes[seq_col] == F.col("__s"), "left").drop("__s")


def _add_from_repeated(probes: DataFrame, repeated: pa.Table, k: int, seq_col: str, canonical: bool) -> DataFrame:
    code, count = (repeated.column(c).to_numpy() for c in ("code", "cnt"))
    order = np.argsort(code)
    shared = probes.sparkSession.sparkContext.broadcast((code[order], count[order]))
    at = probes.columns.index(seq_col)
    schema = T.StructType([*probes.schema.fields, T.StructField("max_kmer", T.IntegerType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            low = 0
            while low < len(texts):
                high, held = low, 0
                while high < len(texts) and held < 1_000_000:
                    held += len(texts[high] or "") + 1
                    high += 1
                best = _best(texts[low:high], known, counts)
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns), best], names=schema.fieldNames())
                low = high

    def _best(texts: list[str | None], known: np.ndarray, counts: np.ndarray) -> pa.Array:
        sizes = np.array([len(t or "") for t in texts], np.int64)
        code, whole = _packed(bases.to_codes("\n".join((t or "").upper() for t in texts)), k, canonical)
        value = whole.astype(np.int64)
        if len(known) and len(code):
            near = np.minimum(np.searchsorted(known, code), len(known) - 1)
            value = np.where(whole & (known[near] == code), counts[near], value)
        n = np.maximum(sizes - k + 1, 0)
        first = np.cumsum(sizes + 1) - sizes - 1
        best = np.zeros(len(texts), np.int64)
        some = np.flatnonzero(n)
        if len(some):
            # Places of the words of each text, and of those across texts, in turn.
            edges = np.stack([first[some], first[some] + n[some]], 1).ravel()
            best[some] = np.maximum.reduceat(np.append(value, 0), edges)[::2]
        return pa.array(best.astype(np.int32), mask=n == 0)

    return probes.mapInArrow(look_up, schema)
