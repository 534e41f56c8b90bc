"""Readers of sequence and annotation files."""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybrispark.errors import EmptyExportError, InvalidInputError, MissingInputError
from hybrispark.functions.seqfn import probe_id
from hybrispark.operators.mining import mine

# The columns of the formats, and the endings of FASTA files.
GTF_SCHEMA = "seqid string, source string, type string, start int, end int, score string, strand string, phase string, attributes string"
PROBE_SCHEMA = "seq_id string, start int, stop int, probe_seq string, tm double"
ALIGN_SCHEMA = "align_seqid string, align_start int, align_stop int, seqid string, align_score string, align_strand string, align_cigar string"
FASTA_EXTENSIONS = (".fa", ".fasta", ".fna", ".fas")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, seq_ord, seq_id, seq): the records of FASTA files, in upper case.

    Files are split at the signs that begin a record, so that one file is read
    by many tasks; a record is one row.  ``seq_ord`` orders the records of a
    file: the split's first byte and the row within its task.  The id is the
    first word of the header; records without one are ignored.
    """
    lines = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), "value")
    record = F.regexp_replace("value", "^>", "")
    first = F.regexp_extract(record, r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(record, r"^[^\r\n]*", ""), r"\s", "")
    rows = lines.select(
        "file",
        F.struct(F.col("__block").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq_ord"),
        F.regexp_extract(first, r"^\s*(\S+)", 1).alias("seq_id"),
        F.upper(body).alias("seq"),
    )
    return rows.where("seq_id <> ''")


def read_fasta_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all FASTA files of a folder, known by their endings; ``file`` and ``seq_ord`` tell their order."""
    found = [f"{folder}/*{e}" for e in FASTA_EXTENSIONS] + [f"{folder}/*{e.upper()}" for e in FASTA_EXTENSIONS]
    return read_fasta(spark, _existing(spark, found, "FASTA files", folder))


def _existing(spark: SparkSession, patterns: list[str], what: str, folder: str) -> list[str]:
    """Those of some patterns that match a file; an error without any."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def matches(pattern: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(conf).globStatus(path)
        return found is not None and len(found) > 0

    kept = [p for p in patterns if matches(p)]
    if not kept:
        raise EmptyExportError(f"no {what} in {folder}")
    return kept


def read_fasta_pieces(spark: SparkSession, path: str | list[str], size: int = 100_000, halo: int = 36) -> DataFrame:
    """(seq_id, offset, total, piece) of FASTA files, as chunks() cuts sequences, without a record ever being one row.

    Each part of a file is read by itself.  What stands before its first header
    belongs to the last record of the parts before it, which a row for each
    part tells.  Lines are then put together by record and piece.  Records of
    equal ids in several files are records of their own only by ``file``.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), "value"
    )
    schema = "file string, part long, record int, seq_id string, offset long, letters string"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of a part as stretches of up to ``size`` letters; record 0 is what stands before the first header."""
        key: tuple | None = None
        record, name, offset, held = 0, None, 0, []
        out: list[tuple] = []

        def close(force: bool) -> None:
            nonlocal offset, held
            text = "".join(held)
            while text and (force or len(text) >= size):
                out.append((*key, record, name, offset, text[:size]))
                offset += len(text[:size])
                text = text[size:]
            held = [text] if text else []

        for batch in batches:
            for file, part, line in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if (file, part) != key:
                    if key is not None:
                        close(True)
                    key, record, name, offset, held = (file, part), 0, None, 0, []
                    # A row for each part, even one without letters.
                    out.append((file, part, 0, None, 0, ""))
                if line.startswith(">"):
                    close(True)
                    words = line[1:].split()
                    record, name, offset = record + 1, words[0] if words else "", 0
                    out.append((*key, record, name, 0, ""))
                else:
                    held.append("".join(line.split()).upper())
                    if len(held) > 2_000:
                        close(False)
            if len(out) > 50:
                yield _rows(out)
                out = []
        if key is not None:
            close(True)
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in schema.split(", ")])

    stretches = lines.mapInArrow(fold, schema)
    n = F.length("letters").cast("long")
    # By part: its last record, the letters of that, and those before its first header.
    parts = stretches.groupBy("file", "part").agg(
        F.max(F.struct("record", "seq_id")).alias("last"),
        F.coalesce(F.sum(F.when(F.col("record") == 0, n)), F.lit(0)).alias("lead"),
    )
    tails = stretches.groupBy("file", "part", "record").agg(F.sum(n).alias("tail"))
    parts = parts.join(tails, ["file", "part"]).where("record = last.record")
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    headed = F.col("last.record") > 0
    parts = parts.withColumn("group", F.coalesce(F.sum(headed.cast("int")).over(before), F.lit(0)))
    inside = Window.partitionBy("file", "group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.struct("part", F.col("last.record").alias("record"), F.col("last.seq_id").alias("seq_id"), "tail")
    parts = parts.select(
        "file",
        "part",
        F.last(F.when(headed, kept), True).over(before).alias("from"),
        F.coalesce(F.sum("lead").over(inside), F.lit(0)).alias("more"),
    )
    joined = stretches.where("letters <> ''").join(parts, ["file", "part"])
    follows = F.col("record") == 0
    placed = joined.select(
        "file",
        F.when(follows, F.col("from.part")).otherwise(F.col("part")).alias("part"),
        F.when(follows, F.col("from.record")).otherwise(F.col("record")).alias("record"),
        F.when(follows, F.col("from.seq_id")).otherwise(F.col("seq_id")).alias("seq_id"),
        (F.col("offset") + F.when(follows, F.col("from.tail") + F.col("more")).otherwise(0)).alias("at"),
        "letters",
    ).where("seq_id <> ''")
    record = ["file", "part", "record", "seq_id"]
    totals = placed.groupBy(*record).agg(F.sum(F.length("letters")).cast("int").alias("total"))
    end = F.col("at") + F.length("letters")
    # A stretch goes into each piece it touches, and into the halo of the one before.
    touched = F.sequence(F.greatest(F.floor((F.col("at") - halo) / size), F.lit(0)), F.floor((end - 1) / size))
    cells = placed.withColumn("cell", F.explode(touched)).withColumn("low", F.greatest(F.col("at"), F.col("cell") * size))
    cells = cells.withColumn("high", F.least(end, F.col("cell") * size + size + halo)).where("low < high")
    cells = cells.select(*record, "cell", "low", F.substr("letters", (F.col("low") - F.col("at") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")).alias("letters"))
    pieces = cells.groupBy(*record, "cell").agg(F.array_sort(F.collect_list(F.struct("low", "letters"))).alias("x"))
    whole = F.array_join(F.transform("x", lambda x: x["letters"]), "")
    plain = F.when(whole.rlike(r"[^\x00-\x7F]"), F.regexp_replace(whole, r"[^\x00-\x7F]", "N")).otherwise(whole)
    return pieces.join(totals, record).select("seq_id", (F.col("cell") * size).cast("int").alias("offset"), "total", plain.alias("piece"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Annotation lines; what follows a ``#`` is a comment, doubled quotes within quoted fields are one."""
    raw = spark.read.text(path).select(F.regexp_replace("value", "#.*$", "").alias("value")).where(F.trim("value") != "")
    parsed = F.from_csv("value", GTF_SCHEMA, {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return raw.select(parsed.alias("r")).select("r.*")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Alignments as written by the BED sink; an empty file gives an empty table."""
    rows = spark.read.csv(path, sep="\t", schema=ALIGN_SCHEMA)
    return rows.withColumn("align_score", F.expr("try_cast(align_score AS INT)"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Lines of SAM text."""
    return spark.read.text(path)


def read_probe_csv(spark: SparkSession, path: str) -> DataFrame:
    """Probes with a header line; columns beyond the first five are read as text."""
    try:
        rows = spark.read.csv(path, header=True)
    except AnalysisException as e:
        raise MissingInputError(f"no file {path}") from e
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(PROBE_SCHEMA).fields} | {"max_kmer": T.IntegerType()}
    return rows.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in rows.columns])


def read_align_csv(spark: SparkSession, path: str) -> DataFrame:
    """Alignments with a header line."""
    rows = spark.read.csv(path, header=True)
    kinds = {"align_start": "int", "align_stop": "int", "align_score": "int"}
    return rows.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in rows.columns])


def read_appending_set(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, seq) of a tab-separated set with a header, compressed or not, in file order."""
    rows = spark.read.csv(path, sep="\t", header=True).coalesce(1)
    return rows.select(F.monotonically_increasing_id().alias("ord"), "id", "seq")


#: Named appending sets and how many sequences each has: fixed values.  The files are the user's.
APPENDING_SETS = {
    "bridges": 800, "outer_forward": 10, "outer_reverse": 10, "inner_forward": 74, "inner_reverse": 74, "saber_1x": 50,
    "saber_2x": 50, "merfish_bridges": 16, "merfish_primers": 318, "kishi_bridges": 84, "mateo_bridges": 199, "xia_bridges": 70,
}


def load_appending_set(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """(ord, id, seq) of one of the named sets, from the file of its name in a folder."""
    if name not in APPENDING_SETS:
        raise InvalidInputError(f"unknown set {name!r}; known: {', '.join(APPENDING_SETS)}")
    endings = (".tsv", ".tsv.gz", ".txt", ".txt.gz")
    return read_appending_set(spark, _existing(spark, [f"{folder}/{name}{e}" for e in endings], f"set {name}", folder)[0])


def example_genome(spark: SparkSession, records: int = 4, size: int = 14_940) -> DataFrame:
    """(seq_id, seq): a made-up genome by rule, for trials; the same on every call."""
    rng = np.random.default_rng(1)
    made = [(f"chr{i + 1}", "".join("ACGT"[x] for x in rng.integers(0, 4, size))) for i in range(records)]
    return spark.createDataFrame(made, "seq_id string, seq string")


def example_annotation(spark: SparkSession, genes: int = 6) -> DataFrame:
    """Annotation lines of genes with two transcripts each that share exons, on the made-up genome."""
    rows = []
    for g in range(genes):
        for t in range(2):
            for e in range(3):
                start = 500 + 2_000 * g + 600 * e + 40 * t
                rows.append((f"chr{g % 4 + 1}", "example", "exon", start, start + 300, ".", "+-"[g % 2], ".", f'gene_id "G{g}"; gene_name "gene{g}"; transcript_id "G{g}T{t}.1";'))
    return spark.createDataFrame(rows, GTF_SCHEMA)


def example_probes(spark: SparkSession) -> DataFrame:
    """Probes of the made-up genome mined by default, as a probe file has them."""
    return mine(example_genome(spark)).withColumn("seqid", probe_id("seq_id", "start", "stop"))


def as_sequences(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A table of sequences as it is, or the records of the FASTA file a path names."""
    return source if isinstance(source, DataFrame) else read_fasta(spark, source).select("seq_id", "seq")


def print_chromosome_sizes(sequences: DataFrame, rows: int = 1_000) -> None:
    """Ids and sizes, tab-separated, the largest first; at most ``rows`` of them come to the driver."""
    for r in chromosome_sizes(sequences).limit(rows).collect():
        print(f"{r['seq_id']}\t{r['size']}")


def chromosome_sizes(sequences: DataFrame, id_col: str = "seq_id", seq_col: str = "seq", ordinal: str | None = None) -> DataFrame:
    """(seq_id, size), the largest first; equal sizes in the order of ``ordinal``, else of the id."""
    return sequences.select(F.col(id_col).alias("seq_id"), F.length(seq_col).alias("size"), F.col(ordinal or id_col).alias("__o")).orderBy(
        F.desc("size"), "__o"
    ).drop("__o")


class _Unpacked(io.RawIOBase):
    """A BGZF file as one stream of its content, a block in memory at a time."""

    def __init__(self, file):
        self.file, self.block, self.at = file, b"", 0

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes; fewer only at the end."""
        parts = []
        while n:
            if self.at == len(self.block):
                head = self.file.read(18)
                if len(head) < 18:
                    break
                size = struct.unpack_from("<H", head, 16)[0] + 1
                if head[:4] != b"\x1f\x8b\x08\x04":
                    raise MissingInputError("not a BGZF file")
                self.block, self.at = zlib.decompress(self.file.read(size - 18)[:-8], -15), 0
                continue
            part = self.block[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)


class _Gzip(_Unpacked):
    """The same of a file compressed as a whole."""

    def __init__(self, file):
        self.stream = gzip.GzipFile(fileobj=file)

    def take(self, n: int) -> bytes:
        return self.stream.read(n)


_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_FORMS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def _tags(raw: bytes, p: int) -> Iterator[str]:
    """The tags of a BAM record as SAM writes them."""
    while p < len(raw):
        tag, kind = raw[p : p + 2].decode(), chr(raw[p + 2])
        p += 3
        if kind in "ZH":
            end = raw.index(b"\0", p)
            yield f"{tag}:{kind}:{raw[p:end].decode()}"
            p = end + 1
        elif kind == "B":
            form, n = chr(raw[p]), struct.unpack_from("<i", raw, p + 1)[0]
            values = struct.unpack_from(f"<{n}{_FORMS[form][1]}", raw, p + 5)
            yield f"{tag}:B:{form}," + ",".join(f"{v:g}" if form == "f" else str(v) for v in values)
            p += 5 + n * _SIZES[form]
        elif kind == "A":
            yield f"{tag}:A:{chr(raw[p])}"
            p += 1
        else:
            value = struct.unpack_from(_FORMS[kind], raw, p)[0]
            yield f"{tag}:{'f' if kind == 'f' else 'i'}:{value:g}" if kind == "f" else f"{tag}:i:{value}"
            p += _SIZES[kind]


def bam_lines(file) -> Iterator[str]:
    """The records of an open BAM file as SAM lines, with all their tags."""
    start = file.read(4)
    file.seek(0)
    stream = _Unpacked(file) if start == b"\x1f\x8b\x08\x04" else _Gzip(file)
    if stream.take(4) != b"BAM\1":
        raise MissingInputError("not a BAM file")
    number = lambda: struct.unpack("<i", stream.take(4))[0]
    stream.take(number())
    names = []
    for _ in range(number()):
        names.append(stream.take(number())[:-1].decode())
        number()
    while head := stream.take(4):
        raw = stream.take(struct.unpack("<i", head)[0])
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_ref, next_pos, length = struct.unpack_from("<iiBBHHHiiii", raw)
        p = 32
        name = raw[p : p + l_name - 1].decode()
        p += l_name
        cigar = "".join(f"{o >> 4}{'MIDNSHP=X'[o & 15]}" for o in struct.unpack_from(f"<{n_cigar}I", raw, p)) or "*"
        p += 4 * n_cigar
        letters = "=ACMGRSVTWYHKDBN"
        seq = "".join(letters[b >> 4] + letters[b & 15] for b in raw[p : p + (l_seq + 1) // 2])[:l_seq]
        p += (l_seq + 1) // 2
        qual = "*" if l_seq and raw[p] == 255 else "".join(chr(q + 33) for q in raw[p : p + l_seq])
        p += l_seq
        mate = "*" if next_ref < 0 else "=" if next_ref == ref else names[next_ref]
        fields = [name, str(flag), names[ref] if ref >= 0 else "*", str(pos + 1), str(mapq), cigar, mate, str(next_pos + 1), str(length), seq or "*", qual or "*"]
        yield "\t".join([*fields, *_tags(raw, p)])


def read_bam(spark: SparkSession, path: str, rows_per_batch: int = 10_000) -> DataFrame:
    """The records of BAM files as SAM lines.

    A file is a task's stream, block by block, whatever its size; records lie
    across blocks without marks, so a file isn't divided.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").repartitionByRange("path")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, inner = pa_fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)
                part: list[str] = []
                with fs.open_input_file(inner) as file:
                    for line in bam_lines(file):
                        part.append(line)
                        if len(part) == rows_per_batch:
                            yield pa.RecordBatch.from_arrays([pa.array(part)], names=["value"])
                            part = []
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(part)], names=["value"])

    return files.mapInArrow(lines, "value string")
