"""Text forms of probes and sequences, and writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybrispark.errors import ConfigurationError, EmptyExportError
from hybrispark.functions.seqfn import probe_id
from hybrispark.operators.annotation import classify_ids
from hybrispark.sources import files


def bed_lines(probes: DataFrame) -> DataFrame:
    """seq_id, start, stop, bases and Tm, tab-separated, Tm with two decimals."""
    return probes.select(F.format_string("%s\t%d\t%d\t%s\t%.2f", "seq_id", "start", "stop", "probe_seq", "tm").alias("value"))


def fastq_lines(probes: DataFrame) -> DataFrame:
    """Four lines a probe, of the highest quality."""
    quality = F.repeat(F.lit("~"), F.length("probe_seq"))
    return probes.select(F.concat_ws("\n", F.concat(F.lit("@"), probe_id("seq_id", "start", "stop")), "probe_seq", F.lit("+"), quality).alias("value"))


def csv_lines(probes: DataFrame) -> DataFrame:
    """The five columns of a probe, comma-separated, without the header."""
    return probes.select(F.format_string("%s,%d,%d,%s,%.2f", "seq_id", "start", "stop", "probe_seq", "tm").alias("value"))


def wrap(seq: Column, width: int | None = 60) -> Column:
    """A sequence in lines of ``width`` letters; 0 or None leaves it in one."""
    if not width:
        return seq
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def fasta_lines(sequences: DataFrame, id_col: str = "seq_id", seq_col: str = "seq", width: int | None = 60) -> DataFrame:
    return sequences.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), wrap(F.col(seq_col), width)).alias("value"))


def last_by_key(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row a key: the last by ordinal."""
    w = Window.partitionBy(key).orderBy(F.desc(ordinal))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _save(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def _not_empty(spark: SparkSession, path: str, what: str) -> None:
    """An error, and no folder left, if nothing was written; the plan isn't run for it."""
    if spark.read.text(path).isEmpty():
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        raise EmptyExportError(f"no {what} to write")


def write_probes(probes: DataFrame, path: str, fmt: str = "bed") -> None:
    """Write probes as bed, fastq or csv."""
    if fmt == "csv":
        rows = probes.select("seq_id", "start", "stop", "probe_seq", F.format_string("%.2f", "tm").alias("tm"))
        rows.write.mode("overwrite").csv(path, header=True)
        return
    forms = {"bed": bed_lines, "fastq": fastq_lines}
    if fmt not in forms:
        raise ConfigurationError(f"unknown format {fmt!r}")
    _save(forms[fmt](probes), path)


def write_fasta(sequences: DataFrame, path: str, id_col: str = "seq_id", seq_col: str = "seq", width: int | None = 60) -> None:
    """Write a folder of FASTA files; an error without sequences, told by what was written."""
    _save(fasta_lines(sequences, id_col, seq_col, width), path)
    _not_empty(sequences.sparkSession, path, "sequences")


def split_fasta(sequences: DataFrame, path: str, id_col: str = "seq_id", seq_col: str = "seq", width: int | None = 60) -> None:
    """One folder for each id."""
    lines = sequences.select(F.col(id_col).alias("id"), F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), wrap(F.col(seq_col), width)).alias("value"))
    lines.write.mode("overwrite").partitionBy("id").text(path)


# The columns of the annotation formats.
GTF_COLUMNS = ["seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes"]
BED_COLUMNS = ["seqid", "start", "end", "gene_id", "score", "strand", "coverage", "transcript_id"]


def write_gtf(gtf: DataFrame, path: str) -> None:
    gtf.write.mode("overwrite").csv(path, sep="\t", quote='"', escape='"')
    _not_empty(gtf.sparkSession, path, "annotation")


def write_annotation_bed(gtf: DataFrame, path: str) -> None:
    """Those of the usual columns that are there; coordinates aren't shifted."""
    gtf.select(*[c for c in BED_COLUMNS if c in gtf.columns]).write.mode("overwrite").csv(path, sep="\t")


def split_gtf(gtf: DataFrame, path: str) -> None:
    """One folder for each sequence, with header lines."""
    gtf.withColumn("id", F.col("seqid")).write.mode("overwrite").partitionBy("id").csv(path, sep="\t", header=True)


def write_align_csv(alignments: DataFrame, path: str) -> None:
    alignments.write.mode("overwrite").csv(path, header=True)


def write_probe_table(probes: DataFrame, path: str) -> None:
    """All columns as CSV, numbers with a point to two decimals."""
    kinds = dict(probes.dtypes)
    cols = [F.format_string("%.2f", c).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in probes.columns]
    probes.select(*cols).write.mode("overwrite").csv(path, header=True)


def write_classes(ids: DataFrame, path: str, rules: Mapping[str, str] | None = None, default: str = "canonical", id_col: str = "seq_id") -> DataFrame:
    """The class of every id, written tab-separated with a header; the classes."""
    classes = ids.select(F.col(id_col).alias("seq_id"), classify_ids(id_col, rules, default).alias("category"))
    classes.write.mode("overwrite").csv(path, sep="\t", header=True)
    return classes


def merge_text_files(spark: SparkSession, patterns: list[str], path: str) -> None:
    """The lines of text files one after another, by file name and place in the file."""
    lines = spark.read.text(patterns).select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"), "value"
    )
    lines.orderBy("file", "part", "row").select("value").write.mode("overwrite").text(path)


def merge_fastas(spark: SparkSession, folder: str, path: str) -> None:
    """All FASTA files of a folder as one, by file name; an error without any."""
    found = files._existing(spark, [f"{folder}/*{e}" for e in files.FASTA_EXTENSIONS], "FASTA files", folder)
    merge_text_files(spark, found, path)


def merge_annotation_beds(spark: SparkSession, folder: str, path: str, extension: str = ".bed") -> None:
    """All annotation files of an ending in a folder as one, by file name; an error without any."""
    merge_text_files(spark, files._existing(spark, [f"{folder}/*{extension}"], "annotation files", folder), path)


def to_fasta_text(sequences: Sequence[str], ids: Sequence[str] | None = None) -> str:
    """A few sequences as FASTA text; without ids they are seq_0, seq_1 and so on."""
    names = [f"seq_{i}" for i in range(len(sequences))] if ids is None else ids
    return "".join(f">{n}\n{s}\n" for n, s in zip(names, sequences))


def to_fastq_text(sequences: Sequence[str], ids: Sequence[str] | None = None) -> str:
    """A few sequences as FASTQ text of the highest quality."""
    names = [f"seq_{i}" for i in range(len(sequences))] if ids is None else ids
    return "".join(f"@{n}\n{s}\n+\n{'~' * len(s)}\n" for n, s in zip(names, sequences))
