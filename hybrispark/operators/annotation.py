"""Annotation tables: attributes, filters, classification of ids, transcripts and flattened genes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybrispark.errors import InvalidInputError
from hybrispark.functions.seqfn import attribute, attribute_entries, interval_label
from hybrispark.operators.packed_values import parse_field
from hybrispark.operators.sam import fetch_sequences

#: Rules for the ids of assemblies, tried in order; fixed values.
ID_RULES = {"alt": "_alt", "hap": "_hap", "fix": "_fix", "unlocalized": "_random", "unplaced": "Un_"}


def parse_attributes(gtf: DataFrame, column: str = "attributes") -> DataFrame:
    """Replaces the packed attributes by gene_id, gene_name, transcript_id_full and transcript_id.

    What is missing is an empty string; transcript_id is cut at its first dot.
    Columns of these names that were there are replaced.
    """
    e = F.col("__entries")
    full = attribute(e, "transcript_id")
    added = {
        "gene_id": attribute(e, "gene_id"),
        "gene_name": attribute(e, "gene_name"),
        "transcript_id_full": full,
        "transcript_id": F.substring_index(full, ".", 1),
    }
    return gtf.withColumn("__entries", attribute_entries(column)).withColumns(added).drop("__entries", column)


def parse_packed_attributes(gtf: DataFrame, column: str = "attributes", transcript_keys: Sequence[str] = ("transcript_id",)) -> DataFrame:
    """As parse_attributes(), for fields in any dialect that parse_field() reads.

    The transcript is the value of the first of ``transcript_keys`` that has one.
    """
    added = ("gene_id", "gene_name", "transcript_id_full", "transcript_id")
    kept = [c for c in gtf.columns if c not in (column, *added)]
    schema = T.StructType([*(gtf.schema[c] for c in kept), *(T.StructField(c, T.StringType()) for c in added)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            genes, names, full = [], [], []
            for text in batch.column(len(kept)).to_pylist():
                found = {key: value for key, value, _ in parse_field(text)}
                genes.append(found.get("gene_id", ""))
                names.append(found.get("gene_name", ""))
                full.append(next(filter(None, map(found.get, transcript_keys)), ""))
            values = [pa.array(v, pa.string()) for v in (genes, names, full, [t.partition(".")[0] for t in full])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *values], names=[*kept, *added])

    return gtf.select(*kept, column).mapInArrow(parse, schema)


def matches(column: Column, include: str | None = None, exclude: str | None = None) -> Column:
    """Whether a pattern is found in a text and another isn't."""
    keep = F.lit(True)
    if include is not None:
        keep &= column.rlike(include)
    if exclude is not None:
        keep &= ~column.rlike(exclude)
    return keep


def filter_ids(sequences: DataFrame, include: str | None = None, exclude: str | None = None, id_col: str = "seq_id") -> DataFrame:
    """Sequences whose id holds ``include`` and not ``exclude``, both regular expressions; null ids never pass."""
    return sequences.where(F.col(id_col).isNotNull() & matches(F.col(id_col), include, exclude))


def filter_annotation(
    gtf: DataFrame,
    seqids: Sequence[str] | None = None,
    feature: str | None = "exon",
    include: str | None = None,
    exclude: str | None = None,
) -> DataFrame:
    """Rows on some sequences, of some type, whose sequence id holds ``include`` and not ``exclude``."""
    out = gtf
    if seqids is not None:
        out = out.where(F.col("seqid").isin(list(seqids)))
    if feature is not None:
        out = out.where(F.col("type") == feature)
    return out.where(matches(F.col("seqid"), include, exclude))


def classify_ids(column: Column | str, rules: Mapping[str, str] | None = None, default: str = "canonical") -> Column:
    """The first rule whose pattern is found in an id, else the default; null for null."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for name, pattern in (ID_RULES if rules is None else rules).items():
        re.compile(pattern)
        out = out.when(c.rlike(pattern), name)
    return out.otherwise(default)


def select_features(gtf: DataFrame, transcript_id: str | None = None, gene_id: str | None = None) -> DataFrame:
    """The exons of a transcript or else of a gene; an error if neither is named or none is found."""
    if transcript_id is None and gene_id is None:
        raise InvalidInputError("name a transcript or a gene")
    rows = gtf.where(F.col("type") == "exon") if "type" in gtf.columns else gtf
    key, value = ("transcript_id", transcript_id) if transcript_id is not None else ("gene_id", gene_id)
    rows = rows.where(F.col(key) == value)
    if rows.isEmpty():
        raise InvalidInputError(f"no exons with {key} {value}")
    return rows


def shift_to_half_open(gtf: DataFrame) -> DataFrame:
    """1-based inclusive coordinates as 0-based half open ones.

    The operators below take coordinates as they are, as 0-based half open;
    without this shift a 1-based exon loses its first base.
    """
    return gtf.withColumn("start", F.col("start") - 1)


_EXON = ("seqid", "start", "end", "strand")


def exon_sequences(exons: DataFrame, genome: DataFrame) -> DataFrame:
    """(label, sequence) of every distinct exon with bounds on a known sequence."""
    distinct = exons.select(*_EXON).where("start IS NOT NULL AND end IS NOT NULL AND strand IS NOT NULL").distinct()
    found = fetch_sequences(distinct, genome, "seqid", "start", "end", "strand", "sequence")
    return found.select(interval_label("seqid", "start", "end", "strand").alias("label"), "sequence")


def introns(exons: DataFrame, by: str = "transcript_id") -> DataFrame:
    """(by, seqid, start, end, strand) of the gaps between an transcript's exons in order of start.

    Overlapping and touching exons have none between them; one exon gives nothing.
    """
    order = Window.partitionBy(by, "seqid", "strand").orderBy("start", "end")
    rows = exons.where("start IS NOT NULL AND end IS NOT NULL").select(by, *_EXON)
    gaps = rows.select(by, "seqid", F.col("end").alias("start"), F.lead("start").over(order).alias("end"), "strand")
    return gaps.where(F.col(by).isNotNull() & (F.col("start") < F.col("end")))


def intron_sequences(exons: DataFrame, genome: DataFrame, by: str = "transcript_id") -> DataFrame:
    """(label, sequence) of every distinct intron."""
    return exon_sequences(introns(exons, by), genome)


def spliced_sequences(exons: DataFrame, genome: DataFrame, by: str = "transcript_id") -> DataFrame:
    """(by, sequence): the exons of every transcript joined in its direction.

    Exons go by start; any strand but plus runs from the last to the first.
    """
    rows = exons.select(by, *_EXON).where(F.col(by).isNotNull() & F.expr("start IS NOT NULL AND end IS NOT NULL"))
    parts = fetch_sequences(rows, genome, "seqid", "start", "end", "strand", "part")
    place = F.when(F.col("strand") == "+", F.col("start")).otherwise(-F.col("start"))
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("at"), F.col("end").alias("end"), F.col("part").alias("part"))))
    return parts.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("sequence"))


def flatten_isoforms(exons: DataFrame, ordinal: str, score: str = "score", tile_bits: int = 16, salts: int = 32) -> DataFrame:
    """The stretches of every gene that the most exon records cover.

    Columns seqid, start, end, gene_id, score, strand, coverage.  Where no
    exons overlap, they come out as they are, with coverage 1.  Sequence id and
    score are those of the gene's first exon by ``ordinal``; the n-th stretch
    has the strand of the n-th exon.  Exons without bounds, empty ones
    (start not before end) and null genes are left out.

    Coverage is a running sum over the exons' ends, added up by position first.
    It runs within tiles of positions from what earlier tiles add up to, so a
    gene of any size is divided; exons are numbered only in genes of both
    strands, and there only those that may be among the first ones.
    """
    rows = exons.where("gene_id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL AND start < end")
    rows = rows.select("gene_id", "seqid", "start", "end", "strand", F.col(score).alias("score"), F.col(ordinal).alias("__ord"))
    first = rows.groupBy("gene_id").agg(
        F.min(F.struct("__ord", "seqid", "score", "strand")).alias("__first"),
        (F.min(F.coalesce("strand", F.lit(""))) != F.max(F.coalesce("strand", F.lit("")))).alias("__mixed"),
    )
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))
    steps = rows.select("gene_id", F.explode(ends).alias("x"))
    steps = steps.groupBy("gene_id", F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d")).where("d <> 0")
    steps = steps.withColumn("__t", F.shiftright("at", tile_bits))
    # A row a tile: what comes before it, and where the next one begins.
    gene = Window.partitionBy("gene_id").orderBy("__t")
    tiles = steps.groupBy("gene_id", "__t").agg(F.sum("d").alias("__d"), F.min("at").alias("__at")).select(
        "gene_id",
        "__t",
        F.coalesce(F.sum("__d").over(gene.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"),
        F.lead("__at").over(gene).alias("__after"),
    )
    w = Window.partitionBy("gene_id", "__t").orderBy("at")
    levels = steps.join(tiles, ["gene_id", "__t"]).select(
        "gene_id",
        "at",
        (F.col("__base") + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("cov"),
        F.coalesce(F.lead("at").over(w), F.col("__after")).alias("next"),
    )
    most = levels.groupBy("gene_id").agg(F.max("cov").alias("top"))
    top = levels.join(most.where("top > 1"), "gene_id").where("cov = top AND next IS NOT NULL")
    top = top.select("gene_id", F.col("at").alias("start"), F.col("next").alias("end"), F.col("top").cast("int").alias("coverage"))
    # Steps of no change are gone, so stretches at the top never touch.
    numbered = top.join(first, "gene_id").withColumn("__n", F.row_number().over(Window.partitionBy("gene_id").orderBy("start")))
    # The n-th exon of a gene is among the first n of its share.
    needed = numbered.where("__mixed").groupBy("gene_id").agg(F.max("__n").alias("__most"))
    share = Window.partitionBy("gene_id", "__share").orderBy("__ord")
    some = rows.join(needed, "gene_id").withColumn("__share", F.pmod(F.xxhash64("__ord"), F.lit(salts)))
    some = some.withColumn("__r", F.row_number().over(share)).where("__r <= __most")
    nth = some.withColumn("__n", F.row_number().over(Window.partitionBy("gene_id").orderBy("__ord"))).where("__n <= __most")
    nth = nth.select("gene_id", "__n", F.col("strand").alias("__strand"))
    shared = numbered.join(nth, ["gene_id", "__n"], "left").select(
        "__first.seqid", "start", "end", "gene_id", "__first.score", F.coalesce("__strand", "__first.strand").alias("strand"), "coverage"
    )
    alone = (
        rows.join(most.where("top = 1").select("gene_id"), "gene_id")
        .join(first, "gene_id")
        .select("__first.seqid", "start", "end", "gene_id", "__first.score", "strand", F.lit(1).alias("coverage"))
    )
    return shared.unionByName(alone)


def flattened_sequences(flat: DataFrame, genome: DataFrame, gene_id: str | None = None) -> DataFrame:
    """(label, sequence) of flattened stretches, of one gene or all; an unknown gene gives nothing."""
    return exon_sequences(flat if gene_id is None else flat.where(F.col("gene_id") == gene_id), genome)
