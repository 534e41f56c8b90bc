"""Alignments: SAM text to intervals, clamping to sequence ends, fetching bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybrispark.functions.seqfn import rev_comp
from hybrispark.operators.mining import chunks


def cigar_length(cigar: Column) -> Column:
    """Sum of the numbers of all operations, clips, insertions and deletions included."""
    numbers = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHPX=]"), F.lit(1))
    return F.aggregate(numbers, F.lit(0), lambda acc, x: acc + x.cast("int"))


def sam_to_bed(lines: DataFrame, col: str = "value") -> DataFrame:
    """Intervals of SAM lines: align_seqid, align_start, align_stop, seqid, align_score, align_strand, align_cigar.

    Header lines and reads without a reference are left out.  A leading soft
    clip moves the start back; start and stop are 0-based and not negative;
    the score is the first ``AS`` tag, null without one.  Null and short lines
    give nothing.
    """
    f = F.split(F.col(col), "\t")
    rows = lines.select(f.alias("f")).where(~F.col("f")[0].startswith("@")).where(F.size("f") >= 6)
    rows = rows.where(F.col("f")[2] != "*")
    clip = F.coalesce(F.expr(r"try_cast(regexp_extract(f[5], '^(\\d+)S', 1) AS INT)"), F.lit(0))
    start = F.col("f")[3].cast("int") - clip
    tags = F.filter(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda t: t.startswith("AS:"))
    score = F.expr("try_cast(split(__tag, ':')[2] AS INT)")
    return (
        rows.withColumn("__tag", F.get(tags, F.lit(0)))
        .select(
            F.col("f")[2].alias("align_seqid"),
            F.greatest(start - 1, F.lit(0)).alias("align_start"),
            F.greatest(start + cigar_length(F.col("f")[5]) - 1, F.lit(0)).alias("align_stop"),
            F.col("f")[0].alias("seqid"),
            score.alias("align_score"),
            F.when(F.col("f")[1].cast("int").bitwiseAND(16) != 0, "-").otherwise("+").alias("align_strand"),
            F.col("f")[5].alias("align_cigar"),
        )
    )


def bed_text(bed: DataFrame) -> DataFrame:
    """One tab-separated line an alignment; NA for a missing score."""
    return bed.select(
        F.concat_ws(
            "\t",
            "align_seqid",
            F.col("align_start").cast("string"),
            F.col("align_stop").cast("string"),
            "seqid",
            F.coalesce(F.col("align_score").cast("string"), F.lit("NA")),
            "align_strand",
            "align_cigar",
        ).alias("value")
    )


def trim_to_ends(bed: DataFrame, sizes: DataFrame, seqid: str = "align_seqid", start: str = "align_start", stop: str = "align_stop") -> DataFrame:
    """Intervals clipped to 0 .. size; those on unknown sequences are left out.

    ``sizes`` is (seq_id, size), one row a sequence.
    """
    known = sizes.select(F.col("seq_id").alias("__id"), F.col("size").alias("__size"))
    clip = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("__size"))).cast("int")
    joined = bed.join(known, bed[seqid] == F.col("__id"))
    return joined.withColumns({start: clip(start), stop: clip(stop)}).drop("__id", "__size")


def fetch_sequences(
    bed: DataFrame,
    genome: DataFrame,
    seqid: str = "align_seqid",
    start: str = "align_start",
    stop: str = "align_stop",
    strand: str = "align_strand",
    out: str = "derived_seq",
    block: int = 65_536,
    keep_case: bool = False,
) -> DataFrame:
    """The intervals with their bases in upper case, reverse complemented on the minus strand.

    ``genome`` is (seq_id, seq).  Sequences are cut into blocks and intervals
    joined to the blocks they touch, so that no row carries a whole chromosome
    and a long sequence is spread over many tasks; an interval's parts are put
    together again in order.  Equal rows come out once.  Intervals on unknown
    sequences or wholly beyond the end are left out, parts beyond the ends are
    cut off; an empty interval gives an empty text.  ``keep_case`` leaves the
    case of the letters.
    """
    blocks = chunks(genome, "seq_id", "seq", block, 0, keep_case=keep_case).select(
        F.col("seq_id").alias("__id"), (F.col("offset") / block).cast("int").alias("__b"), F.col("total").alias("__n"), F.col("piece").alias("__part")
    )
    lo = F.greatest(F.col(start), F.lit(0))
    last = F.greatest(F.col(stop) - 1, lo)
    touched = (
        bed.distinct()
        .withColumn("__b", F.explode(F.sequence((lo / block).cast("int"), (last / block).cast("int"))))
        .withColumn("__key", F.col(seqid))
    )
    joined = touched.join(blocks, (F.col("__key") == F.col("__id")) & (touched["__b"] == blocks["__b"])).drop(blocks["__b"]).where(lo < F.col("__n"))
    from_ = F.greatest(lo - F.col("__b") * block, F.lit(0))
    to = F.least(F.col(stop) - F.col("__b") * block, F.lit(block))
    part = F.substr("__part", from_ + 1, F.greatest(to - from_, F.lit(0)))
    # Cut before the aggregate, whose sorted rows would hold whole blocks otherwise.
    cut_parts = joined.select(*bed.columns, "__b", part.alias("p"))
    parts = cut_parts.groupBy(*bed.columns).agg(F.array_sort(F.collect_list(F.struct("__b", "p"))).alias("__parts"))
    whole = F.array_join(F.transform("__parts", lambda x: x["p"]), "")
    return parts.select(*bed.columns, F.when(F.col(strand) == "-", rev_comp(whole)).otherwise(whole).alias(out))


def process_alignments(lines: DataFrame, genome: DataFrame | None = None, to_upper: bool = True, col: str = "value") -> DataFrame:
    """Alignments of SAM lines, with the genome's bases if it is given.

    Columns are those of sam_to_bed() and ``derived_seq``: the bases between
    the ends clipped to the sequence, while the coordinates stay unclipped;
    null on unknown sequences and beyond their ends.  Every alignment comes out
    as often as it is there.  Bases are in upper case; with ``to_upper=False``
    they are as the genome has them.
    """
    bed = sam_to_bed(lines, col)
    if genome is None:
        return bed
    place = ["align_seqid", "align_start", "align_stop", "align_strand"]
    found = fetch_sequences(bed.select(*place), genome, keep_case=not to_upper)
    return bed.join(found, place, "left").select(*bed.columns, "derived_seq")
