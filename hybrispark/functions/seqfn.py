"""Column functions on sequences, interval labels and annotation attributes.

All of them are built-in expressions: they stay in generated code, fold when
their arguments are literals and give null for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of the pairs of bases in the feature table of duplex stability, a fixed value.
DINUCLEOTIDES = ("AA", "AT", "AG", "AC", "TA", "TT", "TG", "TC", "GA", "GT", "GG", "GC", "CA", "CT", "CG", "CC")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_sequence(seq: Column | str) -> Column:
    """A sequence in upper case without white space (Unicode's, as in \\s with the letters of \\p{Z})."""
    return F.upper(F.regexp_replace(_c(seq), r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]", ""))


def rev_comp(seq: Column | str) -> Column:
    """Reverse complement; the case is kept, other letters stay as they are."""
    return F.reverse(F.translate(_c(seq), "ACGTacgt", "TGCAtgca"))


def count_base(seq: Column, bases: str) -> Column:
    upper = F.upper(seq)
    return F.length(upper) - F.length(F.translate(upper, bases, ""))


def gc_content(seq: Column | str, as_percent: bool = False) -> Column:
    """Share of G and C among all letters, whatever their case; 0 for an empty sequence."""
    s = _c(seq)
    share = F.when(F.length(s) == 0, F.lit(0.0)).otherwise(count_base(s, "GC") / F.length(s))
    return share * 100 if as_percent else share


def clamp(x: Column | str, low: Column | float, high: Column | float) -> Column:
    """A number kept within bounds; null and NaN stay what they are."""
    x = _c(x)
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    return F.when(x < low, low).when(F.isnan(x.cast("double")), x).when(x > high, high).otherwise(x)


def kmers(seq: Column | str, k: int) -> Column:
    """All overlapping k-letter words, an empty array for a shorter sequence."""
    s = _c(seq)
    starts = F.sequence(F.lit(1), F.length(s) - (k - 1))
    words = F.transform(starts, lambda i: F.substr(s, i, F.lit(k)))
    return F.when(F.length(s) >= k, words).when(s.isNotNull(), F.array().cast("array<string>"))


def count_words(seq: Column | str, word: str) -> Column:
    """Occurrences of a word from left to right that don't overlap; letters count in their case."""
    s = _c(seq)
    return ((F.length(s) - F.length(F.replace(s, F.lit(word), F.lit("")))) / len(word)).cast("int")


def base_code(base: Column | str) -> Column:
    """0 to 3 for A, C, G, T in either case, 4 for anything else."""
    u = F.upper(_c(base))
    return F.when(u == "A", 0).when(u == "C", 1).when(u == "G", 2).when(u == "T", 3).otherwise(4)


def probe_id(seq_id: Column | str, start: Column | str, stop: Column | str) -> Column:
    """``seq_id:start-stop``, the key of a probe."""
    return F.format_string("%s:%d-%d", _c(seq_id), _c(start), _c(stop))


def interval_label(seqid: Column | str, start: Column | str, end: Column | str, strand: Column | str) -> Column:
    """``seqid:start-end(strand)``, a key that parse_label() takes apart again."""
    return F.format_string("%s:%d-%d(%s)", _c(seqid), _c(start), _c(end), _c(strand))


def parse_label(label: Column | str) -> Column:
    """Struct (seqid, start, end, strand) of an interval label; the id may hold colons itself."""
    text, pattern = _c(label), r"^(.*):(\d+)-(\d+)\((.)\)$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    fields = F.struct(
        part(1).alias("seqid"), part(2).cast("int").alias("start"), part(3).cast("int").alias("end"), part(4).alias("strand")
    )
    return F.when(text.rlike(pattern), fields)


def local_to_genomic(label: Column | str, start: Column | str, stop: Column | str) -> Column:
    """Struct (seqid, start, end, strand): a place within a labelled interval in genome coordinates.

    On the minus strand the interval runs backwards.
    """
    at, a, b = parse_label(label), _c(start), _c(stop)
    plus = at["strand"] != "-"
    return F.struct(
        at["seqid"].alias("seqid"),
        F.when(plus, at["start"] + a).otherwise(at["end"] - b).alias("start"),
        F.when(plus, at["start"] + b).otherwise(at["end"] - a).alias("end"),
        at["strand"].alias("strand"),
    )


def slice_strand(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """Letters ``start`` to ``end`` (0-based, half open) in upper case, reverse complemented on the minus strand."""
    part = F.upper(F.substr(seq, F.greatest(start, F.lit(0)) + 1, F.greatest(end - F.greatest(start, F.lit(0)), F.lit(0))))
    return F.when(strand == "-", rev_comp(part)).otherwise(part)


def set_positions(barcode: Column | str) -> Column:
    """1-based places of the ones of a barcode of zeros and ones."""
    places = F.transform(F.split(_c(barcode), ""), lambda c, i: F.when(c == "1", i + 1))
    return F.filter(places, lambda x: x.isNotNull())


def attribute_entries(attributes: Column | str) -> Column:
    """Attributes of an annotation line as (key, value) entries, read as the two usual dialects write them.

    Fields are separated by semicolons; a field with an equals sign is split
    there, any other at its first blank; double quotes are dropped.  The last
    of several values of a key counts.
    """
    fields = F.filter(
        F.transform(F.split(F.coalesce(_c(attributes), F.lit("")), ";"), lambda f: F.trim(F.replace(f, F.lit('"'), F.lit("")))),
        lambda f: f != "",
    )

    def entry(f: Column) -> Column:
        at = F.when(F.contains(f, F.lit("=")), F.locate("=", f)).otherwise(F.locate(" ", f))
        key = F.when(at > 0, F.substr(f, F.lit(1), at - 1)).otherwise(f)
        value = F.when(at > 0, F.substr(f, at + 1)).otherwise(F.lit(""))
        return F.struct(F.trim(key).alias("key"), F.trim(value).alias("value"))

    return F.transform(fields, entry)


def attribute(entries: Column, key: str) -> Column:
    """The last value of a key among attribute_entries() entries, an empty string if there is none."""
    found = F.filter(entries, lambda e: e["key"] == key)
    return F.when(F.size(found) > 0, F.element_at(found, -1)["value"]).otherwise(F.lit(""))
