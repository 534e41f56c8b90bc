"""Several values packed in one field: split them into one row per value.

A field is parsed by a small parsing expression grammar whose alternatives are
tried in order, each failing alternative backtracking to the start of the value:

    field   <- csv_quoted(field) / entry (SEP+ entry)*
    entry   <- key join values?
    join    <- BLANK* '=' BLANK* / BLANK+
    values  <- value (',' value)*
    value   <- closed_quote &end / stray_quote / open_quote / bracketed / bare

``closed_quote`` must be followed by the end of its entry; ``stray_quote`` is a
closed quote followed by other text, ``open_quote`` runs to the end of the
field.  The last two raise an error flag beside the value they give.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters that separate entries; the full-width semicolon counts as well.
SEPARATORS = ";；|\t\n\r\x0b\x0c"

_SEP = f"[{re.escape(SEPARATORS)}]"
_END = rf"(?=[^\S\t\n\r\x0b\x0c]*(?:{_SEP}|,|\Z))"
_ENTRY_END = rf"(?=[^\S\t\n\r\x0b\x0c]*(?:{_SEP}|\Z))"
_BLANK = r"[^\S\t\n\r\x0b\x0c]"

_skip = re.compile(rf"[\s{re.escape(SEPARATORS)}]*").match
_key = re.compile(rf"(\w+)(?:{_BLANK}*={_BLANK}*|{_BLANK}+|(?={_SEP})|\Z)").match
#: What stands in double quotes; possessive, so that a doubled quote is never taken for a closing one.
_QUOTED = r'"((?:[^"]|"")*+)"'
_double = re.compile(_QUOTED + _END).match
_double_loose = re.compile(rf"{_QUOTED}([^{re.escape(SEPARATORS)}]*)").match
_whole = re.compile(r'"((?:[^"]|"")*+)').match
_single = re.compile(rf"'(.*?)'{_ENTRY_END}", re.S).match
_bracket = {
    "[": re.compile(rf"(\[[^\[\]]*\]){_END}").match,
    "{": re.compile(rf"(\{{[^{{}}]*\}}){_END}").match,
    "(": re.compile(rf"(\([^()]*\)){_END}").match,
}
_bare = re.compile(rf"[^{re.escape(SEPARATORS)}]*").match
_bare_item = re.compile(rf"[^,{re.escape(SEPARATORS)}]*").match
_comma = re.compile(rf"{_BLANK}*,{_BLANK}*").match
_bad_entry = re.compile(rf"[^{re.escape(SEPARATORS)}]+").match


def parse_field(field: str | None, brackets: bool = False) -> list[tuple[str, str, str | None]]:
    """The (key, value, error) triples of one field, from left to right.

    Null, blank and placeholder fields (a lone dot, only separators) give an
    empty list.  Errors: ``open_quote``, ``text_after_quote``, ``no_key``; null
    for a well-formed value.  ``brackets`` keeps ``[a,b]``, ``{a,b}`` and
    ``(a,b)`` together as one value.
    """
    if field is None:
        return []
    s = field.strip()
    if s[:1] == '"':
        # No entry begins with a quote, so the field as a whole is quoted.
        m = _whole(s)
        s = m.group(1).replace('""', '"').strip()
    if s == ".":
        return []
    out: list[tuple[str, str, str | None]] = []
    n, p = len(s), _skip(s).end()
    while p < n:
        m = _key(s, p)
        if m is None:
            m = _bad_entry(s, p)
            out.append(("", m.group().strip(), "no_key"))
            p = _skip(s, m.end()).end()
            continue
        key, p = m.group(1), m.end()
        c = s[p : p + 1]
        if c != '"' and c != "'" and not (brackets and c in _bracket):
            m = _bare(s, p)
            text = m.group()
            if "," not in text:
                out.append((key, text.strip(), None))
                p = _skip(s, m.end()).end()
                continue
        while True:
            value, error, p = _value(s, p, brackets)
            out.append((key, value, error))
            m = _comma(s, p)
            if m is None:
                break
            p = m.end()
        p = _skip(s, p).end()
    return out


def _value(s: str, p: int, brackets: bool) -> tuple[str, str | None, int]:
    c = s[p : p + 1]
    if c == '"':
        m = _double(s, p)
        if m:
            return m.group(1).replace('""', '"'), None, m.end()
        m = _double_loose(s, p)
        if m:
            return m.group(1).replace('""', '"') + m.group(2).rstrip(), "text_after_quote", m.end()
        return s[p + 1 :].replace('""', '"'), "open_quote", len(s)
    if c == "'":
        m = _single(s, p)
        if m:
            return m.group(1), None, m.end()
        return s[p + 1 :], "open_quote", len(s)
    if brackets and c in _bracket:
        m = _bracket[c](s, p)
        if m:
            return m.group(1), None, m.end()
    m = _bare_item(s, p)
    return m.group().strip(), None, m.end()


def split_packed_values(
    df: DataFrame,
    id_col: str = "rec_id",
    field_col: str = "attributes",
    brackets: bool = False,
    rows_per_batch: int = 100_000,
) -> DataFrame:
    """One row (id, pos, attr_key, attr_value, error) for each value in a field.

    Repeated deliveries of a record count once: equal (id, field) pairs are
    merged by a hash aggregate with a map-side part, which also keeps a hot id
    from gathering in one task.  A null id is kept as an id of its own; null,
    empty and placeholder fields give no rows; an empty table gives an empty
    result.  Other columns of ``df`` are neither read nor touched.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("pos", T.IntegerType()),
            T.StructField("attr_key", T.StringType()),
            T.StructField("attr_value", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column(1)
            take, pos, keys, values, errors = [], [], [], [], []

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(take, pa.int64())),
                        pa.array(pos, pa.int32()),
                        pa.array(keys, pa.string()),
                        pa.array(values, pa.string()),
                        pa.array(errors, pa.string()),
                    ],
                    names=[id_col, "pos", "attr_key", "attr_value", "error"],
                )

            for i, text in enumerate(fields.to_pylist()):
                found = parse_field(text, brackets)
                if not found:
                    continue
                k, v, e = zip(*found)
                keys.extend(k)
                values.extend(v)
                errors.extend(e)
                pos.extend(range(1, len(found) + 1))
                take.extend([i] * len(found))
                if len(take) >= rows_per_batch:
                    yield flush()
                    take, pos, keys, values, errors = [], [], [], [], []
            if take:
                yield flush()

    records = df.select(df[id_col], df[field_col]).where(df[field_col].isNotNull()).distinct()
    return records.mapInArrow(parse, schema)
