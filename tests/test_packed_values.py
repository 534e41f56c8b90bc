import pytest
from hypothesis import given
from hypothesis import strategies as st

from hybrispark.operators.packed_values import parse_field, split_packed_values


def plain(field):
    return [(k, v) for k, v, _ in parse_field(field)]


@pytest.mark.parametrize(
    "field, expected",
    [
        (None, []), ("", []), ("  ", []), (".", []), (";", []), (" ;; | ", []), ('"."', []),
        ('gene_id "G;1"; n 2;;', [("gene_id", "G;1"), ("n", "2")]),
        ("a=1,2 ,3;b", [("a", "1"), ("a", "2"), ("a", "3"), ("b", "")]),
        ("a = 1 | b 2\tc=3;\nd = \"x, y\"", [("a", "1"), ("b", "2"), ("c", "3"), ("d", "x, y")]),
        ("remark=；b=1", [("remark", ""), ("b", "1")]),
        ('note "so ""called"" x"; r ""', [("note", 'so "called" x'), ("r", "")]),
        ('tag "never closed; b 1', [("tag", "never closed; b 1")]),
        ('note "so called ""transport subunit""; partial', [("note", 'so called "transport subunit"; partial')]),
        ('"note ""so called """"x""""; partial"', [("note", 'so called "x"; partial')]),
        ("n 'near 5' end; x'; y '2'", [("n", "near 5' end; x"), ("y", "2")]),
        ('"a ""1""; note ""say """"hi""""; so"";"', [("a", "1"), ("note", 'say "hi"; so')]),
        ("tag putative actin cap\ttag b", [("tag", "putative actin cap"), ("tag", "b")]),
    ],
)
def test_fields(field, expected):
    assert plain(field) == expected


def test_errors_and_brackets():
    assert parse_field('a "b" c; d "e')[0] == ("a", "b c", "text_after_quote")
    assert parse_field('a "b" c; d "e')[1] == ("d", "e", "open_quote")
    assert parse_field('a "b ""c""; d 1') == [("a", 'b "c"; d 1', "open_quote")]
    assert parse_field("-x; a 1") == [("", "-x", "no_key"), ("a", "1", None)]
    assert parse_field("x=[1,2]", brackets=True) == [("x", "[1,2]", None)]
    assert plain("x=[1,2]") == [("x", "[1"), ("x", "2]")]


@given(st.text(alphabet="ab1 =;,|\t\n\"'[].；", max_size=60))
def test_never_fails(field):
    for key, value, _ in parse_field(field):
        assert key is not None and value is not None


@given(st.lists(st.tuples(st.from_regex(r"[a-z_]{1,8}", fullmatch=True), st.text(alphabet='abc;,|" =', max_size=10)), max_size=8))
def test_quoted_round_trip(entries):
    field = "; ".join(k + ' "' + v.replace('"', '""') + '"' for k, v in entries)
    assert plain(field) == entries


def test_operator(spark, rows):
    data = [(1, "a 1;b 2", 5), (1, "a 1;b 2", 6), (2, None, 1), (None, "c", 1), (3, ".", 1)]
    df = spark.createDataFrame(data, "rec_id long, attributes string, pos int")
    assert rows(split_packed_values(df)) == [(1, 1, "a", "1", None), (1, 2, "b", "2", None), (None, 1, "c", "", None)]
    assert rows(split_packed_values(df.limit(0))) == []


def test_long_field(spark):
    df = spark.createDataFrame([(1, ";".join(f"k{i} {'x' * 20}" for i in range(50_000)))], "rec_id long, attributes string")
    assert split_packed_values(df).count() == 50_000
