"""Probes of a genome aligned to it, against the search of all of them."""

import random

import pytest

from hybrispark import queries
from hybrispark.operators.alignment import align
from hybrispark.operators.mining import config, mine
from hybrispark.operators.own_places import align_mined

LOOSE = {"min_tm": 20, "max_tm": 70, "max_homopolymer": None, "min_gc": 0, "max_gc": 100}


def dna(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def turn(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def texts():
    """Sequences with copies, turned copies, near copies, tandem repeats, palindromes and unknown letters."""
    a, half = dna(700, 1), dna(30, 2)
    near = "".join(x if i % 23 else "ACGT"["ACGT".index(x) - 1] for i, x in enumerate(a[300:400]))
    return {
        "a": a,
        "b": dna(90, 3) + a[100:180] + dna(60, 4) + turn(a[200:290]) + dna(40, 5) + near,
        "c": half + turn(half) + dna(50, 6) + "ACG" * 20 + dna(45, 7) + "AC" * 25 + "T" * 45 + dna(11, 8) + dna(45, 9) * 3,
        "d": dna(120, 10) + "N" + dna(60, 11) + "N" * 30 + a[500:560] + "NN" + dna(70, 12),
        "e": a[640:] + dna(20, 13) + a[:50],
        "f": dna(36, 14),
    }


CHANGES = {
    "none": None,
    "mismatch": queries._complemented,
    "gap": lambda s: s[:24] + s[25:],
    "insertion": lambda s: s[:26] + "GA" + s[26:],
    "end": lambda s: s[:26] + s[: len(s) - 26][::-1].translate(str.maketrans("ACGT", "TGCA")),
}


@pytest.mark.parametrize("piece", [100, 65_536])
@pytest.mark.parametrize(
    "change, preset, k, band, lengths",
    [("none", "very-sensitive", None, 0, (30, 37)), ("mismatch", "very-sensitive-local", 3, 0, (30, 37)), ("gap", "very-sensitive-local", 2, 2, (38, 42)), ("insertion", "very-sensitive-local", None, 3, (34, 36)), ("end", "very-sensitive-local", 100, 0, (30, 33))],
)
def test_as_the_search(spark, rows, piece, change, preset, k, band, lengths):
    made = CHANGES[change]
    genome = spark.createDataFrame(list(texts().items()), "seq_id string, seq string").repartition(3)
    cfg = config(min_length=lengths[0], max_length=lengths[1], **LOOSE)
    mined = [r.probe_seq for r in mine(genome, cfg=cfg).collect()]
    assert len(mined) > 1_000
    given = [mined[3], turn(mined[40]), dna(35, 20), mined[9][:25], mined[50][:29] + "N" + mined[50][30:], "", "ACGT", None, mined[0].lower(), *([made(mined[7])] if made else [])]
    given = spark.createDataFrame([(g,) for g in given], "probe_seq string")
    asked = spark.createDataFrame([(made(m) if made else m,) for m in mined], "probe_seq string").unionByName(given)
    expected = rows(align(asked, genome, preset=preset, k=k, longest=45, band=band))
    assert rows(align_mined(genome, cfg, given, preset, k, 45, band, made, piece)) == expected
    assert len(expected) > len(mined) / 2


def test_what_stands_alone_is_not_searched(spark, rows, monkeypatch):
    """Only probes with a seed at two places, or given ones found in the genome, are searched."""
    from hybrispark.operators import own_places

    searched = []
    monkeypatch.setattr(own_places, "align", lambda asked, *args, **settings: searched.extend(rows(asked)) or align(asked, *args, **settings))
    text = dna(5_000, 30)
    genome = spark.createDataFrame([("a", text), ("b", dna(300, 31) + text[1_000:1_060] + dna(300, 32))], "seq_id string, seq string")
    given = spark.createDataFrame([(dna(35, 33),), (text[3_000:3_035],)], "probe_seq string")
    for name, change in CHANGES.items():
        searched.clear()
        longest = 40 if change else 37
        found = align_mined(genome, config(**LOOSE), given, k=2, longest=longest, change=change)
        assert found.count() > (4_500 if name in ("none", "mismatch") else 0)
        assert 0 < len(searched) < 500 and (dna(35, 33),) not in searched and (text[3_000:3_035],) in searched


def test_words_in_common_are_no_seeds(spark, rows, monkeypatch):
    """Stretches in common that are shorter than a seed, though longer than its words, send no probe to the search."""
    from hybrispark.operators import own_places

    searched = []
    monkeypatch.setattr(own_places, "align", lambda asked, *args, **settings: searched.extend(rows(asked)) or align(asked, *args, **settings))
    text = dna(5_000, 40)
    unlike = lambda a: text[a].translate(str.maketrans("ACGT", "CGTA"))
    other = "".join(unlike(a - 1) + text[a : a + 18] + unlike(a + 18) + dna(20, 41 + a) for a in range(60, 4_800, 60))
    genome = spark.createDataFrame([("a", text), ("b", other)], "seq_id string, seq string")
    assert align_mined(genome, config(**LOOSE), None, k=2, longest=37).count() > 4_500
    assert not searched


def test_numbers_are_packed():
    import numpy as np

    from hybrispark.operators import own_places

    for n in (0, 1, 5, 70_000):
        number = np.sort(np.random.default_rng(n).integers(0, 1 << 28, n))
        blob = own_places._packed(number)
        assert own_places._unpacked(blob).tolist() == number.tolist() and len(blob) < 2.2 * n + 520
