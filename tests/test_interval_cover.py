import random

import numpy as np
import pytest

from hybrispark.operators.interval_cover import cover_and_gaps, dyadic_blocks, merge_blocks


def brute(intervals):
    covered = sorted({x for a, b in intervals for x in range(a, b + 1)})
    out, start, last = [], None, None
    for x in covered:
        if start is None:
            start = x
        elif x != last + 1:
            out += [("span", start, last), ("gap", last + 1, x - 1)]
            start = x
        last = x
    return out + ([("span", start, last)] if start is not None else [])


def test_blocks_cover_exactly():
    rng = random.Random(1)
    for _ in range(200):
        a, n = rng.randrange(5000), rng.randrange(1, 900)
        _, level, index = dyadic_blocks(np.zeros(1, np.int64), np.array([a]), np.array([a + n]))
        cover = [x for lv, i in zip(level, index) for x in range(i << lv, (i + 1) << lv)]
        assert sorted(cover) == list(range(a, a + n)) and len(level) <= 2 * n.bit_length()


def test_merge_of_overlapping_groups():
    rng = random.Random(2)
    group, lo, hi, by = [], [], [], {}
    for _ in range(400):
        g, a, n = rng.randrange(5), rng.randrange(2000), rng.randrange(1, 60)
        group.append(g), lo.append(a), hi.append(a + n)
        by.setdefault(g, []).append((a, a + n - 1))
    got = merge_blocks(*dyadic_blocks(*(np.array(x, np.int64) for x in (group, lo, hi))))
    expected = [(g, s, e + 1) for g in sorted(by) for k, s, e in brute(by[g]) if k == "span"]
    assert list(zip(*(x.tolist() for x in got))) == expected


@pytest.mark.parametrize("tile_bits, run", [(4, 7), (14, 250_000)])
def test_operator_against_brute_force(spark, rows, tile_bits, run):
    rng = random.Random(3)
    data, by = [], {}
    for _ in range(600):
        g, a, n = rng.choice("xxxyz"), rng.randrange(-50, 3000), rng.randrange(0, 40)
        data.append((g, a, a + n, "other"))
        by.setdefault(g, []).append((a, a + n))
    df = spark.createDataFrame(data + data[:50], "gene string, start int, end int, kind string").repartition(5)
    got = rows(cover_and_gaps(df, ["gene"], "start", "end", tile_bits, run))
    assert got == sorted((g, *r) for g in by for r in brute(by[g]))


def test_edges(spark, rows):
    data = [("a", 1, 1), ("a", 2, 3), ("a", 6, 5), ("a", None, 4), ("a", 9, None), (None, 1, 2), ("b", 1, 2**31 - 1), ("b", -(2**31), 0), ("c", 5, 5), ("c", 5, 5)]
    df = spark.createDataFrame(data, "g string, s int, e int")
    assert rows(cover_and_gaps(df, ["g"], "s", "e")) == [("a", "span", 1, 3), ("b", "span", -(2**31), 2**31 - 1), ("c", "span", 5, 5)]
    assert rows(cover_and_gaps(df.limit(0), ["g"], "s", "e")) == []


def test_hot_entity_over_many_tiles(spark, rows):
    """Stretches that begin, end and go on in other tiles, in every order of runs."""
    rng = random.Random(11)
    for seed in range(4):
        data = [("hot", a, a + n) for a, n in ((rng.randrange(20_000), rng.choice([0, 1, 3, 15, 16, 17, 40, 500])) for _ in range(400))]
        data += [("one", 100, 9_000), ("two", 16, 31), ("two", 32, 47), ("two", 49, 63)]
        df = spark.createDataFrame(data, "g string, s int, e int").repartition(3 + seed)
        by = {}
        for g, a, b in data:
            by.setdefault(g, []).append((a, b))
        assert rows(cover_and_gaps(df, ["g"], "s", "e", 4, 13)) == sorted((g, *r) for g in by for r in brute(by[g]))
