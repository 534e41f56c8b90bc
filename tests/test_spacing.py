"""Greedy selection in parts against one scan."""

import random

import pytest

from hybrispark.operators.spacing import select_spaced


def scan(data, gap):
    out = []
    for key in {r[0] for r in data}:
        last = -1
        for r in sorted((r for r in data if r[0] == key), key=lambda r: r[1:]):
            if r[1] >= last + gap:
                out.append(r)
                last = r[2]
    return out


@pytest.mark.parametrize("part", [7, 64, 1 << 17])
@pytest.mark.parametrize("gap", [0, 1, 10])
def test_parts(spark, part, gap):
    rng = random.Random(part + gap)
    data = [("even", i, i + 30) for i in range(2_000)]
    data += [(k, a, a + rng.randrange(1, 60)) for k in ("a", "b", None, "") for a in rng.sample(range(3_000), 600)]
    data += [("ties", a, a + n) for a in range(0, 500, 3) for n in (5, 3, 3, 9)]
    data += [("far", 10, 900), ("far", 20, 25), ("far", 899, 905), ("far", 911, 915)]
    df = spark.createDataFrame(data, "k string, a int, b int").repartition(5)
    got = [tuple(r) for r in select_spaced(df, "k", "a", "b", gap, part=part).collect()]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2]))
    assert order(got) == order(scan(data, gap))


def test_nothing(spark):
    assert select_spaced(spark.createDataFrame([], "k string, a int, b int"), "k", "a", "b").count() == 0
