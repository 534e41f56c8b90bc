import itertools
import math
import random

import numpy as np
import pytest

from hybrispark.functions import binding, thermo


def dna(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def turn(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_perfect_duplex_is_the_closed_form(spark):
    seqs = [dna(n, n) for n in (8, 20, 37)]
    df = spark.createDataFrame([(s, turn(s)) for s in seqs], "a string, b string")
    both = df.select(
        thermo.free_energy(df.a, thermo.Conditions(pct_formamide=0), 37.0).alias("g"), thermo.duplex_probability("a", temperature=60.0).alias("p"), binding.duplex_probability_of("a", "b", temperature=60.0).alias("q")
    ).collect()
    energy = binding.pair_energies(seqs, [turn(s) for s in seqs], 37.0)
    assert np.allclose(energy, [r.g for r in both]) and all(math.isclose(r.p, r.q, rel_tol=1e-6) for r in both)


def test_mismatches_and_registers():
    a = dna(30, 3)
    b = turn(a)
    wrong = b[:14] + {"A": "C", "C": "A", "G": "T", "T": "G"}[b[14]] + b[15:]
    perfect, one, shifted, none = binding.pair_energies([a, a, a, "AAAA"], [b, wrong, "GG" + b[5:], "AAAA"], 37.0)
    assert perfect < one < 0 and perfect < shifted < 0 and none == 0
    assert binding.pair_energies(["", "ACGN"], ["A", "NCGT"], 37.0)[0] == 0


def test_scalars():
    a, t = dna(25, 4), turn(dna(25, 4))
    assert 0.1 < binding.pdup(a, conc_a=1e-6, conc_b=1e-6) <= 1 and 0 <= binding.pdup(a, t) <= 1
    one, two = binding.competitive_pdup(a, a[:12], t, temperature=55.0)
    assert 0 <= two < one <= 1 and one + two <= 1 + 1e-9
    half = binding.competitive_pdup(a, a, t, temperature=37.0)
    assert half[0] == pytest.approx(half[1]) and sum(half) == pytest.approx(1, abs=1e-3)
    for bad in (lambda: binding.pdup(""), lambda: binding.pdup(a, ""), lambda: binding.competitive_pdup(a, "", t), lambda: binding.competitive_pdup("", a, t), lambda: binding.competitive_pdup(a, a, "")):
        with pytest.raises(ValueError, match="non-empty"):
            bad()


def weights(s, temperature):
    """The sum of all foldings' weights, by listing the sets of pairs."""
    rt = thermo.GAS_CONSTANT / 1000 * (thermo.KELVIN + temperature)
    pair, end = binding._stacks(temperature, binding._PLAIN)
    warm = (thermo.KELVIN + temperature) / 310.15
    x = ["ACGT".index(c) for c in s]
    possible = [(i, j) for i in range(len(s)) for j in range(i + 4, len(s)) if x[i] + x[j] == 3]
    total = 0.0
    for k in range(len(possible) + 1):
        for chosen in itertools.combinations(possible, k):
            used = [i for p in chosen for i in p]
            if len(set(used)) < len(used) or any(a < c < b < d for (a, b), (c, d) in itertools.permutations(chosen, 2)):
                continue
            g, fine = 0.0, True
            for i, j in chosen:
                inside = [p for p in chosen if i < p[0] and p[1] < j]
                top = [p for p in inside if not any(q[0] < p[0] and p[1] < q[1] for q in inside)]
                if len(top) > 1:
                    fine = False
                    break
                if not any(p[0] < i and j < p[1] for p in chosen):
                    g += end[x[i]]
                if not top:
                    g += warm * binding.HAIRPIN[j - i - 1] + end[x[i]]
                    continue
                left, right = top[0][0] - i - 1, j - top[0][1] - 1
                if left + right > 6:
                    fine = False
                    break
                if left == right == 0:
                    g += pair[5 * x[i] + x[i + 1]]
                elif not left or not right:
                    g += warm * binding.BULGE[left + right] + (pair[5 * x[i] + x[top[0][0]]] if left + right == 1 else 0)
                else:
                    g += warm * binding.INTERIOR[left + right]
            total += math.exp(-g / rt) if fine else 0
    return total


def test_foldings_against_all_sets_of_pairs():
    for seed in range(6):
        s = dna(11, seed)
        assert binding.unpaired([s], 20.0)[0] == pytest.approx(1 / weights(s, 20.0))


def test_unpaired_column(spark):
    hairpin = "GCGCGCAAAAGCGCGC"
    df = spark.createDataFrame([(hairpin,), ("AAAAAAAAAAAAAAAA",), ("ACGN",), ("",), (None,)], "s string")
    got = [r.p for r in df.select(binding.unpaired_probability("s").alias("p")).collect()]
    assert got[0] < 0.01 and got[1] == 1.0 and got[2:] == [None, None, None]
    three = spark.createDataFrame([("ACGTACGTAC", "ACGTACGTAC", "GTACGTACGT"), (None, "A", "T")], "a string, b string, t string")
    both = [r.x for r in three.select(binding.competitive_probability_of("a", "b", "t").alias("x")).collect()]
    assert both[0].a_target == pytest.approx(both[0].b_target) and both[1].a_target is None
