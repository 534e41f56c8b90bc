"""Nearest-neighbour thermodynamics of short duplexes as column expressions.

Enthalpies and entropies are kept as whole tenths, so that sums are exact in
any order and every engine divides the same numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The unified nearest-neighbour parameters of SantaLucia (1998),
# by pair of bases from 5' to 3', in tenths of kcal/mol and of cal/(mol K).
ENTHALPY = {
    "AA": -79, "AC": -84, "AG": -78, "AT": -72,
    "CA": -85, "CC": -80, "CG": -106, "CT": -78,
    "GA": -82, "GC": -98, "GG": -80, "GT": -84,
    "TA": -72, "TC": -82, "TG": -85, "TT": -79,
}
ENTROPY = {
    "AA": -222, "AC": -224, "AG": -210, "AT": -204,
    "CA": -227, "CC": -199, "CG": -272, "CT": -210,
    "GA": -222, "GC": -244, "GG": -199, "GT": -224,
    "TA": -213, "TC": -222, "TG": -227, "TT": -222,
}
#: Terms of a terminal base: enthalpy and entropy, in tenths.
TERMINAL = {"A": (23, 41), "T": (23, 41), "C": (1, -28), "G": (1, -28)}
GAS_CONSTANT = 1.987
KELVIN = 273.15
SALT_FACTOR = 0.368


@dataclass(frozen=True)
class Conditions:
    """Concentrations (mM; of the strands nM) and formamide of a hybridisation."""

    Na: float = 390
    K: float = 0
    Tris: float = 0
    Mg: float = 0
    dNTPs: float = 0
    dnac1: float = 25
    dnac2: float = 25
    pct_formamide: float = 50
    formamide_factor: float = 0.65

    @property
    def monovalent(self) -> float:
        """Sodium equivalents of all ions, mM."""
        mon = self.Na + self.K + self.Tris / 2
        if (self.K or self.Mg or self.Tris or self.dNTPs) and self.dNTPs < self.Mg:
            mon += 120 * math.sqrt(self.Mg - self.dNTPs)
        if not mon:
            raise ValueError("the total ion concentration must not be zero")
        return mon

    def salt_term(self, length: int) -> float:
        """Entropy correction for salt of a duplex of some length."""
        return SALT_FACTOR * (length - 1) * math.log(self.monovalent / 1000)

    @property
    def strand_term(self) -> float:
        return GAS_CONSTANT * math.log((self.dnac1 - self.dnac2 / 2) * 1e-9)

    @property
    def depression(self) -> float:
        return self.pct_formamide * self.formamide_factor


def formamide_correction(temp: Column | float, pct: float = 50, factor: float = 0.65):
    """A temperature lowered for formamide."""
    return temp - pct * factor


def pair_tables() -> tuple[np.ndarray, np.ndarray]:
    """Enthalpy and entropy by ``5 * code + code`` of two base codes, 0 for other letters."""
    dh, ds = np.zeros(25, np.int32), np.zeros(25, np.int32)
    for pair, h in ENTHALPY.items():
        at = 5 * "ACGT".index(pair[0]) + "ACGT".index(pair[1])
        dh[at], ds[at] = h, ENTROPY[pair]
    return dh, ds


def terminal_tables() -> tuple[np.ndarray, np.ndarray]:
    dh, ds = np.zeros(5, np.int32), np.zeros(5, np.int32)
    for base, (h, s) in TERMINAL.items():
        dh["ACGT".index(base)], ds["ACGT".index(base)] = h, s
    return dh, ds


def _lookup(word: Column, values: dict[str, int]) -> Column:
    out = None
    by_value: dict[int, list[str]] = {}
    for k, v in values.items():
        by_value.setdefault(v, []).append(k)
    for v, ks in by_value.items():
        cond = word.isin(ks)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(0)


def _sum_pairs(pairs: Column, values: dict[str, int]) -> Column:
    return F.aggregate(pairs, F.lit(0), lambda acc, p: acc + _lookup(p, values))


def duplex_energy(seq: Column) -> tuple[Column, Column]:
    """Enthalpy and entropy in tenths of a sequence in upper case with its complement, without salt."""
    starts = F.sequence(F.lit(1), F.length(seq) - 1)
    pairs = F.transform(starts, lambda i: F.substr(seq, i, F.lit(2)))
    total = []
    for values, end in ((ENTHALPY, 0), (ENTROPY, 1)):
        ends = {b: t[end] for b, t in TERMINAL.items()}
        total.append(_sum_pairs(pairs, values) + _lookup(F.substr(seq, F.lit(1), F.lit(1)), ends) + _lookup(F.substr(seq, F.length(seq), F.lit(1)), ends))
    return total[0], total[1]


def tm_from_energy(dh: Column, ds: Column, length: Column, conditions: Conditions) -> Column:
    """Melting temperature from energies in tenths."""
    salt = F.lit(SALT_FACTOR) * (length - 1) * F.lit(math.log(conditions.monovalent / 1000))
    return (dh / 10 * 1000) / (ds / 10 + salt + conditions.strand_term) - KELVIN - conditions.depression


def melting_temperature(seq: Column | str, conditions: Conditions = Conditions()) -> Column:
    """Tm of each sequence with its complement; null under two bases or with letters other than A, C, G, T."""
    s = F.upper(F.col(seq) if isinstance(seq, str) else seq)
    dh, ds = duplex_energy(s)
    return F.when(s.rlike("^[ACGT]{2,}$"), tm_from_energy(dh, ds, F.length(s), conditions))


def free_energy(seq: Column, conditions: Conditions, temperature: float) -> Column:
    """Free energy (kcal/mol) of a duplex at a temperature in Celsius."""
    dh, ds = duplex_energy(seq)
    salt = F.lit(SALT_FACTOR) * (F.length(seq) - 1) * F.lit(math.log(conditions.monovalent / 1000))
    return dh / 10 - (KELVIN + temperature) * (ds / 10 + salt) / 1000


#: Simulation temperature of the default model: 37 degrees lowered for 50 % formamide.
DEFAULT_TEMPERATURE = formamide_correction(37.0, 50, 0.65)


def duplex_probability(
    seq: Column | str,
    conc_a: float = 1e-6,
    conc_b: float = 1e-12,
    temperature: float = DEFAULT_TEMPERATURE,
    conditions: Conditions = Conditions(pct_formamide=0),
) -> Column:
    """Share of the scarcer strand bound to its perfect complement, in a two-state equilibrium.

    An approximation: hairpins and self-dimers don't count.  With totals A and
    B and the constant k of dissociation, the root of the mass balance is taken
    in the form that doesn't cancel.  Null for an empty or ambiguous sequence.
    """
    s = F.upper(F.col(seq) if isinstance(seq, str) else seq)
    rt = GAS_CONSTANT / 1000 * (KELVIN + temperature)
    k = F.exp(free_energy(s, conditions, temperature) / rt)
    x = conc_a + conc_b + k
    bound = F.lit(2 * conc_a * conc_b) / (x + F.sqrt(x * x - 4 * conc_a * conc_b))
    return F.when(s.rlike("^[ACGT]{2,}$"), F.least(bound / min(conc_a, conc_b), F.lit(1.0)))


def competitive_probability(
    probe: Column | str,
    mismatches: Column,
    conc_probe: float = 1e-12,
    conc_on: float = 1e-6,
    conc_off: float = 1e-6,
    temperature: float = DEFAULT_TEMPERATURE,
    penalty: float = 3.0,
    conditions: Conditions = Conditions(pct_formamide=0),
) -> Column:
    """Struct (on_target, off_target): shares of a scarce probe bound to either of two strands.

    The strands compete in a two-state equilibrium whose targets are in excess
    of the probe; each mismatch of the off-target costs ``penalty`` kcal/mol.
    """
    s = F.upper(F.col(probe) if isinstance(probe, str) else probe)
    rt = GAS_CONSTANT / 1000 * (KELVIN + temperature)
    g = free_energy(s, conditions, temperature)
    on = conc_on * F.exp(-g / rt)
    off = conc_off * F.exp(-(g + mismatches * penalty) / rt)
    total = 1 + on + off
    return F.when(
        s.rlike("^[ACGT]{2,}$"), F.struct((on / total).alias("on_target"), (off / total).alias("off_target"))
    )
