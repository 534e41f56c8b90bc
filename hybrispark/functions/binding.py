"""Binding of two and three strands and folding of one, for whole batches at once.

Energies are those of the nearest-neighbour model.  Two strands pair in one
register: helices between mismatches, each mismatch between them at a flat
cost.  One strand folds into hairpins with bulges and interior loops; loops of
several branches and knots aren't counted.  These are approximations of what a
full simulation of a test tube would give.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hybrispark.functions import thermo
from hybrispark.functions.thermo import DEFAULT_TEMPERATURE, Conditions

#: Cost of a mismatch between two helices, kcal/mol.
MISMATCH = 3.0
# Free energies (kcal/mol at 37 degrees) of hairpin, bulge and
# interior loops by their size, of SantaLucia and Hicks (2004).
HAIRPIN = {3: 3.5, 4: 3.5, 5: 3.3, 6: 4.0, 7: 4.2, 8: 4.3, 9: 4.5}
BULGE = {1: 4.0, 2: 2.9, 3: 3.2, 4: 3.3, 5: 3.5, 6: 3.7}
INTERIOR = {2: 0.5, 3: 3.2, 4: 3.2, 5: 4.0, 6: 4.4}
_BASES = np.full(256, 4, np.uint8)
_BASES[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3, 0, 1, 2, 3]
_PLAIN = Conditions(pct_formamide=0)


@dataclass(frozen=True)
class BindingModel:
    """What binding is computed for by default: DNA in 0.39 M sodium at 37 degrees lowered for 50 % formamide."""

    sodium: float = 0.39
    magnesium: float = 0.0
    temperature: float = DEFAULT_TEMPERATURE

    @property
    def conditions(self) -> Conditions:
        return Conditions(Na=1000 * self.sodium, Mg=1000 * self.magnesium, pct_formamide=0)


DEFAULT_MODEL = BindingModel()


def _gas(temperature: float) -> float:
    return thermo.GAS_CONSTANT / 1000 * (thermo.KELVIN + temperature)


def _stacks(temperature: float, conditions: Conditions) -> tuple[np.ndarray, np.ndarray]:
    """Free energies of two stacked pairs by ``5 * base + base``, and of an end by its base."""
    kelvin = thermo.KELVIN + temperature
    dh, ds = thermo.pair_tables()
    salt = thermo.SALT_FACTOR * np.log(conditions.monovalent / 1000)
    pair = dh / 10 - kelvin * (ds / 10 + salt) / 1000
    eh, es = thermo.terminal_tables()
    return pair, eh / 10 - kelvin * (es / 10) / 1000


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bases of some texts as rows filled up with 4, and their lengths."""
    size = np.array([len(t) for t in texts])
    out = np.full((len(texts), int(size.max(initial=0))), 4, np.uint8)
    for i, t in enumerate(texts):
        out[i, : size[i]] = _BASES[np.frombuffer(t.encode("ascii", "replace"), np.uint8)]
    return out, size


def pair_energies(a: list[str], b: list[str], temperature: float = DEFAULT_TEMPERATURE, conditions: Conditions = _PLAIN, mismatch: float = MISMATCH) -> np.ndarray:
    """Free energy of the most stable pairing of each two strands, 0 where none is stable."""
    x, n = _codes(a)
    y, m = _codes([t[::-1] for t in b])
    pair, end = _stacks(temperature, conditions)
    best = np.zeros(len(a))
    for shift in range(-(y.shape[1] - 1), x.shape[1]):
        # Base i of a stands against base i - shift of b, read backwards.
        open_ = np.full(len(a), np.inf)
        held = np.full(len(a), np.inf)
        before = np.zeros(len(a), bool)
        for i in range(max(0, shift), min(x.shape[1], y.shape[1] + shift)):
            p, q = x[:, i], y[:, i - shift]
            match = (p < 4) & (p + q == 3)
            stack = pair[5 * x[:, i - 1] + p] if i else 0.0
            on = np.where(before, open_ + stack, np.inf)
            new = np.minimum(np.minimum(end[np.minimum(p, 4)], on), held)
            held = np.minimum(np.where(before, open_, np.inf), held) + mismatch
            held = np.where(match, np.inf, held)
            open_ = np.where(match, new, np.inf)
            best = np.minimum(best, np.where(match, open_ + end[np.minimum(p, 4)], np.inf))
            before = match
    return best


def bound_share(energy: np.ndarray, conc_a: float, conc_b: float, temperature: float) -> np.ndarray:
    """Share of the scarcer of two strands that is bound, in a two-state equilibrium."""
    k = np.exp(energy / _gas(temperature))
    x = conc_a + conc_b + k
    return np.minimum(2 * conc_a * conc_b / (x + np.sqrt(x * x - 4 * conc_a * conc_b)) / min(conc_a, conc_b), 1.0)


def shares_of_target(energy_a: np.ndarray, energy_b: np.ndarray, conc_a: float, conc_b: float, conc_target: float, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the scarcest of three strands in the duplexes of the target with either of two others.

    The free target is the root of its mass balance, which grows with it; it is
    found by halving.
    """
    ka, kb = (np.exp(-np.clip(e / _gas(temperature), -500, 0)) for e in (energy_a, energy_b))
    low, high = np.zeros(len(ka)), np.full(len(ka), conc_target)
    for _ in range(200):
        t = (low + high) / 2
        over = t * (1 + ka * conc_a / (1 + ka * t) + kb * conc_b / (1 + kb * t)) > conc_target
        low, high = np.where(over, low, t), np.where(over, t, high)
    least = min(conc_a, conc_b, conc_target)
    return tuple(np.clip(k * t * c / (1 + k * t) / least, 0.0, 1.0) for k, c in ((ka, conc_a), (kb, conc_b)))


def unpaired(seqs: list[str], temperature: float = DEFAULT_TEMPERATURE, conditions: Conditions = _PLAIN) -> np.ndarray:
    """Probability that a strand is entirely unpaired: one over the sum of all its foldings' weights."""
    out = np.ones(len(seqs))
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(seqs):
        by_size.setdefault(len(s), []).append(i)
    for n, rows in by_size.items():
        if n >= 5:
            out[rows] = 1 / _foldings(_codes([seqs[i] for i in rows])[0].astype(np.int64), n, temperature, conditions)
    return out


def _foldings(x: np.ndarray, n: int, temperature: float, conditions: Conditions) -> np.ndarray:
    rt = _gas(temperature)
    pair, end = _stacks(temperature, conditions)
    warm = (thermo.KELVIN + temperature) / (thermo.KELVIN + 37.0)
    weight = lambda g: np.exp(-g / rt)
    stack, close = weight(pair), weight(end)
    loop = lambda table, size: weight(warm * (table.get(size) or table[max(table)] + 1.75 * thermo.GAS_CONSTANT / 1000 * 310.15 * np.log(size / max(table))))
    rows = len(x)
    pairs = (x[:, :, None] < 4) & (x[:, :, None] + x[:, None, :] == 3)
    inner = np.zeros((rows, n, n))
    for span in range(4, n):
        for i in range(n - span):
            j = i + span
            can = pairs[:, i, j]
            if not can.any():
                continue
            z = np.full(rows, loop(HAIRPIN, span - 1)) * close[x[:, i]] if span - 1 >= 3 else np.zeros(rows)
            for left in range(7):
                for right in range(7 - left):
                    p, q = i + 1 + left, j - 1 - right
                    if q - p < 4:
                        continue
                    if left == right == 0:
                        w = stack[5 * x[:, i] + x[:, p]]
                    elif left == 0 or right == 0:
                        w = loop(BULGE, left + right)
                        w = w * stack[5 * x[:, i] + x[:, p]] if left + right == 1 else w
                    else:
                        w = loop(INTERIOR, left + right)
                    z += w * inner[:, p, q]
            inner[:, i, j] = np.where(can, z, 0.0)
    total = np.ones((rows, n + 1))
    for j in range(n):
        total[:, j + 1] = total[:, j]
        for i in range(j - 3):
            total[:, j + 1] += total[:, i] * inner[:, i, j] * close[x[:, i]]
    return total[:, n]


_WHOLE = r"^[ACGTacgt]+$"


def duplex_probability_of(a: Column | str, b: Column | str, conc_a: float = 1e-6, conc_b: float = 1e-12, temperature: float = DEFAULT_TEMPERATURE, conditions: Conditions = _PLAIN) -> Column:
    """Share of the scarcer strand bound to the other; null for empty or ambiguous sequences."""

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        known = _known(x, y)
        out = np.full(len(x), np.nan, object)
        out[:] = None
        if known.any():
            energy = pair_energies(x[known].tolist(), y[known].tolist(), temperature, conditions)
            out[known] = bound_share(energy, conc_a, conc_b, temperature)
        return pd.Series(out)

    return share(a, b)


def competitive_probability_of(
    a: Column | str, b: Column | str, target: Column | str, conc_a: float = 1e-6, conc_b: float = 1e-6, conc_target: float = 1e-12, temperature: float = DEFAULT_TEMPERATURE, conditions: Conditions = _PLAIN
) -> Column:
    """Struct (a_target, b_target): shares of a target bound by either of two strands; null for empty or ambiguous sequences."""

    @F.pandas_udf("a_target double, b_target double")
    def shares(x: pd.Series, y: pd.Series, t: pd.Series) -> pd.DataFrame:
        known = _known(x, y, t)
        out = np.full((len(x), 2), None, object)
        if known.any():
            goal = t[known].tolist()
            ga, gb = (pair_energies(s[known].tolist(), goal, temperature, conditions) for s in (x, y))
            out[known] = np.stack(shares_of_target(ga, gb, conc_a, conc_b, conc_target, temperature), 1)
        return pd.DataFrame(out, columns=["a_target", "b_target"]).astype("Float64")

    return shares(a, b, target)


def unpaired_probability(seq: Column | str, temperature: float = DEFAULT_TEMPERATURE, conditions: Conditions = _PLAIN) -> Column:
    """Probability that a sequence is entirely unpaired; null for an empty or ambiguous one."""

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            known = _known(x)
            out = np.full(len(x), None, object)
            some = np.flatnonzero(known)
            for low in range(0, len(some), 2_000):
                part = some[low : low + 2_000]
                out[part] = unpaired(x.iloc[part].tolist(), temperature, conditions)
            yield pd.Series(out)

    return probability(seq)


def _known(*columns: pd.Series) -> np.ndarray:
    known = np.ones(len(columns[0]), bool)
    for c in columns:
        known &= c.notna().to_numpy() & c.fillna("").str.fullmatch(_WHOLE[1:-1]).to_numpy()
    return known


def _checked(*seqs: str) -> None:
    if any(not s for s in seqs):
        raise ValueError("sequences must be non-empty strings")


def pdup(seq_a: str, seq_b: str | None = None, conc_a: float = 1e-6, conc_b: float = 1e-12, temperature: float = DEFAULT_TEMPERATURE, conditions: Conditions = _PLAIN) -> float:
    """Share of the scarcer of two strands in their duplex; the second is the first one's reverse complement by default."""
    _checked(seq_a, *([] if seq_b is None else [seq_b]))
    other = seq_a[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca")) if seq_b is None else seq_b
    return float(bound_share(pair_energies([seq_a], [other], temperature, conditions), conc_a, conc_b, temperature)[0])


def competitive_pdup(seq_a: str, seq_b: str, target: str, conc_a: float = 1e-6, conc_b: float = 1e-6, conc_target: float = 1e-12, temperature: float = DEFAULT_TEMPERATURE, conditions: Conditions = _PLAIN) -> tuple[float, float]:
    """Shares of a target in its duplexes with two strands that compete for it."""
    _checked(seq_a, seq_b, target)
    energies = (pair_energies([s], [target], temperature, conditions) for s in (seq_a, seq_b))
    one, two = shares_of_target(*energies, conc_a, conc_b, conc_target, temperature)
    return float(one[0]), float(two[0])
