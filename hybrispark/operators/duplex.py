"""Stability of duplexes: features, the linear discriminant and a hook for boosted trees."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybrispark.errors import ConfigurationError
from hybrispark.functions.seqfn import DINUCLEOTIDES, clamp, count_words, gc_content, rev_comp
from hybrispark.guards import package

# Coefficients of length, alignment score and GC percent, and the
# intercept of the discriminant, by temperature in Celsius.
DISCRIMINANT = {
    32: (-0.14494789, 0.18791679, 0.02588474, -1.17545204),
    37: (-0.13364364, 0.22510179, 0.05494031, -5.40436344),
    42: (-0.09006122, 0.25660706, 0.1078303, -12.45549846),
    47: (-0.01593182, 0.24498485, 0.15753649, -19.32670233),
    52: (0.01860365, 0.1750174, 0.17003374, -20.11992898),
    57: (0.03236755, 0.11624593, 0.24306498, -23.98652919),
}
#: Temperatures for which tree models are made.
TREE_TEMPERATURES = (37, 42, 47, 52, 60)


def discriminant_features(probe: str = "probe_seq", score: str = "align_score") -> dict[str, Column]:
    return {
        "probe_len": F.length(probe),
        "align_score": F.col(score),
        "probe_gc": gc_content(probe, as_percent=True),
    }


def predict_discriminant(
    df: DataFrame,
    temperature: int = 42,
    normalize: bool = True,
    probe: str = "probe_seq",
    score: str = "align_score",
    out: str = "duplex_pred",
) -> DataFrame:
    """Probability that a probe is bound at a temperature, by the linear discriminant.

    0 to 1, or 0 to 100 without ``normalize``; null where the sequence or the
    score is null.
    """
    if temperature not in DISCRIMINANT:
        raise ConfigurationError(f"no discriminant for {temperature} C; known: {sorted(DISCRIMINANT)}")
    a, b, c, d = DISCRIMINANT[temperature]
    x = discriminant_features(probe, score)
    z = x["probe_len"] * a + x["align_score"] * b + x["probe_gc"] * c + d
    top = 1.0 if normalize else 100.0
    return df.withColumn(out, clamp(top / (1 + F.exp(-z)), 0.0, top))


def tree_features(probe: str = "probe_seq", derived: str = "derived_seq", score: str = "align_score") -> dict[str, Column]:
    """The 37 features of the tree models in their order; the derived sequence counts on its other strand.

    Pairs of bases are counted from left to right without overlap, in their case.
    """
    turned = rev_comp(derived)
    out = {
        "align_score": F.col(score),
        "probe_gc_percent": gc_content(probe, as_percent=True),
        "derived_gc_percent": gc_content(turned, as_percent=True),
        "probe_len": F.length(probe),
        "derived_len": F.length(derived),
    }
    out |= {f"probe_{d}": count_words(probe, d) for d in DINUCLEOTIDES}
    out |= {f"derived_{d}": count_words(turned, d) for d in DINUCLEOTIDES}
    return out


def predict_trees(
    df: DataFrame,
    model: str | Callable[[pd.DataFrame], pd.Series],
    temperature: int = 37,
    normalize: bool = True,
    probe: str = "probe_seq",
    derived: str = "derived_seq",
    score: str = "align_score",
    out: str = "duplex_pred",
) -> DataFrame:
    """Predictions of a user's model on the tree features, in Arrow batches.

    ``model`` is the path of a booster file, which every worker loads once, or
    a function from the frame of features to percentages.
    """
    if temperature not in TREE_TEMPERATURES:
        raise ConfigurationError(f"no tree model for {temperature} C; known: {TREE_TEMPERATURES}")
    columns = tree_features(probe, derived, score)
    names = list(columns)
    top = 100.0 if normalize else 1.0

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        run = _booster(model) if isinstance(model, str) else model
        for frame in batches:
            yield pd.Series(run(frame[names])).clip(0, 100) / top

    packed = F.struct(*[c.cast("double").alias(n) for n, c in columns.items()])
    return df.withColumn(out, predict(packed))


def default_temperature(model: object) -> int:
    """The temperature predicted for unless another is named: 37 by trees, 42 by the discriminant."""
    return 37 if model else 42


def predict_one_by_trees(
    model: str | Callable[[pd.DataFrame], pd.Series], probe: str, derived: str, score: int, normalize: bool = True
) -> float:
    """The prediction for a single pair, without a session."""
    turned = derived[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
    share = lambda s: 100 * sum(c in "GCgc" for c in s) / len(s) if s else 0.0
    row = {"align_score": score, "probe_gc_percent": share(probe), "derived_gc_percent": share(turned), "probe_len": len(probe), "derived_len": len(derived)}
    row |= {f"probe_{d}": probe.count(d) for d in DINUCLEOTIDES} | {f"derived_{d}": turned.count(d) for d in DINUCLEOTIDES}
    run = _booster(model) if isinstance(model, str) else model
    value = float(pd.Series(run(pd.DataFrame([row]).astype(float))).clip(0, 100).iloc[0])
    return value / (100.0 if normalize else 1.0)


@functools.lru_cache(4)
def _booster(path: str) -> Callable[[pd.DataFrame], pd.Series]:
    xgboost = package("xgboost")
    booster = xgboost.Booster()
    booster.load_model(path)
    return lambda frame: booster.predict(xgboost.DMatrix(frame))
