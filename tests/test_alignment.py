"""Alignment against brute force: long probes, gaps, repeats, written indexes."""

import math
import random

import numpy as np
import pytest

from hybrispark.errors import ConfigurationError, ReferenceIndexError
from hybrispark.operators import alignment, gaps
from hybrispark.operators.alignment import align, build_seed_index, load_seed_index, save_seed_index


def dna(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def turn(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def frames(spark, probes, texts):
    return spark.createDataFrame([(p,) for p in probes], "probe_seq string"), spark.createDataFrame(list(texts.items()), "seq_id string, seq string")


def best_with_gaps(q, t, local):
    """The best score of an alignment of q to a stretch of t."""
    low = -(10**9)
    n, m = len(q), len(t)
    h = [0] * (m + 1)
    f = [low] * (m + 1)
    top = 0 if local else low
    for i in range(1, n + 1):
        new, e = [0 if local else -5 - 3 * i], low
        for j in range(1, m + 1):
            f[j] = max(h[j] - 5, f[j]) - 3
            e = max(new[j - 1] - 5, e) - 3
            point = (2 if local else 0) if q[i - 1] == t[j - 1] else -6
            new.append(max(h[j - 1] + point, f[j], e, *([0] if local else [])))
        h = new
        if local or i == n:
            top = max(top, *h)
    return top


@pytest.mark.parametrize("local", [True, False])
def test_scores_with_gaps(local):
    rng = random.Random(4)
    for _ in range(60):
        t = dna(40, rng.random())
        q = t[4:20] + ("" if rng.random() < 0.5 else dna(rng.randrange(3), rng.random())) + t[20 + rng.randrange(3) : 36]
        text = np.frombuffer(q.encode(), np.uint8)[None]
        band = 6
        wide = np.zeros((1, len(q) + 2 * band), np.uint8)
        part = np.frombuffer(t.encode(), np.uint8)
        wide[0, 2 : 2 + len(part)] = part[: wide.shape[1] - 2]
        score = int(gaps.banded_scores(text, np.array([len(q)]), wide, band, local)[0])
        assert score == best_with_gaps(q, t, local)
        (ops,), (column,), (wrong,) = gaps.traces(text, np.array([len(q)]), wide, band, local)
        aligned, at, i, mismatches = 0, column, len(ops) - len(ops.lstrip("S")), 0
        previous = ""
        for op in ops.strip("S"):
            if op == "M":
                same = text[0, i] == wide[0, at]
                mismatches += not same
                aligned += (2 if local else 0) if same else -6
            elif op != previous:
                aligned -= 5
            if op in "ID":
                aligned -= 3
            i, at, previous = i + (op in "MI"), at + (op in "MD"), op
        assert (aligned, mismatches) == (score, wrong)


def test_gaps_in_align(spark, rows):
    text = dna(4_000, 1)
    deleted = text[1_000:1_022] + text[1_024:1_044]
    inserted = text[2_000:2_022] + "GT" + text[2_022:2_040]
    probes, genome = frames(spark, [deleted, turn(inserted), text[3_000:3_030]], {"c": text})
    best = {}
    for r in align(probes, genome, band=3).collect():
        if r.probe_seq not in best or r.align_score > best[r.probe_seq].align_score:
            best[r.probe_seq] = r
    a, b, c = best[deleted], best[turn(inserted)], best[text[3_000:3_030]]
    assert (a.align_score, a.align_start, a.align_stop, a.align_strand) == (2 * 42 - 5 - 6, 1_000, 1_044, "+")
    assert a.derived_seq == text[1_000:1_044] and "2D" in a.align_cigar and a.mismatches == 0
    assert b.align_score == 2 * 40 - 5 - 6 and b.align_strand == "-" and b.align_start == 2_000 and "2I" in b.align_cigar
    # An insertion counts as length.
    assert b.align_stop == 2_042 and b.derived_seq == turn(text[2_000:2_042])
    assert (c.align_cigar, c.align_score, c.align_start) == ("30M", 60, 3_000)
    for r in (a, b, c):
        window = r.derived_seq if r.align_strand == "+" else turn(r.derived_seq)
        assert window == text[r.align_start : r.align_stop]
    plain = {r.probe_seq: r.align_score for r in align(probes, genome).collect()}
    assert all(best[q].align_score >= s for q, s in plain.items())
    with pytest.raises(ConfigurationError):
        align(spark.createDataFrame([(dna(300, 2),)], "probe_seq string"), genome, band=2)


def test_long_probes_across_blocks(spark):
    text = dna(20_000, 3)
    cuts = [(100, 3_000), (7_500, 900), (7_500, 3_000), (8_000, 1_200), (16_000, 256), (16_200, 257), (0, 20_000), (19_970, 30)]
    probes, genome = frames(spark, [text[a : a + n] for a, n in cuts] + [turn(text[5:4_000])], {"c": text})
    found = {(r.align_start, r.align_stop, r.align_strand, r.align_score) for r in align(probes, genome, k=1).collect()}
    assert found == {(a, a + n, "+", 2 * n) for a, n in cuts} | {(5, 4_000, "-", 2 * 3_995)}


def placements(q, texts, seed=20):
    out = []
    for name, text in texts.items():
        for a in range(len(text) - len(q) + 1):
            for strand in "+-":
                w = text[a : a + len(q)] if strand == "+" else turn(text[a : a + len(q)])
                same = "".join("01"[x == y and x in "ACGT"] for x, y in zip(q, w))
                if "1" * seed in same:
                    here = best = 0
                    for x, y in zip(q, w):
                        here = max(0, here + (2 if x == y else -6))
                        best = max(best, here)
                    if best >= 20 + 8 * math.log(len(q)):
                        out.append((q, name, a, strand, best))
    return out


@pytest.mark.parametrize("every", [1, 4])
@pytest.mark.parametrize("hot", [3, 256])
def test_repeats_and_ambiguity(spark, rows, monkeypatch, every, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    unit = dna(45, 7)
    texts = {"a": unit * 12 + dna(50, 8), "b": turn(unit) * 9 + "N" + unit[:25] + "A" * 70, "c": dna(400, 9).replace("GATC", "GNTC"), "d": "ACGT"}
    probes = {unit[:30], unit[10:45], unit[:24] + "C" + unit[25:40], "A" * 30, texts["c"][100:140], unit[:20] + "N" + unit[21:44], unit[:21], "", "é" * 30}
    some, genome = frames(spark, [*probes, None], texts)
    index = build_seed_index(genome, 20, reach=64, every=every, piece=100)
    found = align(some, genome, index=index, k=None)
    assert rows(found.select("probe_seq", "align_seqid", "align_start", "align_strand", "align_score")) == sorted(x for q in probes for x in placements(q, texts))
    assert (index.hot.count() > 0) == (hot == 3)


def test_written_index(spark, rows, tmp_path):
    texts = {"c": dna(500, 5)}
    probes, genome = frames(spark, [texts["c"][40:75], turn(texts["c"][300:330])], texts)
    save_seed_index(build_seed_index(genome, 20, reach=40), str(tmp_path / "i"), buckets=3)
    index = load_seed_index(spark, str(tmp_path / "i"), 20)
    assert rows(align(probes, genome, index=index)) == rows(align(probes, genome))
    with pytest.raises(ReferenceIndexError):
        load_seed_index(spark, str(tmp_path / "i"), 22)
    with pytest.raises(ReferenceIndexError):
        load_seed_index(spark, str(tmp_path / "nothing"))
    with pytest.raises(ReferenceIndexError):
        align(probes, genome, index=index, longest=60)


def test_nothing_to_align(spark):
    probes, genome = frames(spark, [], {"c": dna(100, 1)})
    assert align(probes, genome).count() == 0
    probes, genome = frames(spark, ["ACGT" * 8], {})
    assert align(probes, genome).count() == 0
