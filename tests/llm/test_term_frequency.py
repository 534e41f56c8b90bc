import random
import re
from collections import Counter

import pytest

from hybrispark.llm import term_frequency as tf


def brute(rows, find):
    best = {}
    for i, t in rows:
        if i is not None and t is not None:
            best[i] = max(best.get(i, t), t)
    occ, rec = Counter(), Counter()
    for t in best.values():
        words = find(t)
        occ.update(words)
        rec.update(set(words))
    n = len({i for i, _ in rows if i is not None})
    return sorted((w, occ[w], rec[w], "rare" if occ[w] == 1 else "common" if rec[w] >= max(10, 0.02 * n) else None) for w in occ)


def stretches(k, alphabet):
    def find(text):
        s = "".join(text.split()).upper()
        words = [s[a : a + k] for a in range(len(s) - k + 1)]
        return [w for w in words if alphabet is None or not set(w) - set(alphabet)]

    return find


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def data(alphabet):
    rng = random.Random(1)
    out = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(300)]
    out += [(i, "acgtACGTacgtACG") for i in range(300, 340)] + out[:20]
    return out + [(None, "ACGTACGT"), (900, None), (901, ""), (902, "é" * 9 + "ACGTAC"), (5, "A" * 40), (903, "ACGT " * 500), (904, "ACGT\n" * 500)]


CASES = [
    ({"k": 5}, stretches(5, "ACGT")), ({"k": 31}, stretches(31, "ACGT")), ({"k": 35}, stretches(35, "ACGT")), ({"k": 1}, stretches(1, "ACGT")),
    ({"k": 4, "alphabet": "ACGTN"}, stretches(4, "ACGTN")), ({"k": 3, "alphabet": None}, stretches(3, None)), ({"pattern": r"[^\W_]+"}, words),
]


@pytest.mark.parametrize("run, most", [(50, 100), (2_000_000, 4_000_000), (700, 50)])
@pytest.mark.parametrize("settings, find", CASES)
def test_against_brute_force(spark, rows, monkeypatch, settings, find, run, most):
    monkeypatch.setattr(tf, "SLICE", most)
    records = data("AC GTn ")
    df = spark.createDataFrame(records, "probe_id long, probe_seq string").repartition(4)
    assert rows(tf.term_frequency(df, "probe_id", "probe_seq", common_share=0.02, pairs_per_run=run, **settings)) == brute(records, find)


def test_hot_term_and_empty(spark, rows):
    df = spark.createDataFrame([(1, "A" * 30_000)], "probe_id long, probe_seq string")
    assert rows(tf.term_frequency(df, "probe_id", "probe_seq")) == [("A" * 18, 29_983, 1, None)]
    assert rows(tf.term_frequency(df.limit(0), "probe_id", "probe_seq")) == []
    assert rows(tf.term_frequency(df.limit(0), "probe_id", "probe_seq", pattern="A")) == []
    with pytest.raises(ValueError):
        tf.term_frequency(df, "probe_id", "probe_seq", 0)


def test_one_long_record(spark, rows):
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(9_000_000))
    df = spark.createDataFrame([(7, text), (8, text[:1000])], "i long, t string")
    got = tf.term_frequency(df, "i", "t", 6)
    counts = {r.term: (r.n_occurrences, r.n_records) for r in got.collect()}
    some = Counter(text[a : a + 6] for a in range(len(text) - 5)) + Counter(text[a : a + 6] for a in range(995))
    assert {w: n for w, (n, _) in counts.items()} == some
    first = {text[a : a + 6] for a in range(995)}
    assert all(r == 1 + (w in first) for w, (_, r) in counts.items())


def test_any_id(spark, rows):
    df = spark.createDataFrame([("a", "ACGT", 1), ("b", "ACG", 2)], "term string, record string, place int")
    assert rows(tf.term_frequency(df, "term", "record", 3)) == [("ACG", 2, 2, None), ("CGT", 1, 1, "rare")]
