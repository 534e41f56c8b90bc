import random

from hybrispark.llm import leakage as lk

WORDS = [f"w{i}" for i in range(400)] + ["the", "of", "and", "a"] * 30


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = lk.words_of(t)
        for a in range(len(w) - n + 1):
            grams.setdefault(tuple(w[a : a + n]), set()).add(i)
    return list({(d, i) for d, t in docs for w in [lk.words_of(t)] for a in range(len(w) - n + 1) for i in grams.get(tuple(w[a : a + n]), ())})


def test_forms_of_words():
    assert lk.words_of("The “Bee-\n> keepers” of Ker­ni, <b>x</b>&amp;ﬁrst lan​terns ＡＢ1") == ["the", "beekeepers", "of", "kerni", "x", "first", "lanterns", "ab1"]
    assert lk.words_of("a well-known - thing") == ["a", "well", "known", "thing"]
    assert lk.words_of(None) == [] == lk.words_of(" .")


def test_against_brute_force(spark, rows):
    rng = random.Random(4)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([3, 11, 12, 30, 60])))) for i in range(80)]
    items += [(900, items[0][1]), (901, None), (902, ""), (None, " ".join(text(20)))]
    docs = []
    for d in range(200):
        w = text(rng.randrange(150))
        if d % 3:
            it = rng.choice(items)[1] or ""
            part = it.split()[rng.randrange(4) :][: rng.choice([11, 12, 13, 40])]
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() if rng.random() < 0.2 else x + "," for x in part]
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), docs[1], (None, items[4][1])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    known = lambda r: sorted(r, key=str)
    expected = known(brute(docs, items, 12))
    assert known(map(tuple, lk.leaked_items(df, it).collect())) == expected and len(expected) > 30
    assert known(map(tuple, lk.leaked_items(df, it, index_chars=3000, slice_chars=500).collect())) == expected
    assert lk.leaked_items(df.limit(0), it).collect() == [] and lk.leaked_items(df, it.limit(0)).collect() == []


def test_retrieval_is_lossless():
    import numpy as np

    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(40))) for i in range(100)]
    index = lk.build_index(items, 12, block_size=8)
    for i in range(100):
        words = items[i][1].split()[7:19]
        noise = [rng.choice(WORDS + ["zz"]) for _ in range(8)]
        code = np.array([index.terms.get(w, -1) for w in noise[:4] + words + noise[4:]], np.int32)
        _, found = lk.retrieve(index, code, np.array([0]), np.array([20]))
        assert i in found.tolist()
