import random

from hybrispark.llm.splitting import piece_bounds, split_items
from hybrispark.llm.top_items import top_probes


def test_top_against_brute_force(spark, rows):
    rng = random.Random(2)
    probes, scores = [], []
    for i in range(900):
        group = rng.choice(["hot"] * 6 + ["a", "b", "c", None])
        a, b = rng.randrange(50), rng.randrange(50, 60)
        probes.append((group, a, b, f"{group}:{a}-{b}", 1))
    for p in rng.sample(probes, 500):
        scores.append((p[3], rng.choice([0.5, 0.7, None, float("nan"), 0.9]), 2))
    best = {}
    for k, s, _ in scores:
        if s is not None and s == s:
            best[k] = max(best.get(k, s), s)
    expected = []
    for g in {p[0] for p in probes if p[0]}:
        mine = sorted({(-best[p[3]], p[1], p[2], p[3]) for p in probes if p[0] == g and p[3] in best})
        expected += [(g, n, p[3]) for n, p in enumerate(mine[:5], 1)]
    ps = spark.createDataFrame(probes, "seq_id string, start int, stop int, seqid string, rnk int")
    sc = spark.createDataFrame(scores, "seqid string, on_target_score double, start int")
    assert rows(top_probes(ps, sc)) == sorted(expected)
    assert rows(top_probes(ps.limit(0), sc)) == [] and rows(top_probes(ps, sc.limit(0))) == []


def test_group_limit_is_planned(spark):
    ps = spark.createDataFrame([("a", 1, 2, "a:1-2")], "seq_id string, start int, stop int, seqid string")
    sc = spark.createDataFrame([("a:1-2", 0.5)], "seqid string, on_target_score double")
    assert "WindowGroupLimit" in top_probes(ps, sc)._jdf.queryExecution().toString()


def naive_pieces(s, limit, overlap):
    ends = [b for b in range(10, len(s)) if s[b - 10 : b].upper() == "N" * 10 and s[b].upper() != "N"]
    out, p = [], 0
    while len(s) - p > limit:
        fit = [b for b in ends if p + overlap < b <= p + limit]
        e = max(fit) if fit else p + limit
        out.append((p, e))
        p = e - overlap
    return out + [(p, len(s))]


def test_split_against_brute_force(spark, rows):
    rng = random.Random(3)
    data, expected = [], []
    for i in range(60):
        s = "".join(rng.choice(["A", "c", " ", "\n", "N" * rng.randrange(1, 15), "n" * 11]) for _ in range(rng.randrange(200)))
        limit, width = rng.choice([None, 10, 25, 40, 0, -3, 400]), rng.choice([5, 12, None])
        data.append((i, s, limit, width, "x"))
        clean = "".join(s.split())
        real = 100_000 if limit is None else limit
        if clean and width is not None and real > width - 1:
            expected += [(i, n, a, b) for n, (a, b) in enumerate(naive_pieces(clean, real, width - 1), 1)]
    df = spark.createDataFrame(data + data[:10] + [(99, None, 5, 3, "x")], "mine_id long, seq string, chunk_size int, max_length int, piece_no string")
    assert rows(split_items(df)) == sorted(expected)
    texts = {(r.mine_id, r.piece_no): r.piece for r in split_items(df, with_text=True).collect()}
    for i, n, a, b in expected:
        assert texts[i, n] == "".join(data[i][1].split())[a:b]
    assert rows(split_items(df.limit(0))) == []


def test_bounds_of_a_long_item():
    pieces = piece_bounds(1_000_000, list(range(0, 1_000_000, 97)), 500, 36)
    assert all(b - a <= 500 for a, b in pieces) and all(y[0] == x[1] - 36 for x, y in zip(pieces, pieces[1:])) and pieces[-1][1] == 1_000_000
