import math
import random

import pytest
from pyspark.sql import functions as F

from hybrispark.errors import ConfigurationError, InvalidInputError, PipelineStateError
from hybrispark.functions import seqfn, thermo
from hybrispark.functions.thermo import Conditions
from hybrispark.operators import alignment, annotation, appending, duplex, kmers, sam, scoring
from hybrispark.operators.mining import MiningConfig, config, mine, tm_grid
from hybrispark.operators.spacing import select_spaced
from hybrispark.plans.pipeline import ProbeSet, design_probes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def dna(n, seed, letters="ACGT"):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def tm(seq, c=Conditions()):
    h = sum(thermo.ENTHALPY[seq[i : i + 2]] for i in range(len(seq) - 1)) + thermo.TERMINAL[seq[0]][0] + thermo.TERMINAL[seq[-1]][0]
    s = sum(thermo.ENTROPY[seq[i : i + 2]] for i in range(len(seq) - 1)) + thermo.TERMINAL[seq[0]][1] + thermo.TERMINAL[seq[-1]][1]
    return (h / 10 * 1000) / (s / 10 + c.salt_term(len(seq)) + c.strand_term) - 273.15 - c.depression


def brute_mine(seq, cfg):
    out, seq = [], seq.upper()
    for a in range(len(seq) - cfg.max_length + 1):
        best = []
        for n in range(cfg.min_length, cfg.max_length + 1):
            p = seq[a : a + n]
            if set(p) - set("ACGT"):
                continue
            if cfg.max_homopolymer is not None and any(b * (cfg.max_homopolymer + 1) in p for b in "ACGT"):
                continue
            if any(m.upper() in p for m in cfg.prohibited if m):
                continue
            t = tm(p, cfg.conditions)
            if cfg.min_tm <= t <= cfg.max_tm:
                best.append((n if cfg.tm_target is None else abs(t - cfg.tm_target), n, t, p))
        for _, n, t, p in best if cfg.exhaustive else sorted(best)[:1]:
            gc = 100 * sum(b in "GC" for b in p) / n
            if cfg.min_gc <= gc <= cfg.max_gc:
                out.append((a, a + n, p, round(t, 2)))
    if cfg.spaced:
        kept, last = [], -1
        for r in out:
            if r[0] >= last + max(cfg.spacing, 0):
                kept.append(r)
                last = r[1]
        out = kept
    return out


@pytest.mark.parametrize(
    "settings",
    [{}, {"tm_target": 44.5}, {"exhaustive": True}, {"prohibited": ("GATC", "nn", "")}, {"max_homopolymer": None}, {"overlap": False}, {"spacing": 10}, {"min_gc": 40, "max_gc": 60}, {"chunk_size": 37}, {"chunk_size": 101}],
)
def test_mining_against_brute_force(spark, rows, settings):
    cfg = config(**settings)
    texts = {"a": dna(700, 1), "b": dna(300, 2).lower() + "NN" + dna(200, 3), "c": "ACGT", "d": "", "e": dna(37, 4), "f": "ATCG" * 13, "g": dna(100, 5) + "é" + dna(90, 6)}
    df = spark.createDataFrame([*texts.items(), ("z", None)], "seq_id string, seq string").repartition(3)
    expected = sorted((k, *r) for k, s in texts.items() for r in brute_mine(s, cfg))
    assert rows(mine(df, cfg=cfg)) == expected


def test_mining_settings(spark):
    with pytest.raises(ConfigurationError):
        config(exhaustive=True, overlap=False)
    with pytest.raises(ConfigurationError):
        MiningConfig(chunk_size=10)
    with pytest.raises(ValueError):
        _ = Conditions(Na=0).monovalent
    df = spark.createDataFrame([("a", "ATCG" * 13)], "seq_id string, seq string")
    found = mine(df).orderBy("start").collect()
    assert len(found) == 16 and tuple(found[0])[1:3] == (0, 36) and found[0].tm == 42.85 and found[-1].tm == 43.01
    assert mine(df, cfg=config(min_length=18, max_length=20)).count() == 0
    assert mine(df.limit(0)).count() == 0
    g = tm_grid(df, "seq_id", "seq").where("length = 30").first()
    assert g.n_windows == 16


def test_scalars(spark):
    lit = F.lit
    assert [one(spark, seqfn.rev_comp(lit(s))) for s in ("ATCG", "atcg", "", "AN")] == ["CGAT", "cgat", "", "NT"]
    assert one(spark, seqfn.gc_content(lit("aTGC"))) == 0.5 and one(spark, seqfn.gc_content(lit(""))) == 0.0
    assert one(spark, seqfn.kmers(lit("ACGT"), 3)) == ["ACG", "CGT"] and one(spark, seqfn.kmers(lit("AC"), 3)) == []
    assert one(spark, seqfn.kmers(lit(None).cast("string"), 3)) is None
    assert one(spark, seqfn.count_words(lit("AAAAA"), "AA")) == 2
    assert [one(spark, seqfn.base_code(lit(b))) for b in "AcgTN"] == [0, 1, 2, 3, 4]
    assert one(spark, seqfn.clamp(lit(5.0), 0, 1)) == 1 and math.isnan(one(spark, seqfn.clamp(lit(float("nan")), 0, 1)))
    assert tuple(one(spark, seqfn.parse_label(lit("a:b:10-20(-)")))) == ("a:b", 10, 20, "-")
    assert one(spark, seqfn.parse_label(lit("nothing"))) is None
    assert tuple(one(spark, seqfn.local_to_genomic(lit("c:100-200(-)"), lit(5), lit(15)))) == ("c", 185, 195, "-")
    assert one(spark, seqfn.set_positions(lit("0101"))) == [2, 4]
    probe = "CACACCACACCCACACACACCACACCCACAC"
    assert round(one(spark, thermo.melting_temperature(lit(probe))), 2) == 45.94
    assert round(one(spark, thermo.melting_temperature(lit(probe), Conditions(pct_formamide=0))), 4) == 78.444
    assert round(one(spark, thermo.melting_temperature(lit(probe), Conditions(Na=50, pct_formamide=0))), 4) == 67.6024
    assert one(spark, thermo.melting_temperature(lit("ACGN"))) is None
    assert thermo.DEFAULT_TEMPERATURE == 4.5
    weak, strong = (one(spark, thermo.duplex_probability(lit(s), temperature=60.0)) for s in ("ATATATATATATATATATAT", "GCGCGCGCGCGCGCGCGCGC"))
    assert 0 <= weak < strong <= 1
    both = one(spark, thermo.competitive_probability(lit("GCGCGCATATGCGCGC"), lit(3), temperature=50.0))
    assert 0 <= both["off_target"] < both["on_target"] <= 1


def test_spacing_across_batches(spark, rows):
    rng = random.Random(5)
    data = [(k, a := rng.randrange(100_000), a + rng.randrange(1, 50)) for k in ("x", "y", None) for _ in range(15_000)]
    df = spark.createDataFrame(data, "k string, a int, b int").repartition(7)
    got = rows(select_spaced(df, "k", "a", "b", 3))
    expected = []
    for key in ("x", "y", None):
        last = -1
        for r in sorted((d for d in data if d[0] == key), key=lambda d: d[1:]):
            if r[1] >= last + 3:
                expected.append(r)
                last = r[2]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_kmers(spark, rows, tmp_path):
    texts = [("a", dna(900, 7) + "N" + dna(50, 8)), ("b", "ACG"), ("c", None)]
    df = spark.createDataFrame(texts, "seq_id string, seq string")
    from collections import Counter

    words = Counter(w for _, s in texts if s for w in (s[i : i + 5] for i in range(len(s) - 4)) if "N" not in w)
    index = kmers.build_kmer_index(df, k=5)
    assert dict(rows(index)) == dict(words)
    probes = spark.createDataFrame([(1, "ACGTACGTA"), (2, "ACG"), (3, None), (4, "acgtacgta")], "id int, probe_seq string")
    got = {r.id: r.max_kmer for r in kmers.add_max_kmer(probes, index, 5).collect()}
    best = max(words[w] for w in ("ACGTA", "CGTAC", "GTACG", "TACGT"))
    assert got == {1: best, 2: None, 3: None, 4: best}
    kmers.save_kmer_index(index, str(tmp_path / "ix"), 5)
    assert kmers.load_kmer_index(spark, str(tmp_path / "ix"), 5)[1:] == (5, False)
    from hybrispark.errors import ReferenceIndexError

    with pytest.raises(ReferenceIndexError):
        kmers.load_kmer_index(spark, str(tmp_path / "ix"), 6)


def test_sam(spark):
    def line(flag, pos, cigar, tag="AS:i:-3"):
        return "\t".join(["q", str(flag), "c", str(pos), "9", cigar, "*", "0", "0", "A", "~", tag])

    cases = [line(0, 100, "20M"), line(16, 200, "5S15M"), line(272, 3, "10S10M", "XX:i:1"), "@SQ\tx", "short", None, line(4, 5, "3M2I4M1D3H")]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, value string").select("value").coalesce(1)
    got = [(r.align_start, r.align_stop, r.align_strand, r.align_score) for r in sam.sam_to_bed(df).collect()]
    assert got == [(99, 119, "+", -3), (194, 214, "-", -3), (0, 12, "-", None), (4, 17, "+", -3)]


def test_trim_and_fetch(spark, rows):
    genome = spark.createDataFrame([("a", dna(1000, 9)), ("b", "acgtN")], "seq_id string, seq string")
    text = genome.where("seq_id = 'a'").first().seq
    bed = spark.createDataFrame([("a", 5, 900, "+"), ("a", 990, 1200, "-"), ("b", 0, 5, "-"), ("z", 0, 5, "+"), ("a", 2000, 2010, "+"), ("a", 7, 7, "+")], "align_seqid string, align_start int, align_stop int, align_strand string")
    got = {(r[0], r[1]): r.derived_seq for r in sam.fetch_sequences(bed, genome, block=64).collect()}
    turn = str.maketrans("ACGT", "TGCA")
    assert got == {("a", 5): text[5:900], ("a", 990): text[990:][::-1].translate(turn), ("b", 0): "NACGT", ("a", 7): ""}
    sizes = genome.select("seq_id", F.length("seq").alias("size"))
    assert rows(sam.trim_to_ends(bed, sizes).where("align_start = 990").select("align_stop")) == [(1000,)]


def test_alignment(spark, rows):
    text = dna(3000, 10)
    probe = text[100:135]
    wrong = probe[:20] + ("A" if probe[20] != "A" else "C") + probe[21:]
    turned = text[2000:2034][::-1].translate(str.maketrans("ACGT", "TGCA"))
    genome = spark.createDataFrame([("g", text)], "seq_id string, seq string")
    probes = spark.createDataFrame([(probe,), (wrong,), (turned,), ("ACGT",), (None,)], "probe_seq string")
    got = {(r.probe_seq, r.align_start, r.align_strand, r.align_score, r.mismatches) for r in alignment.align(probes, genome, preset=alignment.Preset(12, False), k=None).collect()}
    assert got == {(probe, 100, "+", 0, 0), (wrong, 100, "+", -6, 1), (turned, 2000, "-", 0, 0)}
    local = {r.probe_seq: r.align_score for r in alignment.align(probes, genome).collect()}
    assert local[probe] == 70 and local[turned] == 68 and local[wrong] == 62
    assert alignment.gapped_score("ACGTACGT", "ACGTTACGT") == 10 and alignment.gapped_score("ACGT", "ACGT", local=False) == 0
    frame = spark.createDataFrame([("ACGTACGT", "ACGTACGT")], "probe_seq string, derived_seq string")
    assert alignment.add_gapped_score(frame).first().gapped_score == 16


def test_models(spark):
    df = spark.createDataFrame([("ATCG" * 6, "CGAT" * 6, -10), (None, None, None)], "probe_seq string, derived_seq string, align_score int")
    got = duplex.predict_discriminant(df, 42).collect()
    assert got[0].duplex_pred == pytest.approx(7.568384598893602e-06) and got[1].duplex_pred is None
    with pytest.raises(ConfigurationError):
        duplex.predict_discriminant(df, 40)
    assert len(duplex.tree_features()) == 37
    fixed = duplex.predict_trees(df, lambda frame: frame["probe_len"] * 2).first()
    assert fixed.duplex_pred == pytest.approx(0.48)


def test_scores(spark, rows):
    data = [("p1", "c", 5, "c", 5, 0.8), ("p1", "c", 5, "c", 9, 0.1), ("p2", "c", 7, "d", 7, None), (None, "c", 1, "c", 1, 1.0), ("p3", None, 1, None, 1, 0.5)]
    df = spark.createDataFrame(data, "seqid string, seq_id string, start int, align_seqid string, align_start int, duplex_pred double")
    assert rows(scoring.score_probes(df)) == [("p1", 0.8, 0.1), ("p2", 0.0, 0.0), ("p3", 0.0, 0.5)]


def test_annotation(spark, rows):
    ex = [("c", 0, 10, "g", "t1", "+", 1), ("c", 0, 5, "g", "t2", "+", 2), ("c", 5, 10, "g", "t3", "+", 3), ("c", 10, 20, "h", "t4", "-", 4), ("c", 30, 40, "h", "t4", "-", 5), ("c", 3, 3, "i", "t5", "+", 6)]
    df = spark.createDataFrame([(*r, ".", "exon") for r in ex], "seqid string, start int, end int, gene_id string, transcript_id string, strand string, ord int, score string, type string")
    flat = rows(annotation.flatten_isoforms(df, "ord").select("gene_id", "start", "end", "coverage"))
    assert flat == [("g", 0, 10, 2), ("h", 10, 20, 1), ("h", 30, 40, 1)]
    text = dna(60, 11)
    genome = spark.createDataFrame([("c", text)], "seq_id string, seq string")
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    spliced = dict(rows(annotation.spliced_sequences(df.where("gene_id = 'h'"), genome)))
    assert spliced == {"t4": turn(text[30:40]) + turn(text[10:20])}
    assert rows(annotation.intron_sequences(df, genome)) == [("c:20-30(-)", turn(text[20:30]))]
    with pytest.raises(InvalidInputError):
        annotation.select_features(df)
    with pytest.raises(InvalidInputError):
        annotation.select_features(df, transcript_id="none")
    assert annotation.select_features(df, gene_id="h").count() == 2
    raw = spark.createDataFrame([(1, 'gene_id "A"; transcript_id "T.2"; tag x; tag y'), (2, "ID=a;gene_id=B"), (3, None)], "i int, attributes string")
    assert rows(annotation.parse_attributes(raw)) == [(1, "A", "", "T.2", "T"), (2, "B", "", "", ""), (3, "", "", "", "")]
    ids = ["chr1", "chr1_alt_random", "x_random", "Un_1", None]
    assert [one(spark, annotation.classify_ids(F.lit(i).cast("string"))) for i in ids] == ["canonical", "alt", "unlocalized", "unplaced", None]


@pytest.fixture
def targets(spark):
    data = [(i, "ba"[i % 2] if i < 9 else None, f"AC{'GT' * i}") for i in range(10)]
    return spark.createDataFrame(data, "probe_ord int, target string, probe_seq string")


def test_appending(targets):
    pairs = [("s1", "AAC"), ("s2", "CCG"), ("s3", "GGT"), ("s4", "TTA")]
    by = lambda df: {r.probe_ord: (r.sequence, r.entry) for r in df.collect()}
    assert by(appending.append_same(targets, pairs, rc=True))[1] == ("GTTTTTACGT", "s1_AAC")
    unique = by(appending.append_unique(targets, pairs, "target", left=False))
    assert unique[0] == ("ACTTTAAC", "s1_AAC") and unique[1] == ("ACGTTTTCCG", "s2_CCG") and unique[9][1] == ""
    many = by(appending.append_multiple(targets.where("target IS NOT NULL"), pairs, 2, "target"))
    assert [many[i][1] for i in (0, 2, 4, 1, 3)] == ["s1_AAC", "s2_CCG", "s1_AAC", "s3_GGT", "s4_TTA"]
    custom = by(appending.append_custom(targets, pairs, ["1-3", "3-4"]))
    assert custom[3][0].startswith("CCGTTTAACTTT") and custom[3][1] == "s2_CCG" and custom[7] == ("AC" + "GT" * 7, "")
    for bad in (lambda: appending.append_unique(targets, pairs[:1], "target"), lambda: appending.append_sequences(targets, pairs, "no"), lambda: appending.parse_ranges(["x"])):
        with pytest.raises(InvalidInputError):
            bad()


def test_more_targets_than_sequences(targets):
    """Targets beyond the last sequence stay as they are, the others get theirs."""
    pairs = [("s1", "AAC"), ("s2", "CCG"), ("s3", "GGT")]
    by = lambda df: {r.probe_ord: (r.sequence, r.entry) for r in df.collect()}
    bare = {i: f"AC{'GT' * i}" for i in range(10)}
    ends = lambda found: {i: (s.removeprefix(bare[i]), e) for i, (s, e) in found.items()}
    own = {i: ("TTTAAC", "s1_AAC") if i % 2 == 0 and i < 9 else ("", "") for i in range(10)}
    assert ends(by(appending.append_unique(targets, pairs[:1], "target", left=False, strict=False))) == own
    assert ends(by(appending.append_saber(targets, pairs[:1], target="target", strict=False))) == own
    # The second target has one sequence for every other of its probes.
    many = by(appending.append_multiple(targets, pairs, 2, "target", strict=False))
    assert [many[i][1] for i in (0, 2, 4, 1, 3, 5, 9)] == ["s1_AAC", "s2_CCG", "s1_AAC", "s3_GGT", "", "s3_GGT", ""]
    bridges = [(str(i), "acgt"[i] * 2) for i in range(4)]
    coded = {r.probe_ord: r.sequence for r in appending.append_barcodes(targets, bridges, ["1111"], "target", strict=False).collect()}
    assert all((coded[i] == bare[i]) == (i % 2 == 1 or i == 9) for i in range(10))
    for bad in (appending.append_multiple, appending.append_barcodes):
        with pytest.raises(InvalidInputError):
            bad(targets, pairs[:1], 1 if bad is appending.append_multiple else ["1111"], "target")


def test_barcodes(targets):
    bridges = [(str(i), chr(ord("a") + i) * 2) for i in range(16)]
    done = appending.append_barcodes(targets, bridges, ["1111" + "0" * 12, "0" * 12 + "1111", "1010101" + "0" * 9], "target").collect()
    for r in done:
        if r.target is None:
            assert r.sequence == r.probe_seq
            continue
        added = r.sequence.replace(r.probe_seq, "|")
        used = set(added) - {"|"}
        assert len(added) == 7 and len(used) == 3 and used <= set("abcd" if r.target == "b" else "mnop")


def test_pipeline(spark):
    df = spark.createDataFrame([("a", dna(1500, 12)), ("b", dna(1200, 13))], "seq_id string, seq string")
    done = design_probes(df, cfg=config(spacing=30))
    n = done.probes.count()
    assert n > 5 and done.scores.where("on_target_score > 0 AND off_target_score = 0").count() == n
    base = ProbeSet.from_sequences(df, spacing=30)
    with pytest.raises(PipelineStateError):
        base.merge()
    full = base.align(df).merge().compute_pdup().compute_duplex_pred().score()
    assert full.scores.count() == n and base.merged is None
    assert full.append([("s", "ACG")], "same", "outer").master_table().columns == ["seqid", "outer"]


@pytest.mark.parametrize("k, canonical", [(1, False), (5, True), (18, False), (31, True), (40, False), (41, True)])
def test_words_as_numbers(spark, rows, k, canonical):
    texts = [dna(300, 1), dna(200, 2).lower() + "N" + dna(100, 1), "AC", "", None, "é" + "ACGT" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id int, seq string")
    turn = lambda w: w[::-1].translate(str.maketrans("ACGT", "TGCA"))
    expected = {}
    for t in texts:
        t = (t or "").upper()
        for w in (t[i : i + k] for i in range(len(t) - k + 1)):
            if not set(w) - set("ACGT"):
                w = min(w, turn(w)) if canonical else w
                expected[w] = expected.get(w, 0) + 1
    assert rows(kmers.build_kmer_index(df, k=k, canonical=canonical)) == sorted(expected.items())
    probes = spark.createDataFrame([(t,) for t in [texts[0][:60], texts[1][190:230], "ACGT", None, "N" * 50]], "probe_seq string")
    word = lambda t: max(expected.get(min(w, turn(w)) if canonical else w, 0) for w in (t[i : i + k].upper() for i in range(len(t) - k + 1)))
    best = [(t, word(t) if len(t) >= k else None) for (t,) in probes.where("probe_seq IS NOT NULL").collect()]
    for coded in {False, k <= 31}:
        index = kmers.build_kmer_index(df, k=k, canonical=canonical, coded=coded)
        assert rows(kmers.max_kmer(index, probes, k=k, canonical=canonical)) == sorted(best)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_max_kmer_within(spark, rows, monkeypatch, most):
    monkeypatch.setattr(kmers, "MOST_REPEATED", most)
    unit = dna(40, 8)
    texts = [unit + dna(60, 9) + unit, unit[:30].lower(), dna(50, 3) + "N" + dna(30, 2), "ACGT", None, "", "N" * 30, dna(18, 1)]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "seq_id int, probe_seq string, code int").repartition(2)
    for canonical in (False, True):
        index = kmers.build_kmer_index(df, "seq_id", "probe_seq", 18, canonical, coded=True)
        plain = kmers.add_max_kmer(df, kmers.build_kmer_index(df, "seq_id", "probe_seq", 18, canonical), canonical=canonical)
        within = kmers.add_max_kmer(df, index, canonical=canonical, within=True)
        assert within.columns == plain.columns and rows(within) == rows(plain)


@pytest.mark.parametrize("k, canonical", [(1, False), (5, False), (5, True), (11, True), (13, False), (13, True)])
def test_lookups(spark, rows, k, canonical):
    text = dna(400, 2)
    df = spark.createDataFrame([("a", text), ("b", text[:50] + "N" + text[60:90])], "seq_id string, seq string")
    asked = [text[a : a + k] for a in range(0, 300, 7)] + [text[3 : 3 + k].lower(), "A" * k, "N" * k, "ACGT" * 9, "", None, "é" * k, text[:k]]
    words = spark.createDataFrame(list(enumerate(asked)), "code int, kmer string").repartition(3)
    plain = kmers.query_kmers(kmers.build_kmer_index(df, k=k, canonical=canonical), words, canonical=canonical)
    coded = kmers.query_kmers(kmers.build_kmer_index(df, k=k, canonical=canonical, coded=True), words, canonical=canonical, k=k)
    assert coded.columns == plain.columns and rows(coded) == rows(plain) and coded.where("cnt > 0").count() > 20
