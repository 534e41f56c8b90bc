"""The chain of steps over files, and what goes with files."""

import gzip
import os
import random
import struct
import zlib

import pytest

from hybrispark import guards
from hybrispark.errors import (
    EmptyExportError,
    InvalidInputError,
    MissingDependencyError,
    MissingDirectoryError,
    MissingInputError,
    MissingOutputError,
    PipelineStateError,
)
from hybrispark.operators import appending, duplex, sam
from hybrispark.operators.mining import chunks, config, mine
from hybrispark.plans import pipeline
from hybrispark.plans.pipeline import ProbeSet, mine_fasta
from hybrispark.sources import files, sinks
from hybrispark.streaming.live import score_stream


def dna(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_pieces_of_fasta(spark, rows, tmp_path):
    texts = {"a": dna(5_000, 1), "b": "", "c": dna(37, 2).lower(), "d": dna(2_000, 3), "e": dna(901, 4)}
    for name, ids in (("x.fa", "abc"), ("y.fa", "de")):
        lines = ["no record"] if name == "y.fa" else []
        for i in ids:
            lines += [f">{i} text", *(texts[i][p : p + 61] for p in range(0, len(texts[i]), 61))]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    whole = spark.createDataFrame(list(texts.items()), "seq_id string, seq string")
    for most in (None, "700"):
        # Small parts of files, so that records begin and end anywhere in them.
        spark.conf.set("spark.sql.files.maxPartitionBytes", most or "128m")
        spark.conf.set("spark.sql.files.openCostInBytes", "1" if most else "4m")
        got = files.read_fasta_pieces(spark, str(tmp_path), 100, 36)
        assert rows(got) == rows(chunks(whole, "seq_id", "seq", 100, 36))
        assert rows(mine_fasta(spark, str(tmp_path), config(chunk_size=100)).drop("seqid")) == rows(mine(whole))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    spark.conf.set("spark.sql.files.openCostInBytes", "4m")


def test_probe_set_over_files(spark, rows, tmp_path):
    (tmp_path / "g.fa").write_text(f">a\n{dna(700, 5)}\n>b\n{dna(600, 6)}\n")
    made = ProbeSet.from_fasta(spark, str(tmp_path / "g.fa"))
    n = made.count()
    assert n > 10 and "seqid" in made.probes.columns
    made.to_csv(str(tmp_path / "p.csv"))
    again = ProbeSet.from_csv(spark, str(tmp_path / "p.csv"))
    assert again.probes.columns == made.probes.columns and rows(again.probes) == rows(made.probes)
    made.to_bed(str(tmp_path / "p.bed"))
    made.to_fastq(str(tmp_path / "p.fq"))
    made.to_fasta(str(tmp_path / "p.fa"))
    assert spark.read.text(str(tmp_path / "p.bed")).count() == n == files.read_fasta(spark, str(tmp_path / "p.fa")).count()
    assert spark.read.text(str(tmp_path / "p.fq")).count() == 4 * n
    assert made.rows().columns == ["seq_id", "start", "stop", "probe_seq", "tm"]
    for step in (made.merge, lambda: made.save_align_csv("x"), lambda: made.save_merged_csv("x"), lambda: made.compute_pdup()):
        with pytest.raises(PipelineStateError):
            step()
    genome = files.as_sequences(spark, str(tmp_path / "g.fa"))
    aligned = made.align(genome)
    aligned.save_align_csv(str(tmp_path / "a.csv"))
    merged = made.load_align_csv(str(tmp_path / "a.csv")).merge()
    assert rows(merged.alignments.select("seqid", "align_start", "align_score")) == rows(aligned.alignments.select("seqid", "align_start", "align_score"))
    merged.save_merged_csv(str(tmp_path / "m.csv"))
    assert merged.summary() == f"ProbeSet(probes={n}, alignments={n}, duplexes={n})"
    assert ProbeSet.from_rows(spark, []).count() == 0
    assert ProbeSet.from_rows(spark, [("c", 1, 5, "ACGT", 1.0)]).probes.first().seqid == "c:1-5"
    with pytest.raises(MissingInputError):
        ProbeSet.from_csv(spark, str(tmp_path / "none.csv"))


def test_alignments_in_one_step(spark, rows):
    text = dna(200, 7)
    genome = spark.createDataFrame([("c", text.lower())], "seq_id string, seq string")
    line = lambda name, flag, pos, cigar, ref="c": "\t".join([name, str(flag), ref, str(pos), "9", cigar, "*", "0", "0", "A", "~", "AS:i:-3"])
    lines = [line("p", 0, 11, "20M"), line("p", 0, 11, "20M"), line("q", 16, 190, "5S20M"), line("r", 0, 5, "9M", "z"), "@HD"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    got = rows(sam.process_alignments(df, genome).select("seqid", "align_start", "align_stop", "derived_seq"))
    assert got == [("p", 10, 30, text[10:30]), ("p", 10, 30, text[10:30]), ("q", 184, 209, turn(text[184:200])), ("r", 4, 13, None)]
    assert "derived_seq" not in sam.process_alignments(df).columns
    assert {r.derived_seq for r in sam.process_alignments(df, genome, to_upper=False).where("seqid = 'p'").collect()} == {text[10:30].lower()}


def test_merging_and_classes(spark, rows, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for name, text in (("b.fa", ">b\nAC\n"), ("a.fasta", ">a\nGG"), ("c.txt", ">c\nTT\n"), ("d.bed", "x\t1\n")):
        (tmp_path / "in" / name).write_text(text)
    sinks.merge_fastas(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert lines == ">a\nGG\n>b\nAC\n"
    assert rows(files.read_fasta_folder(spark, str(tmp_path / "in")).select("seq_id", "seq")) == [("a", "GG"), ("b", "AC")]
    sinks.merge_annotation_beds(spark, str(tmp_path / "in"), str(tmp_path / "beds"))
    for merge in (sinks.merge_fastas, sinks.merge_annotation_beds):
        (tmp_path / "none").mkdir(exist_ok=True)
        with pytest.raises(EmptyExportError):
            merge(spark, str(tmp_path / "none"), str(tmp_path / "x"))
    ids = spark.createDataFrame([("chr1",), ("chr1_alt",)], "seq_id string")
    assert rows(sinks.write_classes(ids, str(tmp_path / "classes"))) == [("chr1", "canonical"), ("chr1_alt", "alt")]
    assert spark.read.csv(str(tmp_path / "classes"), sep="\t", header=True).count() == 2
    assert sinks.to_fasta_text(["AC", "G"]) == ">seq_0\nAC\n>seq_1\nG\n" and sinks.to_fastq_text(["AC"], ["r"]) == "@r\nAC\n+\n~~\n"
    files.print_chromosome_sizes(spark.createDataFrame([("a", "AC"), ("b", "ACG")], "seq_id string, seq string"))
    assert capsys.readouterr().out == "b\t3\na\t2\n"


def test_named_sets(spark, tmp_path):
    with gzip.open(tmp_path / "saber_1x.tsv.gz", "wt") as f:
        f.write("id\tseq\n1\tACGT\n2\tGGTT\n")
    pairs = appending.as_pairs(files.load_appending_set(spark, "saber_1x", str(tmp_path)))
    assert pairs == [("1", "ACGT"), ("2", "GGTT")] and len(files.APPENDING_SETS) == 12
    with pytest.raises(InvalidInputError):
        files.load_appending_set(spark, "none", str(tmp_path))
    with pytest.raises(EmptyExportError):
        files.load_appending_set(spark, "bridges", str(tmp_path))
    assert files.example_probes(spark).count() > 100 and files.example_annotation(spark).count() == 36


def bgzf(raw, size):
    out = b""
    for a in [*range(0, len(raw), size), len(raw)]:
        part = zlib.compressobj(9, zlib.DEFLATED, -15)
        data = part.compress(raw[a : a + size]) + part.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<H2sHH", 6, b"BC", 2, len(data) + 25) + data
        out += struct.pack("<II", zlib.crc32(raw[a : a + size]), len(raw[a : a + size]))
    return out


def test_bam_of_many_blocks(spark, tmp_path):
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 99)
    for i in range(40):
        name = f"q{i}".encode() + b"\0"
        tags = b"ASC" + bytes([i]) + b"XZZabc\0" + b"XFf" + struct.pack("<f", 1.5) + b"XBBs" + struct.pack("<ihh", 2, -1, 7) + b"XAAq"
        body = struct.pack("<iiBBHHHiiii", 0, i, len(name), 7, 0, 1, 0, 4, 0, 5, 9) + name + struct.pack("<I", 4 << 4) + bytes([0x12, 0x48]) + bytes([30] * 4) + tags
        raw += struct.pack("<i", len(body)) + body
    (tmp_path / "x.bam").write_bytes(bgzf(raw, 50))
    lines = [r.value.split("\t") for r in files.read_bam(spark, str(tmp_path / "x.bam"), 7).collect()]
    assert len(lines) == 40 and lines[3] == ["q3", "0", "c", "4", "7", "4M", "=", "6", "9", "ACGT", "????", "AS:i:3", "XZ:Z:abc", "XF:f:1.5", "XB:B:s,-1,7", "XA:A:q"]


def test_draws_go_on():
    import numpy as np

    every = np.random.default_rng(9).integers(0, 4, size=1_000)
    for low, high in ((0, 1_000), (2, 3), (500, 777), (998, 1_000)):
        assert (appending._draws(9, low, high) == every[low:high]).all()


def test_scores_of_a_stream(spark, tmp_path):
    data = [("a", "c", 1, "c", 1, 0.5, 3_600), ("a", "c", 1, "d", 1, 0.25, 3_700), ("b", "c", 2, "c", 2, 1.0, 9_000)]
    schema = "seqid string, seq_id string, start int, align_seqid string, align_start int, duplex_pred double, t long"
    spark.createDataFrame(data, schema).selectExpr("*", "timestamp_seconds(t) AS at").write.parquet(str(tmp_path / "in"))
    for time in (None, "at"):
        stream = spark.readStream.schema(schema + ", at timestamp").parquet(str(tmp_path / "in"))
        q = score_stream(stream, "duplex_pred", str(tmp_path / f"cp{time}"), str(tmp_path / f"out{time}"), time)
        q.processAllAvailable()
        q.stop()
        got = {(r.seqid, r.on_target_score, r.off_target_score) for r in spark.read.parquet(str(tmp_path / f"out{time}")).collect()}
        assert got == {("a", 0.5, 0.25), ("b", 1.0, 0.0)}


def test_guards(spark, tmp_path):
    assert guards.one_of(a=None, b=0) == "b"
    (tmp_path / "x.sam").write_text("q\t0\tc\t3\t9\t4M\t*\t0\t0\tACGT\t~\tAS:i:-1\n")
    (tmp_path / "g.fa").write_text(">c\nTTACGTTT\n")
    assert guards.existing_input(spark, str(tmp_path / "*.sam")) and guards.folder(spark, str(tmp_path / "new"), create=True) and (tmp_path / "new").is_dir()
    assert guards.package("json").dumps(1) == "1" and guards.program("sh").endswith("sh") and guards.absolute("a") == os.path.abspath("a")
    for bad, error in (
        (lambda: guards.one_of(a=1, b=2), InvalidInputError), (lambda: guards.one_of(a=None), InvalidInputError), (lambda: guards.existing_input(spark, str(tmp_path / "no")), MissingInputError),
        (lambda: guards.written_output(spark, str(tmp_path / "no")), MissingOutputError), (lambda: guards.folder(spark, str(tmp_path / "no")), MissingDirectoryError),
        (lambda: guards.package("no_such_package"), MissingDependencyError), (lambda: guards.program("no_such_program"), MissingDependencyError),
        (lambda: pipeline.process_alignment_files(spark), InvalidInputError), (lambda: pipeline.process_alignment_files(spark, "a", "b"), InvalidInputError),
    ):
        with pytest.raises(error):
            bad()
    got = pipeline.process_alignment_files(spark, str(tmp_path / "x.sam"), genome=str(tmp_path / "g.fa")).first()
    assert (got.align_start, got.align_stop, got.derived_seq, got.align_score) == (2, 6, "ACGT", -1)


def test_one_pair_by_trees(spark):
    df = spark.createDataFrame([("ATCGGA", "TCCGAT", -3)], "probe_seq string, derived_seq string, align_score int")
    model = lambda f: f["align_score"] + f["probe_gc_percent"] + f["derived_CG"] + f["probe_GG"] + f["derived_len"]
    assert duplex.predict_trees(df, model).first().duplex_pred == pytest.approx(duplex.predict_one_by_trees(model, "ATCGGA", "TCCGAT", -3))
    assert duplex.default_temperature(None) == 42 and duplex.default_temperature(model) == 37
