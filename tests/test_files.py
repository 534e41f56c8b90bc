import gzip
import struct

import pytest

from hybrispark.errors import ConfigurationError, EmptyExportError, MissingInputError
from hybrispark.sources import files, sinks
from hybrispark.streaming.live import mine_stream


def test_fasta_round_trip(spark, rows, tmp_path):
    text = ">a first\nACGT\nacgt\n\n>b\r\nNN\r\n>c\n"
    (tmp_path / "x.fa").write_text(text)
    df = files.read_fasta(spark, str(tmp_path / "x.fa"))
    assert [(r.seq_id, r.seq) for r in df.orderBy("file", "seq_ord").collect()] == [("a", "ACGTACGT"), ("b", "NN"), ("c", "")]
    sinks.write_fasta(df.where("seq <> ''"), str(tmp_path / "out"), width=3)
    again = files.read_fasta(spark, str(tmp_path / "out"))
    assert rows(again.select("seq_id", "seq")) == [("a", "ACGTACGT"), ("b", "NN")]
    assert [r.seq_id for r in files.chromosome_sizes(df).collect()] == ["a", "b", "c"]
    with pytest.raises(EmptyExportError):
        sinks.write_fasta(df.limit(0), str(tmp_path / "none"))


def test_gtf(spark, rows, tmp_path):
    lines = ["#head", 'c\tx\texon\t1\t9\t.\t+\t0\t"gene_id ""A"";"', "c\tx\texon\t2\t8\t.\t-\t.\tID=1 # note"]
    (tmp_path / "x.gtf").write_text("\n".join(lines))
    got = rows(files.read_gtf(spark, str(tmp_path / "x.gtf")).select("start", "attributes"))
    assert got == [(1, 'gene_id "A";'), (2, "ID=1 ")]


def test_probe_files(spark, tmp_path):
    df = spark.createDataFrame([("c", 1, 5, "ACGT", 42.0)], files.PROBE_SCHEMA)
    assert sinks.bed_lines(df).first().value == "c\t1\t5\tACGT\t42.00"
    assert sinks.fastq_lines(df).first().value == "@c:1-5\nACGT\n+\n~~~~"
    sinks.write_probes(df, str(tmp_path / "p"), "csv")
    assert files.read_probe_csv(spark, str(tmp_path / "p")).collect() == df.collect()
    with pytest.raises(ConfigurationError):
        sinks.write_probes(df, str(tmp_path / "q"), "xml")
    with pytest.raises(MissingInputError):
        files.read_probe_csv(spark, str(tmp_path / "none.csv"))


def test_bam(spark, tmp_path):
    name, cigar, seq = b"q\0", struct.pack("<I", 4 << 4), bytes([0x12, 0x48])
    body = struct.pack("<iiBBHHHiiii", 0, 9, len(name), 7, 0, 1, 16, 4, -1, -1, 0) + name + cigar + seq + bytes([30] * 4) + b"ASC\x05"
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 99) + struct.pack("<i", len(body)) + body
    (tmp_path / "x.bam").write_bytes(gzip.compress(raw))
    assert files.read_bam(spark, str(tmp_path / "x.bam")).first().value.split("\t") == ["q", "16", "c", "10", "7", "4M", "*", "0", "0", "ACGT", "????", "AS:i:5"]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "ATCG" * 13)], "seq_id string, seq string").write.parquet(src)
    stream = spark.readStream.schema("seq_id string, seq string").parquet(src)
    q = mine_stream(stream).writeStream.format("memory").queryName("mined").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("mined").count() == 16


def test_sql_functions(spark, rows):
    from hybrispark.functions import sql

    sql.register(spark)
    assert tuple(spark.sql("SELECT rev_comp('ACGN'), gc_content('gcAT'), gc_content(''), probe_key('c', 1, 5)").first()) == ("NCGT", 0.5, 0.0, "c:1-5")
    spark.createDataFrame([("a", "ATCG" * 13), ("b", None)], "seq_id string, seq string").createOrReplaceTempView("s")
    assert spark.sql("SELECT s.seq_id, m.* FROM s, LATERAL mine_probes(s.seq) m").count() == 16
