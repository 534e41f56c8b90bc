"""Probe design from sequences to scores, as one lazy plan and as a chain of steps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybrispark import guards
from hybrispark.errors import PipelineStateError
from hybrispark.functions import thermo
from hybrispark.functions.seqfn import probe_id
from hybrispark.operators import annotation, appending, sam
from hybrispark.operators.alignment import NEAR, align
from hybrispark.operators.bases import MOST
from hybrispark.operators.duplex import default_temperature, predict_discriminant, predict_trees
from hybrispark.operators.kmers import add_max_kmer, build_kmer_index
from hybrispark.operators.mining import MiningConfig, config, mine, mine_pieces
from hybrispark.operators.own_places import align_mined
from hybrispark.operators.scoring import label_on_target, merge_alignments, score_probes
from hybrispark.session import written
from hybrispark.sources import files, sinks


def mine_candidates(sequences: DataFrame, id_col: str = "seq_id", seq_col: str = "seq", cfg: MiningConfig = MiningConfig()) -> DataFrame:
    """Mined probes with their key ``seqid``."""
    return mine(sequences, id_col, seq_col, cfg).withColumn("seqid", probe_id("seq_id", "start", "stop"))


def mine_fasta(spark: SparkSession, path: str, cfg: MiningConfig = MiningConfig()) -> DataFrame:
    """Probes of the records of a FASTA file with their key; no record is ever one row."""
    pieces = files.read_fasta_pieces(spark, path, cfg.chunk_size, cfg.max_length - 1)
    return mine_pieces(pieces, cfg).withColumn("seqid", probe_id("seq_id", "start", "stop"))


def align_candidates(probes: DataFrame, genome: DataFrame, preset="very-sensitive-local", k: int | None = 100, **settings) -> DataFrame:
    """Alignments of probes, one row for each probe and place, keyed by ``seqid``; settings are those of align()."""
    return _by_key(probes, align(probes, genome, "probe_seq", preset, k, **settings))


def _by_key(probes: DataFrame, found: DataFrame) -> DataFrame:
    """Alignments of probes' letters as those of the probes."""
    keys = probes.select("seqid", F.upper("probe_seq").alias("probe_seq"))
    return keys.join(found.hint("merge"), "probe_seq").drop("probe_seq")


def _merge_found(probes: DataFrame, found: DataFrame) -> DataFrame:
    """As merge_alignments() of _by_key(), in one join: each probe with the alignments of its letters."""
    kept = ["seqid", *(c for c in probes.columns if c != "seqid")]
    extra = [c for c in found.columns if c not in kept]
    letters = found.select(F.col("probe_seq").alias("__letters"), *extra).hint("merge")
    return probes.where("seqid IS NOT NULL").join(letters, F.upper("probe_seq") == F.col("__letters")).select(*kept, *extra)


@dataclass(frozen=True)
class Design:
    """The three tables of a design run."""

    probes: DataFrame
    merged: DataFrame
    scores: DataFrame


def design_probes(
    sequences: DataFrame,
    genome: DataFrame | None = None,
    cfg: MiningConfig = MiningConfig(),
    k: int = 18,
    max_alignments: int = 100,
    preset="very-sensitive-local",
    temperature: int | None = None,
    model=None,
    with_pdup: bool = False,
) -> Design:
    """Mine, count k-mers, align, predict and score.

    ``genome`` is what probes are aligned to and k-mers counted in, the
    sequences themselves by default.  Without a tree ``model`` the linear
    discriminant predicts.  Probes are mined at once and written to the shared
    checkpoint folder.
    """
    within, genome = genome is None, sequences if genome is None else genome
    # Written once: counting, aligning and merging would each mine again.
    probes = written(add_max_kmer(mine_candidates(sequences, cfg=cfg), build_kmer_index(genome, k=k, coded=k <= MOST), k, within=within))
    if within and not cfg.spaced and cfg.max_length <= NEAR:
        found = align_mined(genome, cfg, None, preset, max_alignments)
    else:
        found = align(probes, genome, "probe_seq", preset, max_alignments, longest=cfg.max_length)
    merged = _merge_found(probes, found)
    if with_pdup:
        merged = merged.withColumn("pdup", thermo.duplex_probability("probe_seq"))
    temperature = default_temperature(model) if temperature is None else temperature
    merged = predict_trees(merged, model, temperature) if model else predict_discriminant(merged, temperature)
    merged = label_on_target(merged)
    return Design(probes, merged, score_probes(merged))


@dataclass(frozen=True)
class ProbeSet:
    """Probes and what is known of them; every step gives a new set over lazy tables."""

    probes: DataFrame
    alignments: DataFrame | None = None
    merged: DataFrame | None = None
    scores: DataFrame | None = None
    labels: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if "seqid" not in self.probes.columns:
            object.__setattr__(self, "probes", self.probes.withColumn("seqid", probe_id("seq_id", "start", "stop")))

    @classmethod
    def from_sequences(cls, sequences: DataFrame, **settings) -> ProbeSet:
        return cls(mine_candidates(sequences, cfg=config(**settings)))

    @classmethod
    def from_fasta(cls, spark: SparkSession, path: str, **settings) -> ProbeSet:
        """Probes mined from the records of a FASTA file."""
        return cls(mine_fasta(spark, path, config(**settings)))

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str) -> ProbeSet:
        """Probes as to_csv() writes them."""
        return cls(files.read_probe_csv(spark, path))

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Sequence[tuple]) -> ProbeSet:
        """Probes from a few tuples (seq_id, start, stop, probe_seq, tm), none too."""
        return cls(spark.createDataFrame(list(rows), files.PROBE_SCHEMA))

    def _need(self, step: str) -> DataFrame:
        table = getattr(self, step)
        if table is None:
            raise PipelineStateError(f"no {step} yet")
        return table

    def align(self, genome: DataFrame, preset="very-sensitive-local", k: int | None = 100) -> ProbeSet:
        return replace(self, alignments=align_candidates(self.probes, genome, preset, k))

    def compute_max_kmer(self, index: DataFrame, k: int = 18) -> ProbeSet:
        return replace(self, probes=add_max_kmer(self.probes.drop("max_kmer"), index, k))

    def merge(self) -> ProbeSet:
        return replace(self, merged=merge_alignments(self.probes, self._need("alignments")))

    def compute_pdup(self, **settings) -> ProbeSet:
        return replace(self, merged=self._need("merged").withColumn("pdup", thermo.duplex_probability("probe_seq", **settings)))

    def compute_duplex_pred(self, temperature: int | None = None, model=None, normalize: bool = True) -> ProbeSet:
        """Predictions by trees at 37 degrees if there is a model of them, else by the discriminant at 42, unless told otherwise."""
        merged = self._need("merged")
        temperature = default_temperature(model) if temperature is None else temperature
        out = predict_trees(merged, model, temperature, normalize) if model else predict_discriminant(merged, temperature, normalize)
        return replace(self, merged=out)

    def score(self, pred_column: str = "duplex_pred") -> ProbeSet:
        merged = self._need("merged")
        if pred_column not in merged.columns:
            raise PipelineStateError(f"no {pred_column} yet")
        merged = label_on_target(merged)
        return replace(self, merged=merged, scores=score_probes(merged, pred_column))

    def append(self, sequences, scheme: str, label: str, **settings) -> ProbeSet:
        out = appending.append_sequences(self.probes, sequences, scheme, label=label, **settings)
        return replace(self, probes=out, labels=(*self.labels, label))

    def append_saber(self, sequences, label: str = "saber", scheme: str = "unique", **settings) -> ProbeSet:
        out = appending.append_saber(self.probes, sequences, scheme, label=label, **settings)
        return replace(self, probes=out, labels=(*self.labels, label))

    def append_barcodes(self, bridges, barcodes: Sequence[str], target: str, ordinal: str = "probe_ord") -> ProbeSet:
        return replace(self, probes=appending.append_barcodes(self.probes, bridges, barcodes, target, ordinal))

    def master_table(self, key: str = "seqid") -> DataFrame:
        return appending.appending_table(self.probes, key, self.labels)

    def write(self, path: str, fmt: str = "bed") -> None:
        sinks.write_probes(self.probes, path, fmt)

    def to_csv(self, path: str) -> None:
        """All columns, numbers with a point to two decimals."""
        sinks.write_probe_table(self.probes, path)

    def to_bed(self, path: str) -> None:
        sinks.write_probes(self.probes, path, "bed")

    def to_fastq(self, path: str) -> None:
        sinks.write_probes(self.probes, path, "fastq")

    def to_fasta(self, path: str, width: int | None = 60) -> None:
        """Bases under the probes' keys; of equal keys the last by place and bases."""
        rows = self.probes.select("seqid", "probe_seq", F.struct("seq_id", "start", "stop", "probe_seq").alias("__o"))
        sinks.write_fasta(sinks.last_by_key(rows, "seqid", "__o"), path, "seqid", "probe_seq", width)

    def rows(self) -> DataFrame:
        """The first five columns, as mining gives them."""
        return self.probes.select("seq_id", "start", "stop", "probe_seq", "tm")

    def save_align_csv(self, path: str) -> None:
        sinks.write_align_csv(self._need("alignments"), path)

    def load_align_csv(self, path: str) -> ProbeSet:
        """The set with alignments as save_align_csv() wrote them."""
        return replace(self, alignments=files.read_align_csv(self.probes.sparkSession, path))

    def save_merged_csv(self, path: str) -> None:
        sinks.write_align_csv(self._need("merged"), path)

    def count(self) -> int:
        return self.probes.count()

    def summary(self) -> str:
        """The numbers of probes, alignments and duplexes, which are counted for it."""
        n = [t.count() if t is not None else 0 for t in (self.probes, self.alignments, self.merged)]
        return f"ProbeSet(probes={n[0]}, alignments={n[1]}, duplexes={n[2]})"


def mine_exons(exons: DataFrame, genome: DataFrame, cfg: MiningConfig = MiningConfig()) -> DataFrame:
    """Probes of every distinct exon, keyed by its label."""
    return _mine_labelled(annotation.exon_sequences(exons, genome), cfg)


def mine_introns(exons: DataFrame, genome: DataFrame, cfg: MiningConfig = MiningConfig(), by: str = "transcript_id") -> DataFrame:
    return _mine_labelled(annotation.intron_sequences(exons, genome, by), cfg)


def mine_flattened(flat: DataFrame, genome: DataFrame, cfg: MiningConfig = MiningConfig(), gene_id: str | None = None) -> DataFrame:
    return _mine_labelled(annotation.flattened_sequences(flat, genome, gene_id), cfg)


def mine_spliced(exons: DataFrame, genome: DataFrame, cfg: MiningConfig = MiningConfig(), by: str = "transcript_id") -> DataFrame:
    """Probes of every spliced transcript, keyed by its id."""
    return mine_candidates(annotation.spliced_sequences(exons, genome, by), by, "sequence", cfg)


def _mine_labelled(labelled: DataFrame, cfg: MiningConfig) -> DataFrame:
    return mine_candidates(labelled, "label", "sequence", cfg)


def process_alignment_files(spark: SparkSession, sam_path: str | None = None, bam_path: str | None = None, genome: DataFrame | str | None = None, to_upper: bool = True) -> DataFrame:
    """The alignments of SAM or else of BAM files, with the bases of a genome if it is given as a table or FASTA path."""
    guards.one_of(sam_path=sam_path, bam_path=bam_path)
    path = guards.existing_input(spark, sam_path or bam_path)
    lines = files.read_sam(spark, path) if sam_path else files.read_bam(spark, path)
    return sam.process_alignments(lines, None if genome is None else files.as_sequences(spark, genome), to_upper)
