"""Command line: ``python -m modweave.cli`` and a command; ``--help`` names its options."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import haplotypes as H
from .operators import latent_classes as L
from .plans import extract as E
from .plans.vcf import write_vcf
from .sources import tables as T
from .sources.alignments import BamStream


def session() -> SparkSession:
    return SparkSession.builder.appName("modweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _list(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def _joined(parts: list[list[str]] | None) -> list[str]:
    return [x for p in parts or [] for x in p]


def _select(p: argparse.ArgumentParser) -> None:
    p.add_argument("-c", "--contig", action="append", type=_list, dest="contigs", help="only these contigs")
    p.add_argument("--contig-bins", help="table of contig and bin; each bin is a run of its own")


def _motifs(p: argparse.ArgumentParser, fallback: bool = True) -> None:
    p.add_argument("-m", "--motif", nargs="+", type=_list, dest="motifs", help="MOTIF_label_index, from 0")
    p.add_argument("--motif-file", help="table with motif, mod_type, mod_position")
    if fallback:
        p.add_argument("--sequence-fallback", help="FASTQ or BAM with the sequences of reads that lack one")
        p.add_argument("--sequence-index", help="taken for compatibility; sequences are joined by id and need no index")


def _em(p: argparse.ArgumentParser) -> None:
    for name, kind, default in (("alpha-pi", float, 1.0), ("alpha-phi", float, 1.0), ("max-iter", int, 100), ("tol", float, 1e-6), ("min-class-weight", float, 0.0)):
        p.add_argument(f"--{name}", type=kind, default=default)


def _choice(p: argparse.ArgumentParser) -> None:
    p.add_argument("--criterion", choices=["bic", "icl", "cv"], default="icl")
    p.add_argument("--penalty-multiplier", type=float, default=2.0)
    p.add_argument("--cv-folds", type=int, default=5)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="modweave", description="Base modification calls of long reads: extraction, clustering and typing on Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    def add(to, name: str, work, about: str, bam: bool = True) -> argparse.ArgumentParser:
        p = to.add_parser(name, help=about, description=about)
        p.set_defaults(work=work)
        if bam:
            p.add_argument("bam")
        return p

    p = add(commands, "extract", extract, "modification calls at motifs, by read, and their aggregates")
    _motifs(p)
    p.add_argument("--motif-summary-tsv", help="which motifs each read hits")
    p.add_argument("--fastq-dir", help="reads by the motifs they hit")
    p.add_argument("--output-dir", required=True)
    _select(p)

    p = add(commands, "split-reads", split_reads, "clusters reads by their motifs' methylation and splits them")
    _motifs(p)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--min-cluster-size", type=int, default=5)
    p.add_argument("--min-samples", type=int)
    p.add_argument("--emit-fastq", action="store_true")
    p.add_argument("--threads", type=int, default=1, help="taken for compatibility; Spark sets the parallelism")
    p.add_argument("--cluster-algorithm", choices=["hdbscan", "gmm", "agglomerative"], default="gmm")
    _select(p)

    p = add(commands, "phase-variants", phase_variants, "clusters reads and fits latent classes of haplotypes and methylation", False)
    p.add_argument("--floria", required=True, dest="haplotypes", metavar="PATH|skip", help="haplotype blocks, or skip")
    p.add_argument("--bam", required=True)
    _motifs(p)
    p.add_argument("--min-classes", type=int, default=1)
    p.add_argument("--max-classes", type=int, default=10)
    p.add_argument("-o", "--out", required=True)
    _em(p)
    _choice(p)
    p.add_argument("--delimiter", default="\t")

    typing = commands.add_parser("typing", help="latent-class models of tables").add_subparsers(dest="typing", required=True)
    for name, work, about in (("fit", typing_fit, "fits one class count"), ("select-best-c", typing_select, "fits several class counts and keeps the best")):
        p = add(typing, name, work, about, False)
        p.add_argument("--data", required=True)
        p.add_argument("--config", required=True)
        if name == "fit":
            p.add_argument("--classes", type=int, required=True)
            p.add_argument("--output-responsibilities")
        else:
            p.add_argument("--min-classes", type=int, required=True)
            p.add_argument("--max-classes", type=int, required=True)
            _choice(p)
        _em(p)
        p.add_argument("--delimiter", default="\t")
        p.add_argument("--output-model", required=True)
    p = add(typing, "impute", typing_impute, "fills missing categories by a model", False)
    for name in ("data", "config", "model", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--delimiter", default="\t")
    p = add(typing, "convert-floria", typing_convert, "haplotype blocks, and features, as a typing table", False)
    p.add_argument("--floria", required=True, dest="haplotypes")
    p.add_argument("--methylation")
    p.add_argument("--output-data", required=True)
    p.add_argument("--output-config", required=True)
    p.add_argument("--delimiter", default="\t")
    p = add(typing, "split-fastq", typing_split, "reads in a folder for each class", False)
    p.add_argument("--fastq", required=True)
    p.add_argument("--assignments", required=True)
    p.add_argument("-o", "--out", required=True)
    p.add_argument("--delimiter", default="\t")

    utils = commands.add_parser("utils", help="listings and summaries").add_subparsers(dest="utils", required=True)
    _select(add(utils, "contigs", contigs, "contigs of the file"))
    p = add(utils, "reads", reads, "read ids by contig")
    p.add_argument("--limit", type=int)
    _select(p)
    p = add(utils, "vcf", vcf, "motif sites as VCF")
    _motifs(p)
    p.add_argument("--output", required=True)
    p.add_argument("--sample-name", default="sample")
    p.add_argument("--methylation-threshold", type=float, default=0.5)
    p.add_argument("--plain-output", action="store_true")
    _select(p)
    p = add(utils, "impute-bam", impute_bam, "methylated bases written into the reads")
    p.add_argument("--output", required=True)
    p.add_argument("--methylation-threshold", type=float, default=0.8)
    p.add_argument("--summary")
    _motifs(p, False)
    p.add_argument("--impute-all", action="store_true")
    _select(p)
    p = add(utils, "longitudinal", longitudinal, "agreement of reads along contigs, by block")
    _motifs(p)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--block-size", type=int, default=1000)
    p.add_argument("--methylation-threshold", type=float, default=0.5)
    _select(p)
    return top


def _bins(a, spark: SparkSession, work) -> None:
    """Runs ``work(bin, reads)`` for each bin."""

    def run(b, names):
        rows = E.load_reads(spark, a.bam, names or None, a.sequence_fallback).persist()
        bad, told = E.mod_errors(rows)
        for line in told:
            print(line, file=sys.stderr)
        if bad:
            print(f"{bad} reads have modification tags that can't be read", file=sys.stderr)
        work(b, rows)
        rows.unpersist()

    for name in E.run_bins(a.contig_bins, _joined(a.contigs), run):
        print(f"bin {name} has none of the contigs and is left out", file=sys.stderr)


def extract(a, spark: SparkSession) -> None:
    def run(b, rows):
        motifs = E.load_motifs(_joined(a.motifs), a.motif_file, b)
        summary, fastq = (x and E.bin_path(x, b, folder) for x, folder in ((a.motif_summary_tsv, False), (a.fastq_dir, True)))
        E.write_extraction(E.extract(rows, motifs), E.bin_path(a.output_dir, b, True), motifs, summary, fastq)

    _bins(a, spark, run)


def split_reads(a, spark: SparkSession) -> None:
    if a.min_cluster_size < 1 or (a.min_samples is not None and a.min_samples < 1):
        raise ValueError("cluster size and samples must be 1 or more")

    def run(b, rows):
        motifs, folder = E.load_motifs(_joined(a.motifs), a.motif_file, b), E.bin_path(a.output_dir, b, True)
        split = E.split_reads(rows, motifs, a.cluster_algorithm, a.min_samples)
        E.write_extraction(split.extraction, folder, motifs)
        E.write_split(split, folder, rows, None if a.emit_fastq or not a.bam.lower().endswith(".bam") else a.bam, a.emit_fastq)

    _bins(a, spark, run)


def phase_variants(a, spark: SparkSession) -> None:
    E.phase_variants(
        spark, a.bam, E.load_motifs(_joined(a.motifs), a.motif_file), a.out, None if a.haplotypes == "skip" else a.haplotypes, a.min_classes, a.max_classes, a.criterion,
        a.penalty_multiplier, a.cv_folds, a.min_class_weight, fallback=a.sequence_fallback, sep=a.delimiter, **_how(a),
    )


def _how(a) -> dict:
    if not 0 <= a.min_class_weight < 1:
        raise ValueError("min-class-weight must be 0 or more and below 1")
    if min(a.alpha_pi, a.alpha_phi) <= 0:
        raise ValueError("priors must be above 0")
    return {"priors": L.Priors(a.alpha_pi, a.alpha_phi), "iterations": a.max_iter, "tolerance": a.tol}


def _typed(a, spark: SparkSession):
    told = T.read_categories(a.config)
    rows = T.read_dataset(spark, a.data, len(told["names"]), a.delimiter)
    for k, (name, n) in enumerate(zip(told["names"], told["levels"])):
        if rows.where((F.col("cats")[k] < 0) | (F.col("cats")[k] >= n)).limit(1).count():
            raise ValueError(f"{a.data}: a level of {name} is outside 0 to {n - 1}")
    return told, rows.withColumn("meth", F.array().cast("array<double>"))


def typing_fit(a, spark: SparkSession) -> None:
    told, rows = _typed(a, spark)
    if a.classes < 1:
        raise ValueError("classes must be 1 or more")
    fitted = L.fit(rows, a.classes, told["levels"], 0, **_how(a))
    if a.min_class_weight > 0:
        fitted = L.prune(fitted, a.min_class_weight)
    E.write_model(a.output_model, fitted.params, told["names"], told["levels"], [])
    if a.output_responsibilities:
        E.write_responsibilities(fitted.responsibilities, fitted.params.classes, a.output_responsibilities)
    print(f"log-likelihood {fitted.ll:.4f} after {fitted.iterations} iterations")


def typing_select(a, spark: SparkSession) -> None:
    told, rows = _typed(a, spark)
    if a.min_classes < 1 or a.max_classes < a.min_classes:
        raise ValueError("class counts must be 1 or more, the least not above the most")
    best, fitted, scores = L.select_best(rows, a.min_classes, a.max_classes, told["levels"], 0, a.criterion, a.penalty_multiplier, a.cv_folds, a.min_class_weight, **_how(a))
    E.write_model(a.output_model, fitted.params, told["names"], told["levels"], [])
    for c, s in scores:
        print(f"{c}\t{a.criterion}\t{s:.4f}" + ("\tbest" if c == best else ""))


def typing_impute(a, spark: SparkSession) -> None:
    told, rows = _typed(a, spark)
    p, model = E.read_model(a.model)
    if model["levels"] != told["levels"]:
        raise ValueError(f"{a.model} was fitted to levels {model['levels']}, not {told['levels']}")
    E.write_dataset(L.impute(rows, p), a.output, told["names"], [], a.delimiter)


def typing_convert(a, spark: SparkSession) -> None:
    rows, levels, names, _ = E.typing_categories(spark, a.haplotypes)
    kept: list[str] = []
    if a.methylation:
        with open(a.methylation, encoding="utf-8") as f:
            kept = f.readline().rstrip("\r\n").split(a.delimiter)[2:]
        rows = H.outer_merge(rows, T.read_features(spark, a.methylation, a.delimiter), len(names), len(kept))
    E.write_dataset(rows, a.output_data, names, kept, a.delimiter)
    T.write_categories(a.output_config, names, levels, kept)


def typing_split(a, spark: SparkSession) -> None:
    E.split_fastq(T.read_fastq(spark, a.fastq), T.read_assignments(spark, a.assignments, a.delimiter), a.out)


def contigs(a, spark: SparkSession) -> None:
    _, header = BamStream(a.bam).header()
    present = spark.createDataFrame([(k, c, n) for k, (c, n) in enumerate(header)], "contig_ord int, contig string, length long")

    def run(b, names):
        found, absent = E.list_contigs(present, names or None)
        for r in found.collect():
            print(f"{r['contig']}\t{r['length']}" + (f"\t{b.name}" if b else ""))
        for c in absent:
            print(f"{c} isn't in {a.bam}", file=sys.stderr)

    E.run_bins(a.contig_bins, _joined(a.contigs), run)


def reads(a, spark: SparkSession) -> None:
    def run(b, names):
        for r in E.read_ids(E.load_reads(spark, a.bam, names or None), a.limit).orderBy("contig", "k").toLocalIterator():
            print(f"{r['contig']}\t{r['read_id']}" + (f"\t{b.name}" if b else ""))

    E.run_bins(a.contig_bins, _joined(a.contigs), run)


def vcf(a, spark: SparkSession) -> None:
    def run(b, rows):
        motifs = E.load_motifs(_joined(a.motifs), a.motif_file, b)
        write_vcf(E.site_table(rows, motifs, a.methylation_threshold), motifs, E.bin_path(a.output, b, False), a.sample_name, a.plain_output)

    _bins(a, spark, run)


def impute_bam(a, spark: SparkSession) -> None:
    if a.impute_all and (a.motifs or a.motif_file):
        raise ValueError("--impute-all takes no motifs")

    def run(b, names):
        motifs = None if a.impute_all else E.load_motifs(_joined(a.motifs), a.motif_file, b)
        output, summary = E.bin_path(a.output, b, False), a.summary and E.bin_path(a.summary, b, False)
        done = E.impute_bam(spark, a.bam, output, motifs, a.methylation_threshold, names or None, summary)
        print(f"{done.count()} bases replaced in {output}", file=sys.stderr)

    E.run_bins(a.contig_bins, _joined(a.contigs), run)


def longitudinal(a, spark: SparkSession) -> None:
    if a.block_size < 1:
        raise ValueError("block-size must be 1 or more")

    def run(b, rows):
        motifs = E.load_motifs(_joined(a.motifs), a.motif_file, b)
        E.write_longitudinal(E.block_table(rows, motifs, a.block_size, a.methylation_threshold), motifs, a.block_size, E.bin_path(a.output_dir, b, True))

    _bins(a, spark, run)


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(given)
    for name in ("bam", "data", "config", "model", "fastq", "assignments", "motif_file", "contig_bins"):
        path = getattr(a, name, None)
        if path and "://" not in path and not os.path.exists(path):
            print(f"error: {path} doesn't exist", file=sys.stderr)
            return 1
    try:
        a.work(a, spark or session())
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
