"""The read pipelines: extraction, site and block summaries, base imputation, clustering and typing."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.mods import decode_reads
from ..functions.motifs import Motif, occurrences, parse_motif, safe_label
from ..operators import calls as C
from ..operators import clustering as K
from ..operators import haplotypes as H
from ..operators import latent_classes as L
from ..sources import tables as T
from ..sources.alignments import BamStream, read_bam, sam_records, write_bam


def load_reads(spark: SparkSession, path: str, contigs: list[str] | None = None, fallback: str | None = None) -> DataFrame:
    if path.lower().endswith(".sam"):
        records = sam_records(spark, path)
        records = records.where(F.col("contig").isin(contigs)) if contigs else records
    else:
        records = read_bam(spark, path, **({"contigs": ",".join(contigs)} if contigs else {"mapped": "true"}))
    return decode_reads(records, load_fallback(spark, fallback) if fallback else None)


def load_fallback(spark: SparkSession, path: str) -> DataFrame:
    if T.fallback_format(path) == "fastq":
        return T.last_by_id(T.read_fastq(spark, path))
    return T.first_by_id(read_bam(spark, path).select(F.col("name").alias("read_id"), "read_ord", "seq", "qual"))


@dataclass
class Extraction:
    per_read: DataFrame
    aggregate: DataFrame
    summary: DataFrame


def extract(reads: DataFrame, motifs: list[Motif]) -> Extraction:
    """Matches with their calls, aggregates by read record and motif, and the motifs each read hits."""
    found = C.match_in_read(occurrences(reads.select("read_id", "read_ord", "contig", "strand", "seq", "calls", "ref_pos"), motifs))
    per_read = C.per_read_rows(found)
    aggregate = C.read_aggregate(per_read, ["read_ord", "read_id", "motif"])
    names = [m.raw for m in motifs]
    flags = per_read.where("methylated").groupBy("read_ord").agg(F.collect_set("motif").alias("held"))
    hits = F.array(*(F.coalesce(F.array_contains("held", n), F.lit(False)) for n in names))
    summary = reads.select("read_ord", "read_id", "contig", "seq", "qual").join(flags, "read_ord", "left").withColumn("hits", hits)
    return Extraction(per_read, aggregate, summary.withColumn("combo", C.combo_label(F.col("hits"), names)).drop("held"))


def write_extraction(e: Extraction, folder: str, motifs: list[Motif], summary: str | None = None, fastq: str | None = None) -> None:
    p = e.per_read
    T.write_tsv(
        p.orderBy("read_ord", "motif_idx", "motif_start").select(
            "read_id", F.coalesce("contig", F.lit(".")).alias("contig"), F.coalesce("strand", F.lit(".")).alias("strand"), "motif", "motif_start", "motif_position", "read_position",
            F.coalesce(F.col("ref_position").cast("string"), F.lit("NA")).alias("ref_position"), T.fixed(F.coalesce(F.col("probability"), F.lit(0.0)).cast("double")).alias("probability"),
            F.col("methylated").cast("int").alias("methylated"), "mod_label",
        ), f"{folder}/per_read.tsv",
    )
    a = C.quantile_columns(e.aggregate)
    T.write_tsv(
        a.orderBy("read_ord", "motif").select("read_id", "motif", "call_count", T.fixed(F.col("mean_probability")).alias("mean_probability"), *(T.fixed(F.col(f"quantile_{k}")).alias(f"quantile_{k}") for k in range(0, 101, 10))), f"{folder}/aggregate.tsv"
    )
    if summary:
        flags = [F.col("hits")[k].cast("int").alias(safe_label(m.raw)) for k, m in enumerate(motifs)]
        T.write_tsv(e.summary.orderBy("read_ord").select("read_id", F.coalesce("contig", F.lit(".")).alias("contig"), *flags), summary)
    if fastq:
        keyed = e.summary.withColumn("file_key", F.concat(F.lit("combo_"), F.regexp_replace("combo", "[^A-Za-z0-9]", "_")))
        T.write_fastq(keyed, fastq, "file_key", "combo", pad=False)


def site_table(reads: DataFrame, motifs: list[Motif], threshold: float = 0.5) -> DataFrame:
    """Site counts for VCF; the modified base counts from the motif's start on either strand."""
    found = C.match_in_read(occurrences(reads.select("read_id", "read_ord", "contig", "strand", "seq", "calls", "ref_pos"), motifs, strand_aware=False))
    known = found.where("c is not null and ref_position is not null and contig is not null").select("contig", "ref_position", "motif_idx", "c.methylated", "c.probability")
    return C.site_summary(known, ["contig", "ref_position", "motif_idx"], threshold)


def block_table(reads: DataFrame, motifs: list[Motif], size: int = 1000, threshold: float = 0.5) -> DataFrame:
    """States by block; a match without a call counts as unmethylated."""
    found = C.match_in_read(occurrences(reads.select("read_id", "read_ord", "contig", "strand", "seq", "calls", "ref_pos"), motifs, strand_aware=False))
    order = F.struct("read_ord", "motif_idx", "motif_start")
    return C.block_states(
        found.withColumn("methylated", F.coalesce("c.methylated", F.lit(False))).withColumn("probability", F.col("c.probability")).withColumn("call_ord", order), size, threshold
    )


def impute_bam(spark: SparkSession, path: str, output: str, motifs: list[Motif] | None = None, threshold: float = 0.8, contigs: list[str] | None = None, summary: str | None = None) -> DataFrame:
    """Writes the rewritten reads as BAM in their order and returns the changes. Bases are counted over the whole file.

    The changes are a table as well, at ``summary`` or beside the output.
    """
    records = read_bam(spark, path)
    reads = decode_reads(records)
    allowed = None
    if motifs is not None:
        allowed = occurrences(reads.select("read_ord", "strand", "seq"), motifs, strand_aware=False).select("read_ord", F.col("read_position").alias("position"), "label")
    new, changes = C.impute_bases(reads, allowed, threshold)
    if contigs:
        new, changes = new.where(F.col("contig").isin(contigs)), changes.where(F.col("contig").isin(contigs))
    rows = records.drop("seq", "qual").join(new.select("read_ord", F.when(F.col("seq") != "", F.col("seq")).alias("seq"), "qual"), "read_ord").orderBy("read_ord")
    text, header = BamStream(path).header()
    names = [c.split()[0] for c in "read_ord name flag contig start mapq cigar seq qual mm ml".split()]
    write_bam(output, header, (tuple(r[n] for n in names) for r in rows.toLocalIterator()), text)
    told = changes.orderBy("contig", "reference_pos", "read_id").select("contig", "reference_pos", "read_id", "old_base", "new_base", T.fixed(F.col("probability").cast("double")).alias("probability"))
    T.write_tsv(told, summary or os.path.splitext(output)[0] + ".summary.tsv")
    return changes


def write_longitudinal(states: DataFrame, motifs: list[Motif], size: int, folder: str) -> None:
    """A row for each block and pattern, the commonest pattern first, with the block's sites and statistics."""
    names = F.array(*(F.lit(m.raw) for m in motifs))
    sites = states.groupBy("contig", "block").agg(F.array_sort(F.collect_set(F.struct("ref_position", "motif_idx"))).alias("s"))
    shown = F.array_join(F.transform("s", lambda x: F.concat(x["ref_position"].cast("string"), F.lit(":"), F.element_at(names, x["motif_idx"] + 1))), ",")
    rows = C.longitudinal(states).join(sites.select("contig", "block", shown.alias("site_positions")), ["contig", "block"])
    known = F.col("total_reads")  # every read of a block has a state in it
    T.write_tsv(
        rows.orderBy("contig", "block", "pattern_rank").select(
            "contig", (F.col("block") * size).alias("block_start"), ((F.col("block") + 1) * size).alias("block_end"), F.col("n_sites").alias("site_count"), "pattern",
            F.col("n").alias("read_count"), "site_positions", "total_reads", known.alias("informative_reads"), (F.col("total_reads") - known).alias("uninformative_reads"),
            F.col("fully_methylated").alias("fully_methylated_reads"), F.col("fully_unmethylated").alias("fully_unmethylated_reads"), F.col("mixed").alias("mixed_reads"),
            T.fixed(F.col("mean_fraction")).alias("mean_methylation"), T.fixed(F.col("variance")).alias("methylation_variance"), T.fixed(F.col("polarization")).alias("polarization"),
        ), f"{folder}/longitudinal.tsv",
    )


@dataclass
class Split:
    extraction: Extraction
    raw: DataFrame
    dense: DataFrame
    labels: DataFrame
    kept: list[str]


def split_reads(reads: DataFrame, motifs: list[Motif], algorithm: str = "gmm", samples: int | None = None) -> Split:
    """Extraction, the matrix of motif means, its dense columns, imputed, and the reads' clusters."""
    e = extract(reads, motifs)
    names = list(dict.fromkeys(m.raw for m in motifs))
    raw = C.hit_reads(C.feature_matrix(e.aggregate, names)).persist()
    columns = {r["dim"]: r["kept"] for r in C.dense_columns(raw).collect()}
    kept = [k for k in range(len(names)) if columns.get(k)]
    if not kept:
        raise ValueError("no motif is known in half of the reads")
    raw = raw.select("read_id", F.array(*(F.col("features")[k] for k in kept)).alias("features"))
    dense = K.impute_rows(raw).persist()
    return Split(e, raw, dense, K.cluster_rows(dense, algorithm, samples), [names[k] for k in kept])


def write_split(s: Split, folder: str, reads: DataFrame, bam: str | None = None, fastq: bool = False) -> None:
    for name, rows in (("read_clustering", s.dense), ("read_clustering_raw", s.raw)):
        cells = [T.fixed(F.col("features")[k]).alias(safe_label(m)) for k, m in enumerate(s.kept)]
        T.write_tsv(rows.join(s.labels, "read_id").orderBy("read_id").select("read_id", "cluster_id", *cells), f"{folder}/{name}.tsv")
    wide = C.F.map_from_entries(F.collect_list(F.struct("dim", "centroid")))
    summary = K.centroids(s.dense, s.labels).groupBy("cluster_id").agg(F.max("read_count").alias("read_count"), wide.alias("m")).orderBy("cluster_id")
    T.write_tsv(summary.select("cluster_id", "read_count", *(T.fixed(F.col("m")[k]).alias(f"centroid_{safe_label(x)}") for k, x in enumerate(s.kept))), f"{folder}/cluster_summary.tsv")
    key = F.when(F.col("cluster_id") < 0, "cluster_noise").otherwise(F.concat(F.lit("cluster_"), "cluster_id"))
    if fastq:
        T.write_fastq(T.first_by_id(reads.select("read_id", "read_ord", "seq", "qual")).join(s.labels, "read_id").withColumn("cluster", key), f"{folder}/cluster_fastq", "cluster")
    elif bam:
        # every record of the file whose name was clustered, in file order; a pass for each cluster
        os.makedirs(f"{folder}/cluster_bam", exist_ok=True)
        text, header = BamStream(bam).header()
        records = read_bam(reads.sparkSession, bam).join(s.labels.withColumnRenamed("read_id", "name").withColumn("cluster", key), "name").persist()
        for (cluster,) in records.select("cluster").distinct().collect():
            own = records.where(F.col("cluster") == cluster).orderBy("read_ord").drop("cluster", "cluster_id")
            names = ["read_ord", "name", "flag", "contig", "start", "mapq", "cigar", "seq", "qual", "mm", "ml"]
            write_bam(f"{folder}/cluster_bam/{cluster}.bam", header, (tuple(r[n] for n in names) for r in own.toLocalIterator()), text)


def contigs_to_run(b: T.Bin | None, asked: list[str]) -> list[str] | None:
    """The contigs of a run: a bin's own, or those of it that are asked for; None where there are none, and then nothing runs."""
    if b is None:
        return list(asked)
    found = [c for c in asked if c in b.contigs] if asked else list(b.contigs)
    return found or None


def bin_path(path: str, b: T.Bin | None, folder: bool) -> str:
    """A bin's place for an output: a folder below a folder; a file's name gets the bin's name before its ending."""
    if b is None:
        return path
    if folder:
        return os.path.join(path, b.safe_name)
    parent, name = os.path.split(path)
    stem, dot, ending = name.rpartition(".")
    if not dot:
        return os.path.join(parent, f"{name}.{b.safe_name}" if name else b.safe_name)
    return os.path.join(parent, f"{stem}.{b.safe_name}.{ending}" if stem else f"{b.safe_name}.{ending}")


def load_motifs(given: list[str], path: str | None, b: T.Bin | None = None) -> list[Motif]:
    """Motifs as given, then those of the file; of a file with bins only the bin's rows, by its name or the safe one."""
    motifs = [parse_motif(x) for x in given]
    if path:
        motifs += T.read_motif_file(path, None if b is None else {b.name, b.safe_name})
    if not motifs:
        raise ValueError("no motifs provided; use --motif or --motif-file")
    return motifs


def run_bins(bins: str | None, asked: list[str], work) -> list[str]:
    """Calls ``work`` with each bin (None without bins) and its contigs; a contig of two bins is read for both. Returns the bins left out."""
    left = []
    for b in T.read_bins(bins) if bins else [None]:
        contigs = contigs_to_run(b, asked)
        if contigs is None:
            left.append(b.name)
        else:
            work(b, contigs)
    return left


def mod_errors(reads: DataFrame, shown: int = 5) -> tuple[int, list[str]]:
    """How many reads have tags that can't be parsed, and what is wrong with the first of them."""
    bad = reads.where("mod_error is not null")
    return bad.count(), [f"{r['read_id']}: {r['mod_error']}" for r in bad.orderBy("read_ord").limit(shown).select("read_id", "mod_error").collect()]


def phase_variants(spark: SparkSession, bam: str, motifs: list[Motif], folder: str, haplotypes: str | None, lowest: int = 1, highest: int = 10, criterion: str = "icl", multiplier: float = 2.0, folds: int = 5, least_weight: float = 0.0, fallback: str | None = None, sep: str = "\t", **how) -> dict:
    """Clusters the reads, merges their features with haplotype segments, and fits and selects latent classes.

    Every class count's model and responsibilities go to ``fits``; the best ones, the assignments, the data as fitted and
    imputed, and a summary beside it. Without haplotype categories a pseudo category stands in.
    """
    if lowest < 1 or highest < lowest:
        raise ValueError("class counts must be 1 or more, the least not above the most")
    reads = load_reads(spark, bam, fallback=fallback).persist()
    split = split_reads(reads, motifs)
    write_split(split, f"{folder}/split_reads", reads, bam if bam.lower().endswith(".bam") else None)
    # features are taken as written, with four decimals
    features = split.raw.select(F.col("read_id").alias("id"), F.transform("features", lambda v: F.bround(v, 4)).alias("meth"))
    haps, levels, names, labels = typing_categories(spark, haplotypes) if haplotypes else (spark.createDataFrame([], "row_ord long, id string, cats array<int>"), [], [], [])
    data = H.outer_merge(haps, features, len(levels), len(split.kept)).persist()
    os.makedirs(f"{folder}/fits", exist_ok=True)
    fits: list[dict] = []

    def keep(c: int, fitted: L.Fit, score: float, own: list[int]) -> None:
        model, resp = f"model_C{c}.json", f"responsibilities_C{c}.tsv"
        write_model(f"{folder}/fits/{model}", fitted.params, names or ["pseudo_hap"], own, split.kept)
        write_responsibilities(fitted.responsibilities, fitted.params.classes, f"{folder}/fits/{resp}")
        fits.append({"classes": c, "log_likelihood": fitted.ll, "score": score, "model_path": model, "responsibilities_path": resp})

    best, fitted, scores = L.select_best(data, lowest, highest, levels, len(split.kept), criterion, multiplier, folds, least_weight, each=keep, **how)
    if not levels:
        data, levels = L.pseudo_category(data, best)
        names = ["pseudo_hap"]
    write_model(f"{folder}/best_model.json", fitted.params, names, levels, split.kept)
    resp = fitted.responsibilities.persist()
    write_responsibilities(resp, fitted.params.classes, f"{folder}/best_responsibilities.tsv")
    T.write_tsv(L.map_assignments(resp).select("id", "assigned_class", T.fixed(F.col("max_probability"), 6).alias("max_probability")), f"{folder}/map_assignments.tsv")
    T.write_categories(f"{folder}/categories.toml", names, levels, split.kept)
    write_dataset(data, f"{folder}/dataset.tsv", names, split.kept, sep)
    imputed = L.impute(data, fitted.params)
    write_dataset(imputed, f"{folder}/imputed.tsv", names, split.kept, sep)
    write_imputed_labels(imputed, resp, fitted.params.classes, labels, names, split.kept, f"{folder}/imputed_labels.tsv", sep)
    for held in (resp, data, reads, split.raw, split.dense):
        held.unpersist()
    told = {"min_classes": lowest, "max_classes": highest, "criterion": criterion, "best_classes": best, "best_score": dict(scores)[best], "fits": fits}
    with open(f"{folder}/summary.json", "w", encoding="utf-8") as f:
        json.dump(told, f, indent=2)
    return told


def typing_categories(spark: SparkSession, path: str) -> tuple[DataFrame, list[int], list[str], list[list[str]]]:
    """Haplotype blocks as categories: the rows, and each category's levels, name and labels of its levels."""
    blocks, entries = T.read_haplotypes(path)
    b = spark.createDataFrame(blocks, "block_ord int, hap int, snp_start long, snp_end long")
    e = spark.createDataFrame(entries, "block_ord int, entry_ord int, id string, start long, end long")
    covering = H.covering_blocks(b)
    label = F.struct("level", F.concat(F.lit("HAP"), F.col("hap")).alias("label"))
    named = covering.join(b.select("block_ord", "hap"), "block_ord").groupBy("seg_start", "seg_end").agg(F.array_sort(F.collect_list(label)).alias("l")).orderBy("seg_start").collect()
    return H.hap_dataset(e, covering), [len(r["l"]) for r in named], [f"hap_{r[0]}_{r[1]}" for r in named], [[x["label"] for x in r["l"]] for r in named]


def write_model(path: str, p: L.Params, names: list[str], levels: list[int], methylation: list[str]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"params": json.loads(p.to_json()), "category_names": names, "levels": levels, "methylation_names": methylation}, f, indent=2)


def read_model(path: str) -> tuple[L.Params, dict]:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    return L.Params(**told["params"]), told


def write_responsibilities(resp: DataFrame, classes: int, path: str) -> None:
    T.write_tsv(resp.orderBy("row_ord").select("id", *(T.fixed(F.col("resp")[c], 6).alias(f"class_{c}") for c in range(classes))), path)


def write_imputed_labels(imputed: DataFrame, resp: DataFrame, classes: int, labels: list[list[str]], names: list[str], methylation: list[str], path: str, sep: str = "\t") -> None:
    """Imputed rows by label, with the classes' responsibilities and the likeliest class."""
    rows = imputed.join(resp.select("row_ord", "resp"), "row_ord")
    shown = lambda k: F.coalesce(F.try_element_at(F.array(*map(F.lit, labels[k])), F.col("cats")[k] + 1) if k < len(labels) else F.lit(None), F.col("cats")[k].cast("string"), F.lit("NA"))
    T.write_tsv(
        rows.orderBy("row_ord").select(
            "id", *(shown(k).alias(n) for k, n in enumerate(names)), *(T.fixed(F.col("meth")[k], 6).alias(safe_label(m)) for k, m in enumerate(methylation)),
            *(T.fixed(F.col("resp")[c], 6).alias(f"resp_class_{c}") for c in range(classes)), L.argmax_first(F.col("resp")).alias("assigned_class"),
        ), path, sep,
    )


def missing_counts(rows: DataFrame, n_categories: int, n_features: int) -> dict:
    """Rows, and missing cells of all categories and of all features."""
    lacking = lambda c, n: F.coalesce(F.sum(sum((F.col(c)[k].isNull().cast("long") for k in range(n)), F.lit(0).cast("long"))), F.lit(0))
    n, cats, meth = rows.agg(F.count("*"), lacking("cats", n_categories), lacking("meth", n_features)).first()
    return {"rows": n, "missing_categories": cats, "cells_categories": n * n_categories, "missing_features": meth, "cells_features": n * n_features}


def write_dataset(rows: DataFrame, path: str, names: list[str], methylation: list[str], sep: str = "\t") -> None:
    cats = [F.coalesce(F.col("cats")[k].cast("string"), F.lit("NA")).alias(n) for k, n in enumerate(names)]
    T.write_tsv(rows.orderBy("row_ord").select("id", *cats, *(T.fixed(F.col("meth")[k], 6).alias(safe_label(m)) for k, m in enumerate(methylation))), path, sep)


def split_fastq(reads: DataFrame, assigned: DataFrame, folder: str) -> None:
    """Reads in a folder for each class; those without class go to class_unknown, which always exists."""
    keyed = reads.join(assigned.withColumnRenamed("id", "read_id"), "read_id", "left")
    T.write_fastq(keyed.withColumn("class", F.concat(F.lit("class_"), F.coalesce(F.col("assigned_class").cast("string"), F.lit("unknown")))), folder, "class")
    os.makedirs(f"{folder}/class=class_unknown", exist_ok=True)


def read_ids(reads: DataFrame, limit: int | None = None) -> DataFrame:
    """Read ids by contig in file order, at most ``limit`` of each; a limit of 0 still gives one."""
    rows = reads.where("contig is not null").withColumn("k", F.row_number().over(Window.partitionBy("contig").orderBy("read_ord")))
    return (rows if limit is None else rows.where(F.col("k") <= max(1, limit))).select("contig", "k", "read_id")


def list_contigs(present: DataFrame, wanted: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Contigs of the header, or of those asked for the present ones; and the absent ones."""
    if not wanted:
        return present.orderBy("contig_ord"), []
    asked = present.sparkSession.createDataFrame(list(enumerate(wanted)), "ord int, contig string")
    return asked.join(present.dropDuplicates(["contig"]), "contig").orderBy("ord"), [r[1] for r in asked.join(present, "contig", "left_anti").select("ord", "contig").orderBy("ord").collect()]
