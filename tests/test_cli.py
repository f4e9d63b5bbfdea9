"""The command line over small files, and what it writes."""

import csv
import glob
import json
import os

import pytest

from modweave.cli import main
from modweave.plans import extract as E
from modweave.sources import alignments as A
from modweave.sources import tables as T


def read(name, flag, contig, seq, mm, ml, order, start=1):
    return A.parse_sam_line("\t".join(map(str, (name, flag, contig, start, 60, f"{len(seq)}M", "*", 0, 0, seq, "I" * len(seq), f"MM:Z:{mm}", "ML:B:C," + ",".join(map(str, ml))))), order)


@pytest.fixture(scope="module")
def bam(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cli") / "in.bam")
    rows = [read("read0", 0, "ctg", "GATC", "A+a,0;", [200], 0), read("read1", 0, "ctg", "GATC", "A+a,0;", [20], 1), read("read2", 0, "other", "GATCGATC", "A+a,0,0;", [250, 240], 2), read("bad", 0, "ctg", "GATC", "A+a,9;", [1], 3)]
    A.write_bam(path, [("ctg", 50), ("other", 60)], iter(rows))
    return path


def table(path):
    lines = [line for f in sorted(glob.glob(f"{path}/part-*")) for line in list(csv.reader(open(f), delimiter="\t"))]
    return [lines[0], *(x for x in lines[1:] if x != lines[0])] if lines else []


def test_extract_and_bins(spark, bam, tmp_path, capsys):
    bins, motifs, out = tmp_path / "bins.tsv", tmp_path / "motifs.tsv", tmp_path / "out"
    bins.write_text("contig\tbin\nctg\tbin A\nother\tbinB\nctg\tbinB\nnone\tempty\n")
    motifs.write_text("motif\tmod_type\tmod_position\tbin\nGATC\t6mA\t1\tbin A\nCGAT\ta\t2\tbinB\nGGGG\ta\t1\tempty\n")
    assert main(["extract", bam, "--motif-file", str(motifs), "--contig-bins", str(bins), "-c", "ctg,other", "--output-dir", str(out), "--motif-summary-tsv", str(tmp_path / "hits.tsv")], spark) == 0
    rows = table(out / "bin_A" / "per_read.tsv")
    assert rows[0][0] == "read_id" and [r[0] for r in rows[1:]] == ["read0", "read1"] and rows[1][8] == "0.7843"
    assert [r[0] for r in table(out / "binB" / "per_read.tsv")[1:]] == ["read2"] and not (out / "empty").exists()
    assert table(tmp_path / "hits.bin_A.tsv")[0] == ["read_id", "contig", "GATC_6mA_1"]
    told = capsys.readouterr().err
    assert "1 reads have modification tags" in told and "bad: canonical index" in told and "bin empty" in told
    # inline motifs come before those of the file
    assert [m.raw for m in E.load_motifs(["AC_5mC_1"], str(motifs), T.Bin("bin A", "bin_A"))] == ["AC_5mC_1", "GATC_6mA_1"]
    assert main(["extract", bam, "--output-dir", str(out)], spark) == 1 and "no motifs" in capsys.readouterr().err
    assert main(["extract", str(tmp_path / "absent.bam"), "-m", "GATC_6mA_1", "--output-dir", str(out)], spark) == 1


def test_bin_paths():
    b = T.Bin("x y", "x_y")
    assert [E.bin_path(p, b, False) for p in ("a/o.vcf.gz", "o", ".vcf", "a/")] == ["a/o.vcf.x_y.gz", "o.x_y", "x_y.vcf", "a/x_y"]
    assert E.bin_path("a/o", b, True) == "a/o/x_y" and E.bin_path("a/o", None, True) == "a/o"
    assert E.contigs_to_run(T.Bin("x", "x", ["a", "b"]), ["c", "b"]) == ["b"] and E.contigs_to_run(T.Bin("x", "x", ["a"]), ["c"]) is None and E.contigs_to_run(None, []) == []


def test_utils(spark, bam, tmp_path, capsys):
    assert main(["utils", "contigs", bam, "-c", "other,none"], spark) == 0
    shown = capsys.readouterr()
    assert shown.out == "other\t60\n" and "none isn't in" in shown.err
    assert main(["utils", "reads", bam, "--limit", "1"], spark) == 0 and capsys.readouterr().out == "ctg\tread0\nother\tread2\n"
    assert main(["utils", "vcf", bam, "-m", "GATC_6mA_1", "-c", "ctg", "--output", str(tmp_path / "o.vcf"), "--plain-output", "--sample-name", "me"], spark) == 0
    lines = (tmp_path / "o.vcf").read_text().splitlines()
    assert lines[-2].endswith("FORMAT\tme") and lines[-1].split("\t")[:5] == ["ctg", "2", ".", "A", "<6mA>"] and lines[-1].endswith("2:1:1:0.5000:0.7843")
    assert main(["utils", "impute-bam", bam, "--impute-all", "--output", str(tmp_path / "o.bam"), "-c", "ctg"], spark) == 0
    assert table(tmp_path / "o.summary.tsv")[0] == ["contig", "reference_pos", "read_id", "old_base", "new_base", "probability"]
    assert main(["utils", "impute-bam", bam, "--impute-all", "-m", "GATC_6mA_1", "--output", str(tmp_path / "x.bam")], spark) == 1
    assert main(["utils", "longitudinal", bam, "-m", "GATC_6mA_1", "--block-size", "4", "--output-dir", str(tmp_path / "l")], spark) == 0
    rows = table(tmp_path / "l" / "longitudinal.tsv")
    assert rows[0][:7] == ["contig", "block_start", "block_end", "site_count", "pattern", "read_count", "site_positions"] and len(rows[0]) == 16
    # a match without a call counts as unmethylated
    assert ["ctg", "0", "4", "1", "U", "2", "2:GATC_6mA_1", "3", "3", "0", "1", "2", "0", "0.3333", "0.2222", "1.0000"] in rows
    assert [r[:7] for r in rows if r[0] == "other"] == [["other", "0", "4", "1", "M", "1", "2:GATC_6mA_1"], ["other", "4", "8", "1", "M", "1", "6:GATC_6mA_1"]]


def test_typing(spark, tmp_path, capsys):
    data, config, fq = tmp_path / "d.tsv", tmp_path / "c.toml", tmp_path / "r.fastq"
    data.write_text("id\tx\ty\n" + "".join(f"r{k}\t{k % 2 if k else 'NA'}\t{k % 2}\n" for k in range(20)))
    config.write_text('methylation_names = []\n[categories]\nnames = ["x", "y"]\nlevels = [2, 2]\n')
    base = ["--data", str(data), "--config", str(config)]
    model, resp = str(tmp_path / "m.json"), str(tmp_path / "resp.tsv")
    assert main(["typing", "fit", *base, "--classes", "2", "--output-model", model, "--output-responsibilities", resp], spark) == 0
    assert "log-likelihood" in capsys.readouterr().out and len(table(resp)) == 21 and json.load(open(model))["levels"] == [2, 2]
    assert main(["typing", "impute", *base, "--model", model, "--output", str(tmp_path / "i.tsv")], spark) == 0
    assert table(tmp_path / "i.tsv")[1] == ["r0", "0", "0"]
    assert main(["typing", "select-best-c", *base, "--min-classes", "1", "--max-classes", "2", "--criterion", "bic", "--output-model", model], spark) == 0
    assert capsys.readouterr().out.count("best") == 1
    assert main(["typing", "fit", *base, "--classes", "0", "--output-model", model], spark) == 1
    haps = tmp_path / "h"
    haps.write_text(">HAP0\tx SNPRANGE:1-4\nr1 1 4\nr2 1 2\n>HAP1\tx SNPRANGE:1-2\nr3 1 2\n>HAP2\tx SNPRANGE:3-6\nr4 3 6\n")
    assert main(["typing", "convert-floria", "--floria", str(haps), "--output-data", str(tmp_path / "o.tsv"), "--output-config", str(tmp_path / "o.toml")], spark) == 0
    assert table(tmp_path / "o.tsv") == [["id", "hap_1_2", "hap_3_4"], ["r1", "0", "0"], ["r2", "0", "NA"], ["r3", "1", "NA"], ["r4", "NA", "1"]]
    assert T.read_categories(str(tmp_path / "o.toml"))["levels"] == [2, 2]
    fq.write_text("@r1 x\nAC\n+\nII\n@r9\nGT\n+\nII\n")
    (tmp_path / "a.tsv").write_text("id\tassigned_class\nr1\t3\n")
    assert main(["typing", "split-fastq", "--fastq", str(fq), "--assignments", str(tmp_path / "a.tsv"), "-o", str(tmp_path / "s")], spark) == 0
    assert sorted(os.listdir(tmp_path / "s"))[-2:] == ["class=class_3", "class=class_unknown"]


def test_phase_variants_with_haplotypes(spark, tmp_path):
    bam, haps, out = str(tmp_path / "p.bam"), tmp_path / "h", tmp_path / "out"
    rows = [read(f"r{k}", 0, "ctg", "GATCCATG", "A+a,0,0;", [240 if k % 2 else 10, 230 if k % 2 else 20], k) for k in range(12)]
    A.write_bam(bam, [("ctg", 50)], iter(rows))
    haps.write_text(">HAP0\tx SNPRANGE:1-4\n" + "".join(f"r{k} 1 4\n" for k in range(0, 12, 2)) + ">HAP1\tx SNPRANGE:1-4\n" + "".join(f"r{k} 1 4\n" for k in range(1, 9, 2)))
    assert main(["phase-variants", "--floria", str(haps), "--bam", bam, "--motif", "GATC_6mA_1,CATG_6mA_1", "--max-classes", "2", "-o", str(out), "--max-iter", "20"], spark) == 0
    told = json.load(open(out / "summary.json"))
    assert [f["classes"] for f in told["fits"]] == [1, 2] and told["best_classes"] in (1, 2)
    assert sorted(os.listdir(out / "fits")) == ["model_C1.json", "model_C2.json", "responsibilities_C1.tsv", "responsibilities_C2.tsv"]
    assert table(out / "dataset.tsv")[0] == ["id", "hap_1_4", "GATC_6mA_1", "CATG_6mA_1"] and len(table(out / "dataset.tsv")) == 13
    labels = table(out / "imputed_labels.tsv")
    assert labels[0][:2] == ["id", "hap_1_4"] and labels[0][-1] == "assigned_class" and {r[1] for r in labels[1:]} == {"HAP0", "HAP1"}
    assert all(r[1] != "NA" for r in table(out / "imputed.tsv")) and len(table(out / "map_assignments.tsv")) == 13
    assert json.load(open(out / "best_model.json"))["category_names"] == ["hap_1_4"]
    # without haplotypes a pseudo category stands in
    assert main(["phase-variants", "--floria", "skip", "--bam", bam, "--motif", "GATC_6mA_1", "--max-classes", "1", "-o", str(tmp_path / "skip"), "--max-iter", "5"], spark) == 0
    assert table(tmp_path / "skip" / "dataset.tsv")[0] == ["id", "pseudo_hap", "GATC_6mA_1"]
    data = spark.createDataFrame([(0, [1, None], [None]), (1, [None, None], [0.5])], "row_ord long, cats array<int>, meth array<double>")
    assert E.missing_counts(data, 2, 1) == {"rows": 2, "missing_categories": 3, "cells_categories": 4, "missing_features": 1, "cells_features": 2}
