"""Hand-worked cases of the read formats and pipelines."""

import gzip

import pytest
from pyspark.sql import functions as F

from modweave.functions.mods import decode_calls, lift_over, phred
from modweave.functions.motifs import normal_label, occurrences, parse_motif
from modweave.operators import calls as C
from modweave.plans import extract as E
from modweave.plans.vcf import vcf_rows
from modweave.sources import alignments as A
from modweave.sources import tables as T

SAM = "@HD\tVN:1.6\n@SQ\tSN:ctg\tLN:50\n"


def sam(tmp_path, *lines):
    path = tmp_path / "in.sam"
    path.write_text(SAM + "".join("\t".join(map(str, x)) + "\n" for x in lines))
    return str(path)


def read(name, flag, seq, mm, ml, start=1, cigar=None, qual=None):
    return (name, flag, "ctg", start, 60, cigar or f"{len(seq)}M", "*", 0, 0, seq, qual or ("*" if seq == "*" else "I" * len(seq)), f"MM:Z:{mm}", "ML:B:C," + ",".join(map(str, ml)))


def test_decode():
    assert [c[1] for c in decode_calls("AT", "A+a,0;", [128])] == [0]
    assert [(c[3], c[2]) for c in decode_calls("AAA", "A+a.,0;", [255])] == [(True, 1.0), (False, None), (False, None)]
    assert len(decode_calls("AAA", "A+a?,0;", [255])) == 1
    assert decode_calls("GATC", "A-a,0;", [200])[0][1] == 1
    with pytest.raises(ValueError, match="canonical index"):
        decode_calls("A", "A+a,1;", None)
    with pytest.raises(ValueError):
        decode_calls("AA", "A+a,0;", [1, 2])


def test_lift_and_phred():
    assert lift_over(6, 10, "1S2M1I1D2M") == [None, 10, 11, None, 13, 14]
    assert lift_over(2, None, "2M") == [None, None]
    assert (phred(1.0), phred(0.0), phred(0.9), phred(1.5), phred(200 / 255)) == (93, 0, 10, None, 7)


def test_motifs(tmp_path):
    for bad in ("GATC_6mA", "GATC_6mA_4", "GAXC_6mA_1"):
        with pytest.raises(ValueError):
            parse_motif(bad)
    assert (normal_label("a"), normal_label("5MC"), normal_label("odd")) == ("6mA", "5mC", "odd")
    f = tmp_path / "m.tsv"
    f.write_text("motif\tmod_type\tmod_position\tmotif_complement\tmod_position_complement\tReference\nGATC\t6mA\t1\tGATC\t2\tbinA\nCCWGG\tm\t0\tCCWGG\t4\tbinB\n")
    assert [m.raw for m in T.read_motif_file(str(f))] == ["GATC_6mA_1", "GATC_6mA_2", "CCWGG_5mC_0", "CCWGG_5mC_4"]
    assert [m.raw for m in T.read_motif_file(str(f), {"binB"})] == ["CCWGG_5mC_0", "CCWGG_5mC_4"]
    with pytest.raises(ValueError, match="produced no entries for ids x"):
        T.read_motif_file(str(f), {"x"})


def test_motif_overlap_and_strand(spark):
    r = spark.createDataFrame([("a", "+", "AGATCT"), ("b", "-", "TGATCA"), ("c", "+", "AAAANA")], "read_id string, strand string, seq string")
    assert [(x.read_id, x.motif_start) for x in occurrences(r, [parse_motif("RGATCY_6mA_2")]).collect()] == [("a", 0)]
    assert sorted(x.motif_start for x in occurrences(r, [parse_motif("AA_6mA_0")]).collect()) == [0, 1, 2, 3, 4]


def test_extract_forward_reverse(spark, tmp_path):
    path = sam(tmp_path, read("read_fwd", 0, "GAAG", "A+a,0;", [200]), read("read_rev", 16, "GAAG", "A-a,0;", [200]), read("broken", 0, "GAAG", "A+a,9;", [200]))
    motif = [parse_motif("GAAG_6mA_1")]
    e = E.extract(E.load_reads(spark, path), motif)
    rows = {r.read_id: r for r in e.per_read.collect()}
    assert set(rows) == {"read_fwd", "read_rev"}
    assert (rows["read_fwd"].strand, rows["read_fwd"].read_position, rows["read_fwd"].ref_position) == ("+", 1, 2)
    assert (rows["read_rev"].strand, rows["read_rev"].read_position, rows["read_rev"].ref_position) == ("-", 2, 3)
    a = e.aggregate.first()
    assert a.call_count == 1 and all(abs(q - 200 / 255) < 1e-6 for q in a.quantiles)
    assert {r.read_id: r.combo for r in e.summary.collect()} == {"read_fwd": "GAAG_6mA_1", "read_rev": "GAAG_6mA_1", "broken": "NONE"}
    E.write_extraction(e, str(tmp_path / "out"), motif, str(tmp_path / "out/summary"), str(tmp_path / "out/fastq"))
    text = spark.read.csv(str(tmp_path / "out/per_read.tsv"), sep="\t", header=True)
    assert sorted(r.probability for r in text.collect()) == ["0.7843", "0.7843"]
    fastq = spark.read.text(str(tmp_path / "out/fastq"), wholetext=False)
    assert {r.value for r in fastq.collect()} >= {"@read_fwd|GAAG_6mA_1", "@broken|NONE"}


def test_sites_blocks_and_fallback(spark, tmp_path):
    path = sam(tmp_path, read("read0", 0, "GATC", "A+a,0;", [200]), read("star", 0, "*", "A+a,0;", [200], cigar="4M"))
    fq = tmp_path / "f.fastq"
    fq.write_text("@star x\nCCCC\n+\nIIII\n@star y\nGATC\n+\nIIII\n")
    motif = [parse_motif("GATC_6mA_1")]
    reads = E.load_reads(spark, path, fallback=str(fq)).persist()
    assert reads.where("read_id = 'star'").first().seq == "GATC"
    line = [r[0].split("\t") for r in vcf_rows(E.site_table(reads, motif), motif).collect()]
    assert len(line) == 1 and line[0][:5] == ["ctg", "2", ".", "A", "<6mA>"] and line[0][8:] == ["DP:METH:UNMETH:FRAC:MEANP", "1:1:0:1.0000:0.7843"]
    states = {r.read_id: (r.ref_position, r.state) for r in E.block_table(reads, motif).collect()}
    assert states == {"read0": (2, "M"), "star": (2, "U")}
    reads.unpersist()


def test_block_statistics(spark):
    rows = [("read1", 10, True), ("read1", 20, True), ("read2", 10, False), ("read2", 20, False), ("read3", 20, True)]
    calls = spark.createDataFrame([("ctg", p, 0, r, m, None, k) for k, (r, p, m) in enumerate(rows)], "contig string, ref_position long, motif_idx int, read_id string, methylated boolean, probability float, call_ord int")
    states = C.block_states(calls, 1000)
    assert {(r.pattern, r.n) for r in C.block_patterns(states).collect()} == {("MM", 1), ("UU", 1), (".M", 1)}
    s = C.block_stats(states).first()
    assert (s.total_reads, s.fully_methylated, s.fully_unmethylated, s.mixed, s.n_sites) == (3, 2, 1, 0, 2)
    assert abs(s.mean_fraction - 2 / 3) < 1e-12 and abs(s.polarization - 1) < 1e-12 and abs(s.variance - 2 / 9) < 1e-12
    assert C.longitudinal(states).count() == 3


def test_bam_round_trip_and_imputation(spark, tmp_path):
    rows = [A.parse_sam_line("\t".join(map(str, read("read0", 0, "GATC", "A+a,0;", [200]))), 0), (1, "odd", 4, "*", 0, 0, "*", "ACGTN", "*", None, None)]
    path = str(tmp_path / "a.bam")
    assert A.write_bam(path, [("ctg", 50)], iter(rows)) == 2
    got = [tuple(r) for r in A.read_bam(spark, path).orderBy("read_ord").collect()]
    assert [g[:9] for g in got] == [r[:9] for r in rows] and got[0][9:] == ("A+a,0;", [200]) and got[1][9:] == (None, None)
    assert A.read_bam(spark, path, table="contigs").first().contig == "ctg"
    assert A.read_bam(spark, path, contigs="ctg:2-3").count() == 1 and A.read_bam(spark, path, contigs="ctg:9-12").count() == 0
    changes = E.impute_bam(spark, path, out := str(tmp_path / "b.bam"), None, 0.5).collect()
    assert [(c.reference_pos, c.old_base, c.new_base) for c in changes] == [(2, "A", "C")]
    new = A.read_bam(spark, out).where("name = 'read0'").first()
    assert (new.seq, new.qual) == ("GCTC", "I(II")


def test_replacement(spark):
    df = spark.createDataFrame([(5, 0, 0, 1), (5, 3, 4, 6)], "A int, C int, G int, T int")
    got = df.select(C.replacement_base(F.lit("A"), {b: F.col(b) for b in C.BASES}).alias("b")).collect()
    assert [r.b for r in got] == ["C", "C"]


def test_bins_fastq_and_formats(spark, tmp_path):
    f = tmp_path / "bins"
    f.write_text("contig\tbin\n# note\nchr1\tbin 1\nchr2 bin 1\nchr3\tweird/bin\nchr1\tweird:bin\n")
    bins = T.read_bins(str(f))
    assert [(b.name, b.safe_name, b.contigs) for b in bins] == [("bin 1", "bin_1", ["chr1", "chr2"]), ("weird/bin", "weird_bin", ["chr3"]), ("weird:bin", "weird_bin_1", ["chr1"])]
    gz = tmp_path / "r.fastq.gz"
    gz.write_bytes(gzip.compress(b"@a 1\nACG\n+\nIII\n@b\nAC\n+\nII\n"))
    assert [(r.read_id, r.seq) for r in T.read_fastq(spark, str(gz)).orderBy("read_ord").collect()] == [("a", "ACG"), ("b", "AC")]
    assert T.fallback_format("X.FQ.GZ") == "fastq"
    assert spark.range(1).select(T.fixed(F.lit(0.03125)).alias("x")).first().x == "0.0312"
    a = tmp_path / "a.tsv"
    a.write_text("id\tclass_0\tclass_1\na\t0.5\t0.5\nb\t0.2\t0.8\n")
    assert {r.id: r.assigned_class for r in T.read_assignments(spark, str(a)).collect()} == {"a": 0, "b": 1}


def test_split_reads(spark, tmp_path):
    reads = [read(f"r{k}", 0, "GATC", "A+a,0;", [250 if k >= 2 else 10]) for k in range(4)]
    path = sam(tmp_path, *reads)
    loaded = E.load_reads(spark, path).persist()
    s = E.split_reads(loaded, [parse_motif("GATC_6mA_1"), parse_motif("CC_5mC_0")])
    labels = {r.read_id: r.cluster_id for r in s.labels.collect()}
    assert s.kept == ["GATC_6mA_1"] and labels["r0"] == labels["r1"] != labels["r2"] == labels["r3"]
    E.write_split(s, str(tmp_path / "s"), loaded, fastq=True)
    noise = E.split_reads(loaded, [parse_motif("GATC_6mA_1")], "hdbscan")
    assert {r.cluster_id for r in noise.labels.collect()} == {-1}
    told = E.phase_variants(spark, path, [parse_motif("GATC_6mA_1")], str(tmp_path / "p"), None, 1, 2, iterations=5)
    assert told["best_classes"] in (1, 2) and (tmp_path / "p/best_model.json").exists()
    loaded.unpersist()


def test_labels_of_the_vcf(spark):
    motifs = [parse_motif("GATC_21839+x_1"), parse_motif("GATC_6mA_1")]
    sites = spark.createDataFrame([("ctg", 5, 0, 1, 1, 0.5, 0.75), ("ctg", 5, 1, 0, 2, 0.0, None)], "contig string, ref_position long, motif_idx int, meth long, unmeth long, fraction double, mean_probability double")
    lines = [r[0].split("\t") for r in vcf_rows(sites, motifs).collect()]
    # the allele holds letters and digits only; the motif and its label stay as given
    assert [x[4] for x in lines] == ["<" + "".join(c if c.isalnum() else "_" for c in motifs[0].label) + ">", "<6mA>"]
    assert lines[0][7].startswith(f"MOTIF={motifs[0].raw};MODL={motifs[0].label};DP=2;") and "+" in motifs[0].raw


def test_pileup_of_odd_reads(spark):
    rows = [("ctg", "acgT", [3, None, 4, 5]), ("ctg", "AN", [3, 4]), ("ctg", "", []), (None, "A", [3]), ("ctg", "AC", [7])]
    got = {(r.position): (r.A, r.C, r.G, r["T"]) for r in C.pileup(spark.createDataFrame(rows, "contig string, seq string, ref_pos array<long>")).collect()}
    assert got == {3: (2, 0, 0, 0), 4: (0, 0, 1, 0), 5: (0, 0, 0, 1), 7: (1, 0, 0, 0)}
