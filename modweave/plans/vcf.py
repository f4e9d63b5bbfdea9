"""Site summaries as VCF text."""

from __future__ import annotations

import gzip
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.motifs import Motif
from ..sources.tables import fixed

# The file's format lines.
_HEAD = [
    '##INFO=<ID=MOTIF,Number=1,Type=String,Description="Motif">', '##INFO=<ID=MODL,Number=1,Type=String,Description="Modification label">',
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="Calls">', '##INFO=<ID=METH,Number=1,Type=Integer,Description="Methylated calls">',
    '##INFO=<ID=UNMETH,Number=1,Type=Integer,Description="Other calls">', '##INFO=<ID=FRAC,Number=1,Type=Float,Description="Methylated fraction">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Calls">', '##FORMAT=<ID=METH,Number=1,Type=Integer,Description="Methylated calls">',
    '##FORMAT=<ID=UNMETH,Number=1,Type=Integer,Description="Other calls">', '##FORMAT=<ID=FRAC,Number=1,Type=Float,Description="Methylated fraction">',
    '##FORMAT=<ID=MEANP,Number=1,Type=Float,Description="Mean probability of methylated calls">',
]


def _allele(label: str) -> str:
    """A label as a symbolic allele's name: letters and digits of ASCII, all else an underscore."""
    return "".join(c if c.isascii() and c.isalnum() else "_" for c in label)


def vcf_rows(sites: DataFrame, motifs: list[Motif]) -> DataFrame:
    """Sorted lines, one for each site. The reference base is the motif's at its modified place, an IUPAC code maybe."""
    table = F.array(*(F.struct(F.lit(m.pattern[m.index]).alias("ref"), F.lit(m.raw).alias("motif"), F.lit(m.label).alias("label"), F.lit(f"<{_allele(m.label)}>").alias("alt")) for m in motifs))
    m = F.element_at(table, F.col("motif_idx") + 1)
    depth = F.col("meth") + F.col("unmeth")
    frac = fixed(F.col("fraction"), null=".")
    info = F.concat(F.lit("MOTIF="), m["motif"], F.lit(";MODL="), m["label"], F.lit(";DP="), depth, F.lit(";METH="), "meth", F.lit(";UNMETH="), "unmeth", F.lit(";FRAC="), frac)
    sample = F.concat_ws(":", depth.cast("string"), F.col("meth").cast("string"), F.col("unmeth").cast("string"), frac, fixed(F.col("mean_probability"), null="."))
    line = F.concat_ws("\t", "contig", F.col("ref_position").cast("string"), F.lit("."), m["ref"], m["alt"], F.lit("."), F.lit("PASS"), info, F.lit("DP:METH:UNMETH:FRAC:MEANP"), sample)
    return sites.orderBy("contig", "ref_position", "motif_idx").select(line.alias("value"))


def write_vcf(sites: DataFrame, motifs: list[Motif], path: str, sample: str = "sample", plain: bool = False) -> None:
    """One file, written line by line in order; gzipped unless plain."""
    contigs = [r[0] for r in sites.select("contig").distinct().orderBy("contig").collect()]
    head = ["##fileformat=VCFv4.3", *(f"##contig=<ID={c}>" for c in contigs), *_HEAD, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]
    if not plain and not path.endswith(".gz"):
        path += ".gz"
    with open(path, "w", encoding="utf-8") if plain else gzip.open(path, "wt", encoding="utf-8") as f:
        f.writelines(x + "\n" for x in _all(head, vcf_rows(sites, motifs)))


def _all(head: Iterable[str], rows: DataFrame):
    yield from head
    yield from (r[0] for r in rows.toLocalIterator())
