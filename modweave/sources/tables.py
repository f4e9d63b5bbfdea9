"""Text formats: FASTQ, motif files, contig bins, haplotype blocks, typing data, features and assignments."""

from __future__ import annotations

import csv
import json
import re
import tomllib
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.motifs import Motif, normal_label, parse_motif


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``read_ord``, ``read_id``, ``seq``, ``qual``; plain or gzipped, four lines a record."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for value in pdf["value"]:
                lines = value.split("\n")
                while lines and not lines[-1].strip():
                    lines.pop()
                if len(lines) % 4:
                    raise ValueError("truncated FASTQ record")
                for k in range(0, len(lines), 4):
                    head, seq, plus, qual = (x.rstrip("\r") for x in lines[k : k + 4])
                    if not head.startswith("@") or not plus.startswith("+") or len(seq) != len(qual):
                        raise ValueError(f"no FASTQ record at line {k + 1}")
                    rows.append((k // 4, head[1:].split()[0] if head[1:].split() else "", seq, qual))
            yield pd.DataFrame(rows, columns=["read_ord", "read_id", "seq", "qual"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "read_ord bigint, read_id string, seq string, qual string")


def last_by_id(reads: DataFrame, key: str = "read_id", order: str = "read_ord") -> DataFrame:
    """One row for each id, that of the largest order (a FASTQ index keeps the last)."""
    return _by_id(reads, key, order, F.max_by)


def first_by_id(reads: DataFrame, key: str = "read_id", order: str = "read_ord") -> DataFrame:
    """One row for each id, that of the smallest order (an alignment index keeps the first)."""
    return _by_id(reads, key, order, F.min_by)


def _by_id(reads: DataFrame, key: str, order: str, choose) -> DataFrame:
    rest = [c for c in reads.columns if c != key]
    return reads.groupBy(key).agg(choose(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def fallback_format(path: str) -> str:
    low = path.lower()
    if low.endswith(".bam"):
        return "bam"
    if low.endswith((".fastq", ".fq", ".fastq.gz", ".fq.gz")):
        return "fastq"
    raise ValueError(f"{path}: expected .bam, .fastq, .fq or a gzipped FASTQ")


def _lines(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return f.read().splitlines()


def read_motif_file(path: str, bins: set[str] | None = None) -> list[Motif]:
    """Motifs of a delimited file, each row's complement after it; only rows of the given bins, if the file has any."""
    lines = _lines(path)
    rows = list(csv.reader(lines, delimiter="\t" if lines and "\t" in lines[0] else ","))
    if not rows:
        raise ValueError(f"{path} is empty")
    at = {h.strip().lower(): k for k, h in reversed(list(enumerate(rows[0])))}
    for need in ("motif", "mod_type", "mod_position"):
        if need not in at:
            raise ValueError(f"{path} lacks the column {need}")
    bin_at = next((at[c] for c in ("id", "bin", "reference") if c in at), None)
    found = []
    for row in rows[1:]:
        cell = lambda n: row[at[n]].strip() if n in at and at[n] < len(row) else ""  # noqa: E731, B023
        if not any(x.strip() for x in row):
            continue
        if bins is not None and bin_at is not None and (row[bin_at].strip() if bin_at < len(row) else "") not in bins:
            continue
        label = normal_label(cell("mod_type"))
        main = f"{cell('motif')}_{label}_{cell('mod_position')}"
        found.append(main)
        other, place = cell("motif_complement"), cell("mod_position_complement")
        if bool(other) != bool(place):
            raise ValueError(f"{path}: a complement needs both motif and position")
        if other and (spec := f"{other}_{label}_{place}") != main:
            found.append(spec)
    if not found:
        raise ValueError(f"{path} produced no entries" + (f" for ids {', '.join(sorted(bins))}" if bins else ""))
    return [parse_motif(x) for x in found]


@dataclass
class Bin:
    name: str
    safe_name: str
    contigs: list[str] = field(default_factory=list)


def read_bins(path: str) -> list[Bin]:
    """Contig bins in the order first seen; the rest of a line after the first blank is the bin's name."""
    bins: dict[str, Bin] = {}
    taken: dict[str, int] = {}
    for number, line in enumerate(_lines(path), 1):
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        contig, _, name = re.sub(r"\s", " ", text, count=1).partition(" ") if re.search(r"\s", text) else (text, "", "")
        name = name.strip()
        if not bins and (contig.lower(), name.lower()) == ("contig", "bin"):
            continue
        if not name:
            raise ValueError(f"{path}, line {number}: no bin")
        if name not in bins:
            safe = re.sub(r"[^A-Za-z0-9_.\-]", "_", name) or "_"
            n = taken.get(safe, 0)
            taken[safe] = n + 1
            bins[name] = Bin(name, f"{safe}_{n}" if n else safe)
        if contig not in bins[name].contigs:
            bins[name].contigs.append(contig)
    if not bins:
        raise ValueError(f"{path} holds no bins")
    return list(bins.values())


def bin_table(spark: SparkSession, bins: list[Bin]) -> DataFrame:
    rows = [(b.name, b.safe_name, c, k) for b in bins for k, c in enumerate(b.contigs)]
    return spark.createDataFrame(rows, "bin string, safe_name string, contig string, ord int")


def safe_names(rows: DataFrame, name: str = "bin", order: str = "ord") -> DataFrame:
    """Adds ``safe_name``: other characters become ``_``, and a repeated result gets its number."""
    safe = F.regexp_replace(F.col(name), r"[^A-Za-z0-9_.\-]", "_")
    rows = rows.withColumn("s", F.when(safe == "", "_").otherwise(safe))
    k = F.row_number().over(Window.partitionBy("s").orderBy(order)) - 1
    return rows.withColumn("k", k).withColumn("safe_name", F.when(F.col("k") > 0, F.concat("s", F.lit("_"), "k")).otherwise(F.col("s"))).drop("s", "k")


_BLOCK = re.compile(r"^>HAP(\d+)[^\t]*\t.*SNPRANGE:(\d+)-(\d+)")


def read_haplotypes(path: str) -> tuple[list[tuple], list[tuple]]:
    """Blocks (block_ord, hap, snp_start, snp_end) and entries (block_ord, entry_ord, id, start, end).

    A line of one token spells the alleles of the whole range, each known one an entry of its own.
    """
    blocks, entries = [], []
    for line in _lines(path):
        if not line.strip():
            continue
        if line.startswith(">"):
            match = _BLOCK.match(line)
            if not match or int(match[3]) < int(match[2]):
                raise ValueError(f"{path}: no haplotype header: {line!r}")
            blocks.append((len(blocks), int(match[1]), int(match[2]), int(match[3])))
            continue
        if not blocks:
            raise ValueError(f"{path}: data before the first header")
        block, _, low, high = blocks[-1]
        parts = line.split()
        if len(parts) >= 3:
            entries.append((block, len(entries), parts[0], int(parts[1]), int(parts[2])))
        elif len(parts) == 1:
            if len(parts[0]) != high - low + 1:
                raise ValueError(f"{path}: {len(parts[0])} alleles for a range of {high - low + 1}")
            for k, allele in enumerate(parts[0]):
                if allele != "?":
                    entries.append((block, len(entries), f"snp_{low + k}", low + k, low + k))
        else:
            raise ValueError(f"{path}: cannot read {line!r}")
    return blocks, entries


def read_categories(path: str) -> dict:
    with open(path, "rb") as f:
        told = tomllib.load(f)
    names, levels = told["categories"]["names"], told["categories"]["levels"]
    if len(names) != len(levels):
        raise ValueError(f"{path}: {len(names)} names and {len(levels)} levels")
    return {"names": names, "levels": levels, "methylation_names": told.get("methylation_names", told["categories"].get("methylation_names", []))}


def write_categories(path: str, names: list[str], levels: list[int], methylation: list[str]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"methylation_names = {json.dumps(methylation)}\n\n[categories]\nnames = {json.dumps(names)}\nlevels = {json.dumps(levels)}\n")


def read_dataset(spark: SparkSession, path: str, n_categories: int, sep: str = "\t") -> DataFrame:
    """``row_ord``, ``id``, ``cats``; every row must be as wide as the categories, cells are ``NA`` or whole numbers."""
    rows = []
    for k, parts in enumerate(csv.reader(_lines(path)[1:], delimiter=sep)):
        if not parts:
            continue
        if len(parts) != n_categories + 1:
            raise ValueError(f"{path}, row {k + 1}: {len(parts) - 1} categories, not {n_categories}")
        rows.append((len(rows), parts[0], [None if x == "NA" else int(x) for x in parts[1:]]))
    return spark.createDataFrame(rows, "row_ord bigint, id string, cats array<int>")


def read_features(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``id`` and ``meth`` from a clustering table: columns after read_id and cluster_id; the last of equal ids counts."""
    raw = spark.read.csv(path, sep=sep, header=True)
    if len(raw.columns) < 3:
        raise ValueError(f"{path}: no feature columns")
    number = lambda c: F.when(F.trim(F.col(f"`{c}`")).isin("NA", ""), F.lit(None)).otherwise(F.col(f"`{c}`")).cast("double")
    rows = raw.select(F.col(f"`{raw.columns[0]}`").alias("id"), F.array(*(number(c) for c in raw.columns[2:])).alias("meth"), F.monotonically_increasing_id().alias("at"))
    return rows.groupBy("id").agg(F.max_by("meth", "at").alias("meth"))


def assigned_class(columns: list[str]) -> Column:
    """A row's class: ``assigned_class``, or the first largest of the class columns."""
    if "assigned_class" in columns:
        return F.col("assigned_class").cast("int")
    numbered = sorted((int(m[2]), c) for c in columns if (m := re.match(r"^(class_|resp_class_)(\d+)$", c)))
    if not numbered:
        raise ValueError("assignments need assigned_class or class columns")
    known = F.filter(F.array(*(F.struct(F.expr(f"try_cast(`{c}` as double)").alias("p"), F.lit(k).alias("k")) for k, c in numbered)), lambda x: x["p"].isNotNull())
    best = F.array_max(F.transform(known, lambda x: x["p"]))
    return F.element_at(F.filter(known, lambda x: x["p"] == best), 1)["k"].cast("int")


def read_assignments(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    raw = spark.read.csv(path, sep=sep, header=True)
    rows = raw.select("id", assigned_class(raw.columns).alias("assigned_class"), F.monotonically_increasing_id().alias("at"))
    return rows.groupBy("id").agg(F.max_by("assigned_class", "at").alias("assigned_class"))


def fixed(c: Column, digits: int = 4, null: str = "NA") -> Column:
    """Decimals with ties to even, as text; ``format_string`` would round them up."""
    half = f"5e-{digits + 1}"
    if Decimal(float(half)) > Decimal(half):
        # a little above a tie, but rounded down where no digit is before it
        c = F.when(F.abs(c) == float(half), c * 2).otherwise(c)
    return F.coalesce(F.regexp_replace(F.call_function("format_number", c, F.lit("0." + "0" * digits)), ",", ""), F.lit(null))


def write_tsv(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True, emptyValue="", nullValue="NA", quote="")


def write_fastq(reads: DataFrame, path: str, key: str, label: str | None = None, pad: bool = True) -> None:
    """FASTQ text in a folder for each key. Qualities are padded and cut to the sequence, or left as they are."""
    mark = F.expr("repeat('!', length(seq))")
    qual = F.when(F.coalesce(F.length("qual"), F.lit(0)) == 0, mark).otherwise(F.col("qual"))
    if pad:
        qual = F.substring(F.concat(qual, mark), F.lit(1), F.length("seq"))
    head = F.concat(F.lit("@"), "read_id", F.concat(F.lit("|"), F.col(label)) if label else F.lit(""))
    text = F.concat_ws("\n", head, "seq", F.lit("+"), qual)
    reads.select(F.col(key), text.alias("value")).write.mode("overwrite").partitionBy(key).text(path)
