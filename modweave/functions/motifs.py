"""Degenerate sequence motifs: parsing, matching and labels."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The IUPAC nucleotide codes.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}

# Modification codes of the MM tag by canonical base, and their labels.
CODE_LABELS = {("A", "a"): "6mA", ("C", "m"): "5mC", ("C", "21839"): "4mC", ("C", "C"): "4mC", ("C", "h"): "5hmC", ("C", "f"): "5fC", ("C", "g"): "5gmC"}

# One-letter codes of motif files.
LETTER_LABELS = {"a": "6mA", "m": "5mC", "h": "5hmC", "f": "5fC", "g": "5gmC", "c": "4mC"}


@dataclass(frozen=True)
class Motif:
    """``raw`` as given; ``pattern`` in upper case; the modified base is at ``index`` from 0."""

    raw: str
    pattern: str
    label: str
    index: int

    @property
    def regex(self) -> str:
        """Zero-width, so that overlapping matches are found. A read's ``N`` matches every symbol, ``U`` is ``T``."""
        return "(?i)(?=" + "".join(base_class(c) for c in self.pattern) + ")"


def base_class(symbol: str) -> str:
    return "[" + IUPAC[symbol] + ("U" if "T" in IUPAC[symbol] else "") + "N]"


def parse_motif(raw: str) -> Motif:
    """``MOTIF_label_index``; the label is kept as written, even where files would normalise it."""
    parts = raw.strip().split("_")
    if len(parts) != 3:
        raise ValueError(f"motif {raw!r} must have three parts: MOTIF_label_index")
    pattern = parts[0].upper()
    if not pattern or any(c not in IUPAC for c in pattern):
        raise ValueError(f"motif {raw!r} holds a symbol that is no IUPAC code")
    if not parts[2].isdigit() or int(parts[2]) >= len(pattern):
        raise ValueError(f"motif {raw!r}: the index must lie inside the motif")
    return Motif(raw.strip(), pattern, parts[1], int(parts[2]))


def normal_label(label: str) -> str:
    """A motif file's modification type as a label: codes by letter, known names in their spelling."""
    text = label.strip()
    known = {x.lower(): x for x in LETTER_LABELS.values()}
    return LETTER_LABELS.get(text.lower(), known.get(text.lower(), text))


def code_label(base: str, code: str) -> str:
    return CODE_LABELS.get((base.upper(), code), f"{base}+{code}")


def code_label_column(base: Column, code: Column) -> Column:
    out = None
    for (b, c), label in CODE_LABELS.items():
        test = (F.upper(base) == b) & (code == c)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.concat(base, F.lit("+"), code))


def normal_label_column(label: Column) -> Column:
    text, out = F.trim(label), None
    for key, value in [*LETTER_LABELS.items(), *((v.lower(), v) for v in LETTER_LABELS.values())]:
        out = F.when(F.lower(text) == key, value) if out is None else out.when(F.lower(text) == key, value)
    return out.otherwise(text)


def safe_label(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9]", "_", text)


def motif_table(spark, motifs: Iterable[Motif]) -> DataFrame:
    """Motifs as a table; few rows, given by the user."""
    rows = [(k, m.raw, m.pattern, len(m.pattern), m.label, m.index) for k, m in enumerate(motifs)]
    return spark.createDataFrame(rows, "motif_idx int, motif string, pattern string, motif_len int, label string, mod_index int")


def motif_starts(seq: Column, motif: Motif) -> Column:
    """All starts of a motif, overlapping ones too, in forward text; Arrow batches, one compiled pattern a batch."""
    expression = motif.regex

    @F.pandas_udf("array<int>")
    def starts(text: pd.Series) -> pd.Series:
        find = re.compile(expression).finditer
        return text.map(lambda s: [] if s is None else [m.start() for m in find(s)])

    return starts(seq)


def occurrences(reads: DataFrame, motifs: list[Motif], seq: str = "seq", strand_aware: bool = True) -> DataFrame:
    """One row per read and motif match, with ``motif_start`` and ``read_position``.

    On reverse reads the modified base counts from the motif's other end, if ``strand_aware``.
    """
    found = [F.struct(F.lit(k).alias("motif_idx"), F.lit(m.raw).alias("motif"), F.lit(m.label).alias("label"), F.lit(len(m.pattern)).alias("n"), F.lit(m.index).alias("i"), motif_starts(F.col(seq), m).alias("starts")) for k, m in enumerate(motifs)]
    each = reads.withColumn("m", F.explode(F.array(*found))).withColumn("motif_start", F.explode("m.starts"))
    offset = F.when(F.col("strand") == "-", F.col("m.n") - 1 - F.col("m.i")).otherwise(F.col("m.i")) if strand_aware else F.col("m.i")
    return each.select(
        *(c for c in reads.columns if c not in (seq, "qual")), F.col("m.motif_idx").alias("motif_idx"), F.col("m.motif").alias("motif"), F.col("m.label").alias("label"),
        "motif_start", F.col("m.i").alias("motif_position"), (F.col("motif_start") + offset).alias("read_position"),
    )
