"""Base modification tags, alignment lift-over and qualities, decoded a read at a time inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .motifs import code_label

CALL = "struct<ordinal:int,position:int,probability:float,methylated:boolean,canonical_base:string,label:string,code:string,mod_strand:string>"
_HEADER = re.compile(r"^([A-Za-z])([+\-.])([A-Za-z]+|[0-9]+)([.?]?)$")
_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")


def split_mm(mm: str) -> Iterator[tuple[str, str, str, bool, list[int]]]:
    """Segments of an MM tag: base, strand, code, whether unlisted bases are unmodified, and the deltas."""
    for segment in mm.split(";"):
        if not segment.strip():
            continue
        head, *rest = segment.strip().split(",")
        match = _HEADER.match(head)
        if not match:
            raise ValueError(f"invalid modification header {head!r}")
        try:
            deltas = [int(x) for x in rest if x != ""]
        except ValueError:
            raise ValueError(f"invalid delta in {segment!r}") from None
        if any(d < 0 for d in deltas):
            raise ValueError(f"negative delta in {segment!r}")
        yield match[1], match[2], match[3], match[4] != "?" , deltas


def canonical_positions(seq: str, base: str, strand: str) -> np.ndarray:
    """Positions of a base in the stored sequence, last first on the ``-`` strand."""
    codes = np.frombuffer(seq.upper().encode("utf-32-le"), np.uint32)
    found = np.flatnonzero(codes == ord(base.upper()))
    return found[::-1] if strand == "-" else found


def decode_arrays(seq: str, mm: str | None, ml: Iterable[int] | None) -> list[tuple]:
    """The runs of calls of one read, in the tag's order: positions, probabilities (None where there are none), base, label, code, strand.

    Unlisted canonical bases of implicit segments are a run after the segment's own. A segment takes one probability for
    each delta, however many codes it names. Any mismatch is an error.
    """
    if not mm:
        return []
    levels = None if ml is None else np.asarray(list(ml), np.float32) / np.float32(255)
    runs: list[tuple] = []
    used = 0
    for base, strand, code, implicit, deltas in split_mm(mm):
        places, told = canonical_positions(seq, base, strand), (base, code_label(base, code), code, strand)
        at = np.cumsum(np.array(deltas, np.int64) + 1) - 1
        if len(at) and at[-1] >= len(places):
            raise ValueError(f"canonical index {at[at >= len(places)][0]} lies outside the read's {len(places)} {base}")
        if levels is not None and used + len(at) > len(levels):
            raise ValueError("fewer probabilities than modifications")
        runs.append((places[at], None if levels is None else levels[used : used + len(at)], True, *told))
        used += len(at)
        if implicit:
            runs.append((np.delete(places, at), None, False, *told))
    if levels is not None and used != len(levels):
        raise ValueError("more probabilities than modifications")
    return runs


def decode_calls(seq: str, mm: str | None, ml: Iterable[int] | None) -> list[tuple]:
    """Calls of one read: ordinal, position, probability, whether methylated, base, label, code, strand."""
    calls: list[tuple] = []
    for positions, chances, methylated, *told in decode_arrays(seq, mm, ml):
        chances = [None] * len(positions) if chances is None else chances.astype(float).tolist()
        calls += [(len(calls) + k, p, c, methylated, *told) for k, (p, c) in enumerate(zip(positions.tolist(), chances))]
    return calls


def lift_array(length: int, start: int | None, cigar: str | None) -> np.ndarray:
    """1-based reference position of each base; 0 for inserted, clipped and unaligned ones."""
    out = np.zeros(length, np.int64)
    if start is None or not cigar or cigar == "*":
        return out
    at, place = 0, start
    for n, op in ((int(n), op) for n, op in _CIGAR.findall(cigar)):
        if op in "M=X":
            part = out[at : at + n]
            part[:] = np.arange(place, place + len(part))
        at += n if op in "M=XIS" else 0
        place += n if op in "M=XDN" else 0
    return out


def lift_over(length: int, start: int | None, cigar: str | None) -> list[int | None]:
    """As ``lift_array``, null in the place of 0."""
    return [p or None for p in lift_array(length, start, cigar).tolist()]


def phred(p: float | None) -> int | None:
    """Quality of a probability of being right, in single precision: 0 to 93; none outside 0 to 1."""
    if p is None or not 0 <= p <= 1:
        return None
    one = np.float32(1)
    if abs(one - np.float32(p)) < np.finfo(np.float32).eps:
        return 93
    value = np.float32(-10) * np.log10(max(one - np.float32(p), np.float32(1e-9)))
    return int(min(93, max(0, np.floor(value + np.float32(0.5)))))


def phred_column(p: Column) -> Column:
    wrong = F.greatest(F.lit(1.0) - p, F.lit(1e-9))
    value = F.floor(F.lit(-10.0) * F.log10(wrong) + 0.5)
    return F.when((p < 0) | (p > 1), F.lit(None)).when(p >= 1.0 - 1.1920929e-07, F.lit(93)).otherwise(F.least(F.lit(93), F.greatest(F.lit(0), value))).cast("int")


_CALL_TYPE = pa.struct(
    [("ordinal", pa.int32()), ("position", pa.int32()), ("probability", pa.float32()), ("methylated", pa.bool_()), *((c, pa.string()) for c in ("canonical_base", "label", "code", "mod_strand"))]
)


def _call_lists(reads: list[list[tuple]]) -> pa.Array:
    """The runs of many reads as one Arrow array of lists of calls."""
    runs = [run for read in reads for run in read]
    size = np.array([len(r[0]) for r in runs], np.int64)
    total = np.cumsum([0, *(sum(len(r[0]) for r in read) for read in reads)])
    joined = lambda x, kind: np.concatenate([np.empty(0, kind), *x]).astype(kind)
    chance = joined((np.zeros(len(r[0]), np.float32) if r[1] is None else r[1] for r in runs), np.float32)
    fields = [
        pa.array((np.arange(total[-1]) - np.repeat(total[:-1], np.diff(total))).astype(np.int32)), pa.array(joined((r[0] for r in runs), np.int32)),
        pa.array(chance, mask=np.repeat(np.array([r[1] is None for r in runs], bool), size)), pa.array(np.repeat(np.array([r[2] for r in runs], bool), size)),
        *(pa.array([r[k] for r in runs], pa.string()).take(pa.array(np.repeat(np.arange(len(runs)), size))) for k in range(3, 7)),
    ]
    return pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_CALL_TYPE)))


def decode_column(seq: Column, mm: Column, ml: Column) -> Column:
    """``decode_calls`` of every read as a struct of ``calls`` and ``error``; positions and probabilities stay arrays."""

    @F.arrow_udf(f"struct<calls:array<{CALL}>,error:string>")
    def decode(seq: pa.Array, mm: pa.Array, ml: pa.Array) -> pa.Array:
        found, errors = [], []
        for s, m, p in zip(seq.to_pylist(), mm.to_pylist(), ml):
            try:
                found.append(decode_arrays(s or "", m, p.values.to_numpy(zero_copy_only=False) if p.is_valid else None))
                errors.append(None)
            except ValueError as e:
                found.append([])
                errors.append(str(e))
        return pa.StructArray.from_arrays([_call_lists(found), pa.array(errors, pa.string())], ["calls", "error"])

    return decode(seq, mm, ml)


def positions_column(seq: Column, base: str, strand: Column) -> Column:
    """``canonical_positions`` of every read."""

    @F.arrow_udf("array<bigint>")
    def places(seq: pa.Array, strand: pa.Array) -> pa.Array:
        found = [canonical_positions(s or "", base, t) for s, t in zip(seq.to_pylist(), strand.to_pylist())]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found])))

    return places(seq, strand)


def lift_column(length: Column, start: Column, cigar: Column) -> Column:
    @F.arrow_udf("array<bigint>")
    def lift(length: pa.Array, start: pa.Array, cigar: pa.Array) -> pa.Array:
        found = [lift_array(n or 0, s, c) for n, s, c in zip(length.to_pylist(), start.to_pylist(), cigar.to_pylist())]
        flat = np.concatenate([np.empty(0, np.int64), *found])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat, mask=flat == 0))

    return lift(length, start, cigar)


def decode_reads(records: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Alignment records as reads with ``calls``, ``ref_pos`` and ``mod_error``.

    ``records`` has name, flag, contig, start, cigar, seq, qual, mm, ml and ``read_ord``. A tag that can't be
    parsed leaves the read without calls. ``fallback`` (read_id, seq, qual) fills absent sequences after the
    tags were read against the record's own, so such reads have motifs but no calls.
    """
    strand = F.when(F.col("flag").bitwiseAND(4) != 0, F.lit(None).cast("string")).when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+")
    own = F.when(F.col("seq") == "*", "").otherwise(F.coalesce("seq", F.lit("")))
    reads = records.select(
        F.col("name").alias("read_id"), "read_ord", F.when(F.col("contig") != "*", F.col("contig")).alias("contig"), strand.alias("strand"), own.alias("seq"),
        F.when(F.col("qual") != "*", F.col("qual")).alias("qual"), F.when(F.col("start") > 0, F.col("start")).alias("start"), "cigar", "mm", "ml",
    )
    reads = reads.withColumn("d", decode_column(F.col("seq"), F.col("mm"), F.col("ml")))
    if fallback is not None:
        fb = fallback.select("read_id", F.col("seq").alias("fb_seq"), F.col("qual").alias("fb_qual"))
        reads = reads.join(fb, "read_id", "left").withColumn("qual", F.when(F.col("seq") == "", F.col("fb_qual")).otherwise(F.col("qual")))
        reads = reads.withColumn("seq", F.when(F.col("seq") == "", F.coalesce("fb_seq", "seq")).otherwise(F.col("seq"))).drop("fb_seq", "fb_qual")
    return reads.withColumn("ref_pos", lift_column(F.length("seq"), F.col("start"), F.col("cigar"))).select(
        "read_id", "read_ord", "contig", "strand", "seq", "qual", "start", "cigar", F.col("d.calls").alias("calls"), F.col("d.error").alias("mod_error"), "ref_pos"
    )
