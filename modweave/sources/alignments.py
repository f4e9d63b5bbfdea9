"""SAM text and BAM files: parsing, a Spark data source and a writer, on the standard library alone."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD = "read_ord bigint, name string, flag int, contig string, start bigint, mapq int, cigar string, seq string, qual string, mm string, ml array<int>"
_BASES = "=ACMGRSVTWYHKDBN"  # fixed value: the BAM base alphabet
_OPS = "MIDNSHP=X"  # fixed value: the BAM alignment operations
# Fixed value: the empty block that ends a BGZF file.
_END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def parse_sam_line(line: str, order: int) -> tuple:
    parts = line.rstrip("\n").split("\t")
    if len(parts) < 11:
        raise ValueError(f"alignment line with {len(parts)} fields")
    tags = {p[:2]: p[5:] for p in parts[11:]}
    mm = tags.get("MM", tags.get("Mm"))
    ml = tags.get("ML", tags.get("Ml"))
    levels = None if ml is None else [int(x) for x in ml.split(",")[1:]]
    return (order, parts[0], int(parts[1]), parts[2], int(parts[3]), int(parts[4]), parts[5], parts[9], parts[10], mm, levels)


def sam_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a SAM text file, numbered in file order."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [parse_sam_line(v, k) for v, k in zip(pdf["value"], pdf["at"]) if not v.startswith("@")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    from pyspark.sql import functions as F

    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return lines.mapInPandas(run, RECORD)


def sam_contigs(lines: list[str]) -> list[tuple[str, int]]:
    found = []
    for line in lines:
        if line.startswith("@SQ"):
            tags = dict(p.split(":", 1) for p in line.rstrip("\n").split("\t")[1:])
            found.append((tags["SN"], int(tags["LN"])))
    return found


def bgzf_blocks(path: str, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Blocks that start in a byte range, with their file offset."""
    with open(path, "rb") as f:
        f.seek(begin)
        while end is None or f.tell() < end:
            at, head = f.tell(), f.read(12)
            if len(head) < 12:
                return
            if head[:4] != b"\x1f\x8b\x08\x04":
                raise ValueError(f"{path}: no block at {at}")
            extra = f.read(struct.unpack("<H", head[10:12])[0])
            size, k = None, 0
            while k + 4 <= len(extra):
                length = struct.unpack("<H", extra[k + 2 : k + 4])[0]
                if extra[k : k + 2] == b"BC":
                    size = struct.unpack("<H", extra[k + 4 : k + 6])[0] + 1
                k += 4 + length
            if size is None:
                raise ValueError(f"{path}: block at {at} without size")
            raw = f.read(size - 12 - len(extra))
            yield at, zlib.decompress(raw[:-8], -15)


class BamStream:
    """Bytes of a BAM file, decompressed as they are read."""

    def __init__(self, path: str):
        self.blocks = bgzf_blocks(path)
        self.held, self.at = b"", 0

    def read(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            block = next(self.blocks, None)
            if block is None:
                break
            self.held, self.at = self.held[self.at :] + block[1], 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out

    def header(self) -> tuple[str, list[tuple[str, int]]]:
        if self.read(4) != b"BAM\1":
            raise ValueError("no BAM file")
        text = self.read(struct.unpack("<i", self.read(4))[0]).rstrip(b"\0").decode()
        contigs = []
        for _ in range(struct.unpack("<i", self.read(4))[0]):
            name = self.read(struct.unpack("<i", self.read(4))[0])[:-1].decode()
            contigs.append((name, struct.unpack("<i", self.read(4))[0]))
        return text, contigs

    def records(self, contigs: list[tuple[str, int]]) -> Iterator[tuple]:
        order = 0
        while len(size := self.read(4)) == 4:
            yield parse_record(self.read(struct.unpack("<i", size)[0]), contigs, order)
            order += 1


def parse_record(raw: bytes, contigs: list[tuple[str, int]], order: int) -> tuple:
    ref, pos, name_len, mapq, _, n_ops, flag, length, _, _, _ = struct.unpack("<iiBBHHHiiii", raw[:32])
    at = 32 + name_len
    name = raw[32 : at - 1].decode()
    cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in struct.unpack(f"<{n_ops}I", raw[at : at + 4 * n_ops])) or "*"
    at += 4 * n_ops
    packed = raw[at : at + (length + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:length] or "*"
    at += (length + 1) // 2
    qual = raw[at : at + length]
    quality = "*" if not length or qual[:1] == b"\xff" else "".join(chr(min(q, 93) + 33) for q in qual)
    mm, ml = _tags(raw, at + length)
    return (order, name, flag, contigs[ref][0] if ref >= 0 else "*", pos + 1, mapq, cigar, seq, quality, mm, ml)


_WIDTH = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def _tags(raw: bytes, at: int) -> tuple[str | None, list[int] | None]:
    mm, ml = None, None
    while at < len(raw):
        tag, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            if tag in ("MM", "Mm"):
                mm = raw[at:end].decode()
            at = end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack("<i", raw[at + 1 : at + 5])[0]
            if tag in ("ML", "Ml") and sub in "cC":
                ml = list(raw[at + 5 : at + 5 + n])
            at += 5 + n * _WIDTH[sub]
        else:
            at += _WIDTH[kind]
    return mm, ml


def encode_record(row: tuple, contigs: list[tuple[str, int]]) -> bytes:
    _, name, flag, contig, start, mapq, cigar, seq, qual, mm, ml = row
    index = {c: k for k, (c, _) in enumerate(contigs)}
    ops, number = [], ""
    for c in "" if cigar == "*" else cigar:
        if c.isdigit():
            number += c
        else:
            ops.append(int(number) << 4 | _OPS.index(c))
            number = ""
    seq = "" if seq in (None, "*") else seq
    codes = [_BASES.index(c) if c in _BASES else 15 for c in seq.upper()] + [0]
    packed = bytes(codes[k] << 4 | codes[k + 1] for k in range(0, len(seq), 2))
    quality = b"\xff" * len(seq) if qual in (None, "*", "") else bytes(ord(c) - 33 for c in qual)
    body = struct.pack("<iiBBHHHiiii", index.get(contig, -1), (start or 0) - 1, len(name) + 1, mapq or 0, 4680, len(ops), flag, len(seq), -1, -1, 0)
    body += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + quality
    if mm is not None:
        body += b"MMZ" + mm.encode() + b"\0"
    if ml is not None:
        body += b"MLBC" + struct.pack("<i", len(ml)) + bytes(ml)
    return struct.pack("<i", len(body)) + body


def write_bam(path: str, contigs: list[tuple[str, int]], rows: Iterator[tuple], text: str | None = None) -> int:
    """Writes records to one file as they come; returns how many."""
    text = text if text is not None else "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs)
    raw = text.encode()
    head = b"BAM\1" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(contigs))
    for c, n in contigs:
        head += struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n)
    count, held = 0, bytearray(head)
    with open(path, "wb") as f:

        def flush(most: int) -> None:
            while len(held) > most:
                part = bytes(held[:60_000])
                del held[:60_000]
                z = zlib.compressobj(6, zlib.DEFLATED, -15)
                data = z.compress(part) + z.flush()
                f.write(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(data) + 25) + data + struct.pack("<II", zlib.crc32(part), len(part)))

        for row in rows:
            held += encode_record(row, contigs)
            count += 1
            flush(60_000)
        flush(0)
        f.write(_END_BLOCK)
    return count


class _Contig(InputPartition):
    def __init__(self, contig: str | None):
        self.value = contig


class BamReader(DataSourceReader):
    """One partition for each reference sequence asked for, or one for the whole file.

    Without ``contigs`` and with ``mapped`` unset every record is read once, in file order.
    """

    def __init__(self, options: dict):
        self.path, self.wanted = options["path"], [c for c in options.get("contigs", "").split(",") if c]
        self.mapped = options.get("mapped", "false").lower() == "true"
        self.table = options.get("table", "records")

    def partitions(self):
        if self.table == "contigs":
            return [_Contig(None)]
        if self.wanted:
            return [_Contig(c) for c in self.wanted]
        return [_Contig(c) for c, _ in BamStream(self.path).header()[1]] if self.mapped else [_Contig(None)]

    def read(self, partition):
        stream = BamStream(self.path)
        _, contigs = stream.header()
        if self.table == "contigs":
            yield from ((k, c, n) for k, (c, n) in enumerate(contigs))
            return
        name, _, span = (partition.value or "").partition(":")
        low, high = (int(x.replace(",", "")) for x in span.split("-")) if "-" in span else (1, 1 << 62)
        for row in stream.records(contigs):
            if partition.value is None or row[3] == name and row[4] <= high and row[4] + _span(row[6]) > low:
                yield row


def _span(cigar: str) -> int:
    from ..functions.mods import _CIGAR

    return max(1, sum(int(n) for n, op in _CIGAR.findall(cigar or "") if op in "MDN=X"))


class BamDataSource(DataSource):
    """``spark.read.format("bam").load(path)``; options ``contigs`` (names or regions), ``mapped``, ``table=contigs``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "contig_ord int, contig string, length int" if self.options.get("table") == "contigs" else RECORD

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))


def read_bam(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(BamDataSource)
    return spark.read.format("bam").options(**options).load(path)
