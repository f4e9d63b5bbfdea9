"""Token-id files: shards of raw ids with a minimal perfect hash from document keys to their places."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import ASCII_LOWER, MASK64, mix64, numbers, pick, releasing, shared_folder, small_batches
from .token_counts import byte_letters
from .words import Words, byte_slices, distinct, find_words, ranges

MAGIC = b"MWTOKEN1"


class PerfectHash:
    """Minimal perfect hash of distinct integers: a cascade of bit arrays.

    At each level a key that is alone on its bit is placed there and the others move on; a key's number is
    the rank of its bit. A key outside the set gets some number too, so that callers compare fingerprints.
    """

    SPREAD = 2

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.ranks, base = [], 0
        for level in bits:
            self.ranks.append(base + np.cumsum(level) - level)
            base += int(level.sum())
        self.size = base

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys.astype(np.int64).view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & MASK64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, rest = [], keys
        while len(rest):
            at = cls.place(rest, len(bits), size := cls.SPREAD * len(rest) + 1)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone.astype(np.int64))
            rest = rest[~alone[at]]
        return cls(bits)

    def number(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            left = np.flatnonzero(out < 0)
            if not len(left):
                break
            at = self.place(keys[left], level, len(bits))
            out[left] = np.where(bits[at] == 1, ranks[at], -1)
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder; local, HDFS and object stores alike."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard: ids as they come, in the integers of ``kind``, then the index, then a footer that tells where all is."""

    def __init__(self, uri: str, kind: str):
        self.files, self.path = open_store(uri)
        self.kind, self.width = kind, np.dtype(kind).itemsize
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.keys, self.valid, self.positions, self.lengths = [], [], [], []

    def add(self, keys: pa.Array, ids: np.ndarray, lengths: np.ndarray, positions: np.ndarray | None = None) -> None:
        """Adds records: all their ids in a row, and how many each has."""
        self.out.write(ids.astype(self.kind).tobytes())
        self.keys.append(keys.fill_null(0).to_numpy().astype(np.int64))
        self.valid.append(keys.is_valid().to_numpy(zero_copy_only=False))
        if positions is not None:
            self.positions.append(positions)
        self.lengths.append(lengths)

    def close(self) -> None:
        self.lengths, keys, valid = (np.concatenate(x) for x in (self.lengths, self.keys, self.valid))
        lengths = self.lengths
        # records in the order of their keys: those of a key needn't lie side by side
        records = np.flatnonzero(valid)
        records = records[np.argsort(keys[records], kind="stable")]
        distinct, first, copies = np.unique(keys[records], return_index=True, return_counts=True)
        perfect = PerfectHash.build(distinct)
        slot = perfect.number(distinct)
        prints, places, counts = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        prints[slot], places[slot], counts[slot] = fingerprint(distinct), first, copies
        parts = {"keys": keys, "valid": valid, "lengths": lengths, "prints": prints, "places": places, "copies": counts}
        parts["positions"] = np.concatenate([np.empty(0), *self.positions])
        if (np.diff(records) < 0).any():
            parts["records"] = records
        parts |= {f"bits{k}": np.packbits(b.astype(bool)) for k, b in enumerate(perfect.bits)}
        told, at = {"ids": self.kind, "levels": [len(b) for b in perfect.bits], "parts": {}}, len(MAGIC) + self.width * int(lengths.sum())
        for name, values in parts.items():
            self.out.write(raw := values.tobytes())
            told["parts"][name] = [at, len(raw), values.dtype.str]
            at += len(raw)
        self.out.write(foot := json.dumps(told).encode())
        self.out.write(struct.pack("<q", len(foot)) + MAGIC)
        self.out.close()


class Shard:
    """Reads a shard by key in constant time, or in order."""

    def __init__(self, uri: str):
        files, path = open_store(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        length = struct.unpack("<q", tail[:8])[0]
        told = json.loads(self.file.read_at(length, size - 8 - len(MAGIC) - length))
        part = lambda n: np.frombuffer(self.file.read_at(told["parts"][n][1], told["parts"][n][0]), told["parts"][n][2])
        self.keys, self.valid, lengths = part("keys"), part("valid"), part("lengths")
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.kind = np.dtype(told["ids"])
        self.prints, self.places, self.copies = part("prints"), part("places"), part("copies")
        #: Where in training each record comes; empty in a shard that is in key order.
        self.positions = part("positions")
        self.records = part("records") if "records" in told["parts"] else np.flatnonzero(self.valid)
        self.perfect = PerfectHash([np.unpackbits(part(f"bits{k}"), count=n).astype(np.int64) for k, n in enumerate(told["levels"])])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``records`` each key's begin, and how many they are; 0 for a key that the shard doesn't hold."""
        slot = self.perfect.number(keys)
        if not len(self.prints):
            return slot, np.zeros(len(keys), np.int64)
        good = (slot >= 0) & (self.prints[slot] == fingerprint(keys))
        first = np.where(good, self.places[slot], -1)
        good &= self.keys[self.records[first]] == keys
        return np.where(good, first, -1), np.where(good, self.copies[slot], 0)

    def ids(self, record: int, end: int | None = None) -> np.ndarray:
        """The ids of the record, or of all from it to before ``end``, as little-endian unsigned 32-bit integers."""
        a, b = int(self.starts[record]), int(self.starts[record + 1 if end is None else end])
        raw = self.file.read_at(self.kind.itemsize * (b - a), len(MAGIC) + self.kind.itemsize * a)
        return np.frombuffer(raw, self.kind).astype("<u4")


@lru_cache(2)
def _tokenizer(path: str) -> Tokenizer:
    # tasks run side by side already
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


def id_kind(path: str, end_id: int) -> str:
    """The integers that hold every id of the model and the end id: of two bytes if they do, else of four."""
    return "<u2" if max([end_id, *_tokenizer(path).get_vocab(with_added_tokens=True).values()]) < 1 << 16 else "<u4"


#: Small Latin letters that the model's first steps leave alone, in one run: only its merges are left to do.
_PLAIN = re.compile("[a-zà-öø-ÿ]+").fullmatch
_LETTERS = dict(enumerate(byte_letters()))
#: How a model must treat texts that are encoded word by word. Fixed values of the tokenizer file's format.
_BY_WORDS = (
    ["NFC", "Replace", "Lowercase"],
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
)


@lru_cache(2)
def by_words(path: str) -> bool:
    """Whether the model drops white space, lower-cases and parts letters from marks, so that words can be encoded alone."""
    told = json.loads(_tokenizer(path).to_str())
    steps = lambda kind, name: (told[kind] or {}).get(name, [])
    return ([x["type"] for x in steps("normalizer", "normalizers")], *steps("pre_tokenizer", "pretokenizers")) == _BY_WORDS


class WordIds:
    """Ids of words between white space, known by hashes of their pieces; the library encodes each new piece once.

    The model drops white space and never looks across it, so a text's ids are those of its words in a row.
    """

    LIMIT = 800_000

    def __init__(self, kind: str):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size, self.pool = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.kind)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is held, -1 for those that aren't."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def learn(self, pieces: list[str], keys: np.ndarray, model: Tokenizer) -> None:
        merge, ids, size = model.model.tokenize, [], np.empty(len(pieces), np.int64)
        other = []
        for k, x in enumerate(pieces):
            if not _PLAIN(x):
                other.append(k)
                continue
            found = merge(x if x.isascii() else x.encode().decode("latin-1").translate(_LETTERS))
            size[k] = len(found)
            ids += [t.id for t in found]
        order = np.concatenate((np.delete(np.arange(len(pieces)), other), np.array(other, np.int64)))
        for a in range(0, len(other), 20_000):
            for k, e in zip(other[a : a + 20_000], model.encode_batch_fast([pieces[k] for k in other[a : a + 20_000]], add_special_tokens=False)):
                size[k] = len(e.ids)
                ids += e.ids
        at = np.empty(len(pieces), np.int64)
        at[order] = len(self.pool) + np.cumsum(size[order]) - size[order]
        self.pool = np.concatenate((self.pool, np.array(ids, self.kind)))
        order = np.argsort(keys := np.concatenate((self.keys, keys)))
        self.keys, self.at, self.size = keys[order], np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]

    def texts(self, texts: pa.Array, model: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        pieces = word_pieces(find_words(texts))
        keys, place, number = distinct(pieces.hashes())
        if len(self.keys) + (new := self.find(keys) < 0).sum() > self.LIMIT:
            self.clear()
            new[:] = True
        if new.any():
            some = place[new]
            self.learn([pieces.data[a:b].decode() for a, b in zip(pieces.start[some].tolist(), pieces.end[some].tolist())], keys[new], model)
        held = self.find(keys)
        at, size = self.at[held][number], self.size[held][number]
        total = np.concatenate(([0], np.cumsum(size)))
        return self.pool[ranges(at, size)], np.diff(total[pieces.first])


def _whole_texts(texts: pa.Array, model: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """As ``WordIds.texts``, for any other kind of model."""
    found = [e.ids for e in model.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
    return np.array([i for ids in found for i in ids], np.int64), np.array([len(ids) for ids in found], np.int64)


_MARK = np.isin(np.arange(256), list(b".,;:!?|*$%&#"))
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def word_pieces(words: Words) -> Words:
    """Words as lower-case letters and the marks behind them, which the model parts as well; others whole.

    A word in which a capital comes before another character than ASCII stays as it is: the model composes marks
    first, and some letters compose as small ones only. So does one that may hold a special string. All else of ASCII
    composes with nothing.
    """
    data, start, end = np.frombuffer(words.data, np.uint8), words.start, words.end
    if not len(start):
        return words
    code = np.append(data, 32)
    odd = np.flatnonzero((code[:-1] >= 65) & (code[:-1] <= 90) & (code[1:] >= 128) | (code[:-1] == 60) & (code[1:] == 124))
    whole = np.searchsorted(odd, start) < np.searchsorted(odd, end - 1)
    lowered = bytearray(words.data.translate(ASCII_LOWER))
    kept = ranges(start[whole], end[whole] - start[whole])
    np.frombuffer(lowered, np.uint8)[kept] = data[kept]
    mark = np.frombuffer(words.data.translate(bytes(_MARK.tolist())), bool)
    core = end.copy()
    while len(more := np.flatnonzero((core > start) & mark[core - 1])):
        core[more] -= 1
        if len(more) < len(core) // 64:
            # long runs of marks are rare: one by one
            for k in more.tolist():
                text = words.data[start[k] : core[k]]
                core[k] = start[k] + len(text.rstrip(b".,;:!?|*$%&#"))
            break
    two = ~whole & (core < end) & (core > start) & _LETTER[data[np.maximum(core, 1) - 1]]
    counts = 1 + two
    last = np.cumsum(counts) - 1
    starts, ends = np.repeat(start, counts), np.repeat(end, counts)
    starts[last[two]], ends[last[two] - 1] = core[two], core[two]
    return Words(bytes(lowered), starts, ends, np.concatenate(([0], last + 1))[words.first])


@lru_cache(1)
def _known(path: str, kind: str) -> WordIds:
    """Kept between the tasks of a worker, which see much the same words."""
    return WordIds(kind)


def write_store(docs: DataFrame, folder: str, path: str, end_id: int, position: str | None = None, shard_bytes: int = 16 << 20) -> list[dict]:
    """Writes all texts' ids in ascending order of ``position``, if given, and of doc_id; returns the shards in that order.

    A shard holds about ``shard_bytes`` of text; the list of shards grows with the table, by some 100 bytes each.
    """
    kind = id_kind(path, end_id)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, apart, out, uri = _tokenizer(path), _known(path, kind), by_words(path), None, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = ShardWriter(uri := f"{folder}/{uuid.uuid4().hex}.tok", kind)
            for part in byte_slices(numbers(batch, "text"), 1_000_000):
                ids, lengths = known.texts(numbers(batch, "text")[part], model) if apart else _whole_texts(numbers(batch, "text")[part], model)
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                out.add(numbers(batch, "doc_id")[part], ids, lengths + 1, numbers(batch, position)[part].to_numpy().astype(np.float64) if position else None)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"uri": uri, "part": TaskContext.get().partitionId(), "records": len(out.lengths), "ids": int(out.lengths.sum())}])

    order = [*([position] if position else []), "doc_id", "tie"]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // shard_bytes))
    ordered = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, *order).sortWithinPartitions(*order).drop("tie")
    found = ordered.mapInArrow(run, "uri string, part long, records long, ids long").collect()
    return [r.asDict() for r in sorted(found, key=lambda r: r["part"])]


def read_store(spark, shards: list[dict]) -> DataFrame:
    """Every record of the shards: doc_id, start, n_tokens, ids_crc32; each found by its key through the index."""
    base, rows = 0, []
    for s in shards:
        rows.append((s["uri"], base))
        base += s["ids"]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(uri)
                yield from _records(shard, np.flatnonzero(~shard.valid), first_id, None)
                keys = np.unique(shard.keys[shard.valid])
                first, copies = shard.find(keys)
                if (first < 0).any():
                    raise ValueError(f"{uri}: the index misses a key")
                found = shard.records[ranges(first, copies)]
                order = np.argsort(found)
                yield from _records(shard, found[order], first_id, np.repeat(keys, copies)[order])

    shape = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], shape)
    listed = spark.createDataFrame(rows, "uri string, first_id long").repartition(len(rows))
    return listed.mapInArrow(run, shape)


def _records(shard: Shard, record: np.ndarray, base: int, keys: np.ndarray | None, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows of ascending records; those that lie side by side are read together, up to ``most`` ids."""
    a = 0
    while a < len(record):
        side = np.flatnonzero(np.diff(record[a:]) != 1)
        b = a + 1 + int(side[0]) if len(side) else len(record)
        b = max(a + 1, min(b, int(np.searchsorted(shard.starts[record + 1], shard.starts[record[a]] + most, side="right"))))
        part, ids = record[a:b], shard.ids(int(record[a]), int(record[b - 1]) + 1)
        start, end = shard.starts[part], shard.starts[part + 1]
        at = memoryview(ids).cast("B")
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(b - a, pa.int64()) if keys is None else pa.array(keys[a:b]),
                pa.array(base + start),
                pa.array(end - start),
                pa.array([zlib.crc32(at[4 * x : 4 * y]) for x, y in zip((start - start[0]).tolist(), (end - start[0]).tolist())], pa.int64()),
            ],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )
        a = b


def token_store(docs: DataFrame, path: str, end_id: int, folder: str | None = None, position: str | None = None) -> DataFrame:
    """Encodes all texts into shard files and reads them back by key.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns aren't read. ``folder`` is where the shards go
    (by default a new one below the shared folder). Returns ``doc_id``, ``start`` (ids of all records before
    it), ``n_tokens`` (with the end id) and ``ids_crc32``, one row per input row.

    Null and empty texts have the end id only. Rows without doc_id come first and are read in order, as they
    have no key. Rows that repeat a doc_id lie side by side, ordered by a hash of their text. An empty table
    gives no shard and no rows. With ``position``, a column of numbers without nulls, records lie in its order
    first, and the shards hold it. A task that runs again writes another file; only files of tasks that
    succeeded are listed.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    small_batches(docs)
    docs = pick(docs, "doc_id", "text", *([position] if position else [])).withColumn("doc_id", F.col("doc_id").cast("long"))
    return read_store(spark, write_store(docs, folder, path, end_id, position))
