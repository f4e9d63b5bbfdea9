"""Benchmark decontamination: a prefix-filtered join of documents with item-sized windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbers, pick, releasing, rows_as_bytes, small_batches

#: A-Z to a-z; every ASCII character but digits and letters to a blank; other bytes stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Text of the benchmark that is held in every worker at once; a larger one is joined block by block.
BLOCK_BYTES = 8_000_000
#: Document words that are handled together.
CHUNK = 200_000


def benchmark_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


class Windows:
    """Distinct windows of a block of items, found in documents by their rarest word."""

    def __init__(self, items: list[tuple], size: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in benchmark_words(text)]
            for k in range(max(1, len(ids) - size + 1) if ids else 0):
                owners.setdefault(tuple(ids[k : k + size]), set()).add(item)
        self.windows = sorted(owners)
        self.owners = [frozenset(owners[w]) for w in self.windows]
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)))
        self.words = np.array([x for w in self.windows for x in w], np.int64)

    def order(self, frequency: np.ndarray) -> None:
        """Each window's prefix under the rarest-first order. All its words must occur, so one word is prefix enough."""
        rank = np.empty(len(self.vocabulary), np.int64)
        rank[np.argsort(frequency, kind="stable")] = np.arange(len(rank))
        at = np.array([min(range(len(w)), key=lambda k: rank[w[k]]) for w in self.windows], np.int64)
        token = self.words[self.offset[:-1] + at]
        self.by_token = np.argsort(token, kind="stable")
        self.at = at
        self.first = np.searchsorted(token[self.by_token], np.arange(len(rank) + 1))
        # the second test reads the rarest of the other words
        self.second = np.array([min((k for k in range(len(w)) if k != a), key=lambda k: rank[w[k]], default=a) for w, a in zip(self.windows, at)], np.int64)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and windows of all occurrences in a run of word ids (-1: no word of any item)."""
        places = np.flatnonzero(ids >= 0)
        counts = self.first[ids[places] + 1] - self.first[ids[places]]
        places, counts = places[counts > 0], counts[counts > 0]
        window = self.by_token[_ranges(self.first[ids[places]], counts)]
        start = np.repeat(places, counts) - self.at[window]
        fits = (start >= 0) & (start + self.length[window] <= len(ids))
        start, window = start[fits], window[fits]
        same = ids[start + self.second[window]] == self.words[self.offset[window] + self.second[window]]
        start, window = start[same], window[same]
        if not len(start):
            return start, window
        size = self.length[window]
        equal = ids[_ranges(start, size)] == self.words[_ranges(self.offset[window], size)]
        good = np.logical_and.reduceat(equal, np.concatenate(([0], np.cumsum(size)[:-1])))
        return start[good], window[good]


def _ids(texts: list, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts in a row, each followed by a -1; where each text starts."""
    words = [benchmark_words(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    ids = np.full(int(starts[-1]), -1, np.int64)
    for w, a in zip(words, starts):
        ids[a : a + len(w)] = np.fromiter(map(vocabulary.get, w, repeat(-1)), np.int64, len(w))
    return ids, starts


def _chunks(texts: list) -> Iterator[slice]:
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or b"") // 5 + 1
        if size > CHUNK:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _frequency(vocabulary: dict[bytes, int]):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            texts = rows_as_bytes(batch, "text")
            for part in _chunks(texts):
                counts += np.bincount(_ids(texts[part], vocabulary)[0] + 1, minlength=len(counts))
        held = np.flatnonzero(counts[1:])
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[1:][held])], ["word", "n"])

    return run


def _found(windows: Windows, texts: list) -> Iterator[tuple[slice, np.ndarray, np.ndarray, dict[int, set]]]:
    """For each chunk of texts: the rows, where each text starts, which words are hit, and each text's items."""
    for part in _chunks(texts):
        ids, starts = _ids(texts[part], windows.vocabulary)
        start, window = windows.find(ids)
        mark = np.zeros(len(ids) + 1, np.int64)
        np.add.at(mark, start, 1)
        np.add.at(mark, start + windows.length[window], -1)
        doc = np.searchsorted(starts, start, side="right") - 1
        items: dict[int, set] = {}
        for d, w in set(zip(doc.tolist(), window.tolist())):
            items.setdefault(d, set()).update(str(x) for x in windows.owners[w] if x is not None)
        yield part, starts, np.cumsum(mark[:-1]) > 0, items


def _judge(sent):
    """The result columns, where all windows are at hand."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = sent.value
        for batch in batches:
            for part, starts, hit, items in _found(windows, rows_as_bytes(batch, "text")):
                total = np.concatenate(([0], np.cumsum(hit)))
                n_words, n_hit = np.diff(starts) - 1, total[starts[1:]] - total[starts[:-1]]
                named = [",".join(sorted(items.get(d, ()))) for d in range(len(n_words))]
                yield pa.RecordBatch.from_arrays(
                    [
                        numbers(batch, "doc_id")[part], pa.array(n_words), pa.array(n_hit), pa.array([len(items.get(d, ())) for d in range(len(n_words))], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in named], pa.string()), pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return run


def _hits(sent):
    """The places and items of the texts that hold windows of a block."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = sent.value
        for batch in batches:
            for part, starts, hit, items in _found(windows, rows_as_bytes(batch, "text")):
                some = sorted({*items, *(np.searchsorted(starts, np.flatnonzero(hit), side="right") - 1).tolist()})
                hits = [np.flatnonzero(hit[starts[d] : starts[d + 1]]) for d in some]
                yield pa.RecordBatch.from_arrays(
                    [numbers(batch, "row")[part].take(pa.array(some, pa.int64())), pa.array(hits, pa.list_(pa.int64())), pa.array([sorted(items.get(d, ())) for d in some], pa.list_(pa.string()))],
                    ["row", "hits", "items"],
                )

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(benchmark_words(t)) for t in rows_as_bytes(batch, "text")]
        yield pa.RecordBatch.from_arrays([numbers(batch, "row"), numbers(batch, "doc_id"), pa.array(n, pa.int64())], ["row", "doc_id", "n_words"])


def _windows(docs: DataFrame, items: DataFrame, size: int):
    """The windows of some items in the order of their words' counts in all documents, for the workers."""
    windows = Windows([(r[0], r[1].encode() if r[1] is not None else None) for r in items.collect()], size)
    counted = docs.select("text").mapInArrow(_frequency(windows.vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(windows.vocabulary), np.int64)
    for r in counted.collect():
        frequency[r["word"]] = r["n"]
    windows.order(frequency)
    return docs.sparkSession.sparkContext.broadcast(windows)


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in blocks of at most so many bytes of text; an item that is larger is a block, or part of one."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= block_bytes:
        return [benchmark]
    parts = 16 * -(-total // block_bytes)
    held = benchmark.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    sizes = {r[0]: r[1] or 0 for r in held.groupBy("part").agg(F.sum(F.octet_length("text"))).collect()}
    bounds, filled = [0], 0
    for part in range(parts):
        if filled and filled + sizes.get(part, 0) > block_bytes:
            bounds.append(part)
            filled = 0
        filled += sizes.get(part, 0)
    return [held.where(F.col("part").between(a, b - 1)).drop("part") for a, b in zip(bounds, [*bounds[1:], parts])]


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Which words of each document lie in an occurrence of a benchmark window.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` needs ``item_id`` and ``text``; other columns aren't
    read. Returns one row per input row: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` (of the
    item ids, sorted as strings and joined by commas) and ``contaminated`` (a hit, and 5 % of the words or more).

    A null or empty text has no words, neither hits. An item without words has no window; one with fewer than
    ``size`` words is one window. Items without id hit but aren't listed; items that share an id count once.
    Repeated documents are judged each. Empty tables: no rows, or no hits.

    Words of the benchmark are counted over all documents; each window is looked up by its rarest word, must
    lie inside the document, and is compared word by word. A worker holds ``block_bytes`` of benchmark text, or one
    larger item: a larger benchmark is taken in blocks, each in two passes of its own, and only hits are kept of each.
    ``docs`` must then give the same rows in the same order each time it is read, as a table of files does.
    """
    small_batches(docs)
    docs, benchmark = pick(docs, "doc_id", "text"), pick(benchmark, "item_id", "text")
    kind, blocks = docs.schema["doc_id"].dataType.simpleString(), _blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        return docs.mapInArrow(_judge(_windows(docs, blocks[0], size)), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    scratch, rows = Scratch(docs.sparkSession, "decontaminate"), docs.withColumn("row", F.monotonically_increasing_id())
    found = None
    for k, items in enumerate(blocks):
        part = scratch.save(rows.select("row", "text").mapInArrow(_hits(_windows(docs, items, size)), "row long, hits array<long>, items array<string>"), f"block-{k}")
        found = part if found is None else found.unionByName(part)
    # a row has one entry a block at most
    met = found.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    met = met.select(F.col("row").alias("at"), F.size(F.array_distinct("hits")).cast("long").alias("hit"), F.array_sort(F.array_distinct("items")).alias("items"))
    told = rows.mapInArrow(_lengths, f"row long, doc_id {kind}, n_words long").join(met, F.col("row") == F.col("at"), "left")
    n_hit, items = F.coalesce("hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return told.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )
