"""Substring dedup: suffix trees of repeated passages, partitioned by prefixes of varying length.

A window's prefix ends with its anchor: the run of ANCHOR words in it that has the least hash. Windows whose anchor lies in
one document only can't repeat; the others are the suffixes. Neighbouring suffixes with one anchor travel together as one
segment of words, and the segments of an anchor, a group that fits memory, are where their subtrees are built: sorted
suffixes, the lengths of the prefixes that neighbours share, and the internal nodes of at least a window's depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_long, mix64, ngram_hashes, numbers, pick, releasing, rows_as_bytes, small_batches
from .words import byte_slices, distinct, find_words, ranges

#: Words of an anchor.
ANCHOR = 8
#: Documents of a group. An anchor of more is dealt to several groups, and what those leave open is settled node by node.
HOT = 256
#: Bytes of text, and rows of segments, that are handled together.
_TEXT, _ROWS = 1_000_000, 4_000
_PLACE = np.uint64((1 << 28) - 1)


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` anchor hashes the place of its smallest, the leftmost of equals."""
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: -(span - width)], low[span - width :])
    return (low & _PLACE).astype(np.int64)


class Windows:
    """The windows of some texts: where each starts, its text, its anchor's hash and place."""

    def __init__(self, texts: pa.Array, size: int):
        self.words = find_words(texts)
        self.hashes = self.words.hashes()
        first, n = self.words.first, len(self.hashes)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.start = np.flatnonzero(text[: n - size + 1] == text[size - 1 :]) if n >= size else np.empty(0, np.int64)
        self.text = text[self.start]
        grams = ngram_hashes(self.hashes, ANCHOR)
        self.place = anchors(grams, size - ANCHOR + 1)[self.start] if len(self.start) else self.start
        self.anchor = grams[self.place]

    def classes(self) -> np.ndarray:
        """A hash of each text's word sequence."""
        first = self.words.first
        place = np.arange(len(self.hashes)) - np.repeat(first[:-1], np.diff(first))
        value = np.append(mix64(self.hashes) * (mix64(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1)), np.uint64(0))
        total = np.add.reduceat(value, first[:-1]) if len(first) > 1 else np.empty(0, np.uint64)
        count = np.diff(first)
        return mix64(np.where(count > 0, total, 0) + count.astype(np.uint64)).view(np.int64)


def _first_pass(size: int):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(numbers(batch, "text"), _TEXT):
                rows = batch.slice(part.start, part.stop - part.start)
                found = Windows(numbers(rows, "text"), size)
                count = found.words.counts()
                whole = [hashlib.sha256(b" ".join((t or b"").split())).hexdigest() for t in rows_as_bytes(rows, "text")]
                new = np.ones(len(found.place), bool)
                new[1:] = found.place[1:] != found.place[:-1]
                text, anchor = found.text[new], found.anchor[new]
                order = np.lexsort((anchor, text))
                text, anchor = text[order], anchor[order]
                once = np.ones(len(text), bool)
                once[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
                offsets = np.searchsorted(text[once], np.arange(len(rows) + 1)).astype(np.int32)
                classes = pa.array(found.classes(), mask=count < size)
                yield pa.RecordBatch.from_arrays(
                    [numbers(rows, "doc_id"), pa.array(count), classes, pa.array(whole, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), as_long(anchor[once]))],
                    ["doc_id", "n_words", "class", "whole", "anchors"],
                )

    return run


_SEGMENT = ["grp", "salted", "doc_id", "class", "starts", "words"]


def _segments(size: int):
    """Runs of windows with one anchor that several documents hold: the group, and the words from the first window to the last.

    Equal segments of a document are one row with all their starts.
    """

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(numbers(batch, "text"), _TEXT):
                rows = batch.slice(part.start, part.stop - part.start)
                found = Windows(numbers(rows, "text"), size)
                held, spread = numbers(rows, "anchors"), numbers(rows, "spread").flatten().to_numpy()
                same = (found.classes() == numbers(rows, "class").to_numpy())[found.text]
                # anchors and texts as one key
                salt = mix64(np.arange(1, len(rows) + 1, dtype=np.uint64))
                keys = mix64(held.flatten().to_numpy().view(np.uint64) + np.repeat(salt, held.value_lengths().to_numpy()))
                order = np.argsort(keys)
                asked = mix64(found.anchor + salt[found.text])
                at = order[np.minimum(np.searchsorted(keys, asked, sorter=order), len(keys) - 1)] if len(keys) else np.zeros(len(asked), np.int64)
                good = np.flatnonzero(same & (keys[at] == asked)) if len(keys) else np.empty(0, np.int64)
                if not len(good):
                    continue
                start, place = found.start[good], found.place[good]
                new = np.ones(len(good), bool)
                new[1:] = (start[1:] != start[:-1] + 1) | (place[1:] != place[:-1])
                a = np.flatnonzero(new)
                b = np.append(a[1:], len(good)) - 1
                first, last, text, many = start[a], start[b] + size - 1, found.text[good[a]], spread[at[good[a]]]
                doc = numbers(rows, "doc_id").to_numpy()[text]
                salts = np.maximum(1, -(-many // HOT))
                dealt = mix64(doc.astype(np.uint64) + np.uint64(17)) % salts.astype(np.uint64)
                group = mix64(found.anchor[good[a]] + mix64(dealt))
                data, begin, end = found.words.data, found.words.start[first].tolist(), found.words.end[last].tolist()
                seen: dict[tuple, list] = {}
                for k, key in enumerate(zip(text.tolist(), (b" ".join(data[x:y].split()) for x, y in zip(begin, end)))):
                    seen.setdefault(key, [k, []])[1].append(k)
                one = np.array([k for k, _ in seen.values()], np.int64)
                starts = [(first[k] - found.words.first[text[k]]).tolist() for _, k in seen.values()]
                classes = numbers(rows, "class").to_numpy()[text]
                yield pa.RecordBatch.from_arrays(
                    [as_long(group[one]), pa.array(salts[one] > 1), pa.array(doc[one]), pa.array(classes[one]), pa.array(starts, pa.list_(pa.int64())), pa.array([words for _, words in seen], pa.binary())],
                    _SEGMENT,
                )

    return run


class Subtrees:
    """The subtrees of some groups: suffixes sorted by their first ``size`` words, and the prefixes that neighbours share.

    ``codes`` has the words of all segments in a row, each word a number; ``first`` where each segment begins. Every place
    that at least ``size`` words of its segment follow is a suffix.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray, group: np.ndarray, size: int):
        self.codes, self.size = codes, size
        length = np.diff(first)
        self.end = np.repeat(first[1:], length)
        self.segment = np.repeat(np.arange(len(length)), length)
        # ranks[k]: equal for places from which the same 2^k words follow
        self.ranks = [codes]
        while 2 << (len(self.ranks) - 1) <= size:
            self.ranks.append(self._joined(self.ranks[-1], self.ranks[-1], 1 << (len(self.ranks) - 1)))
        whole = 1 << (len(self.ranks) - 1)
        exact = self._joined(self.ranks[-1], self.ranks[-1], size - whole) if size > whole else self.ranks[-1]
        suffix = np.flatnonzero(np.arange(len(codes)) + size <= self.end)
        self.suffix = suffix[np.argsort(group[self.segment[suffix]] << 32 | exact[suffix], kind="stable")]
        self.shared = self._shared(group)

    def _joined(self, a: np.ndarray, b: np.ndarray, far: int) -> np.ndarray:
        """Ranks of what follows a place and the place ``far`` behind it; past the end of all words there is 0."""
        return distinct(a.astype(np.uint64) << np.uint64(32) | np.append(b[far:], np.zeros(far, np.int64)).astype(np.uint64))[2]

    def _shared(self, group: np.ndarray) -> np.ndarray:
        """How many words each suffix shares with the one before it in the order, up to twice the largest rank's."""
        here, before = self.suffix.copy(), np.roll(self.suffix, 1)
        shared = np.zeros(len(here), np.int64)
        alike = group[self.segment[here]] == group[self.segment[before]]
        alike[:1] = False
        for k in (len(self.ranks) - 1, *range(len(self.ranks) - 1, -1, -1)):
            fits = alike & (here + (1 << k) <= self.end[self.suffix]) & (before + (1 << k) <= self.end[np.roll(self.suffix, 1)])
            at = np.flatnonzero(fits)
            at = at[self.ranks[k][here[at]] == self.ranks[k][before[at]]]
            for x in (here, before, shared):
                x[at] += 1 << k
        return shared

    def deep_nodes(self) -> np.ndarray:
        """Where, in the order of suffixes, the leaves of each internal node of depth ``size`` or more begin; other leaves are nodes alone."""
        return np.flatnonzero(self.shared < self.size)


_REPEAT = ["class", "begin", "end", "node", "doc_id"]


def _subtrees(size: int):
    """Repeats of each document, from segments sorted by group: windows ``begin`` to ``end`` of a class lie in an earlier document.

    In a group that is one of several of its anchor, a node's leaves of the first document are open: they come with the
    ``node``, a digest of its words, and their ``doc_id``.
    """

    def judge(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = find_words(numbers(rows, "words"))
        codes = distinct(words.hashes())[2]
        group = distinct(numbers(rows, "grp").to_numpy().view(np.uint64))[2]
        tree = Subtrees(codes, words.first, group, size)
        segment = tree.segment[tree.suffix]
        doc = numbers(rows, "doc_id").to_numpy()
        nodes = tree.deep_nodes()
        own = doc[segment]
        count = np.diff(np.append(nodes, len(segment)))
        least = np.repeat(np.minimum.reduceat(own, nodes), count)
        offset = tree.suffix - words.first[segment]
        starts, classes = numbers(rows, "starts"), numbers(rows, "class").to_numpy()
        at, many, flat = starts.offsets.to_numpy() - starts.offsets[0].as_py(), starts.value_lengths().to_numpy(), starts.flatten().to_numpy()

        def placed(segment: np.ndarray, offset: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Class, first and last start of runs of suffixes, at each place where their segment lies."""
            n = many[segment]
            begin = flat[ranges(at[:-1][segment], n)] + np.repeat(offset, n)
            return np.repeat(classes[segment], n), begin, begin + np.repeat(span, n)

        later = np.flatnonzero(own > least)
        order = later[np.lexsort((offset[later], segment[later]))]
        if len(order):
            new = np.ones(len(order), bool)
            new[1:] = (segment[order][1:] != segment[order][:-1]) | (offset[order][1:] != offset[order][:-1] + 1)
            a = np.flatnonzero(new)
            cls, begin, end = placed(segment[order[a]], offset[order[a]], np.diff(np.append(a, len(order))))
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(begin), pa.array(end), pa.nulls(len(cls), pa.binary()), pa.nulls(len(cls), pa.int64())], _REPEAT)
        salted = numbers(rows, "salted").to_numpy(zero_copy_only=False)[segment]
        still = np.flatnonzero(salted & (own == least))
        if len(still):
            number = np.repeat(np.arange(len(nodes)), count)[still]
            digests: dict[int, bytes] = {}
            for k, p in zip(number.tolist(), tree.suffix[still].tolist()):
                if k not in digests:
                    digests[k] = hashlib.blake2b(words.data[words.start[p] : words.end[p + size - 1]], digest_size=16).digest()
            n = many[segment[still]]
            cls, begin, end = placed(segment[still], offset[still], np.ones(len(still), np.int64))
            told = [digests[k] for k in np.repeat(number, n).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(begin), pa.array(end), pa.array(told, pa.binary()), pa.array(np.repeat(own[still], n))], _REPEAT)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                group = numbers(part, "grp").to_numpy()
                # groups end where the next begins; the last one may go on
                cut = int(np.searchsorted(group, group[-1]))
                if cut or (held and numbers(held[-1], "grp")[-1].as_py() != group[0]):
                    done = pa.concat_batches([*held, part.slice(0, cut)])
                    held = []
                    if done.num_rows:
                        yield from judge(done)
                held.append(part.slice(cut))
        if held and (rest := pa.concat_batches(held)).num_rows:
            yield from judge(rest)

    return run


def _cut(size: int):
    """What is left of each class's words, and which runs of them go."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(numbers(batch, "text"), _TEXT):
                rows = batch.slice(part.start, part.stop - part.start)
                found = Windows(numbers(rows, "text"), size)
                same = np.flatnonzero(found.classes() == numbers(rows, "class").to_numpy())
                gone, left, spans = [], [], []
                texts = rows_as_bytes(rows, "text")
                for k in same.tolist():
                    words = texts[k].split()
                    runs = np.array([(r["begin"], r["end"]) for r in numbers(rows, "runs")[k].as_py()], np.int64)
                    mark = np.zeros(len(words) + 1, np.int64)
                    np.add.at(mark, runs[:, 0], 1)
                    np.add.at(mark, runs[:, 1] + size - 1, -1)
                    cover = np.cumsum(mark[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], cover, [False])).astype(np.int8)))
                    gone.append(int(cover.sum()))
                    left.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~cover)])).hexdigest())
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [numbers(rows, "class").take(pa.array(same)), pa.array(gone, pa.int64()), pa.array(left, pa.string()), pa.array(spans, shape)], ["class", "n_gone", "left_sha256", "gone"]
                )

    return run


def substring_dedup(docs: DataFrame, size: int = 50) -> DataFrame:
    """Removes each word covered by a window of ``size`` words that also starts in a document of smaller doc_id.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns aren't read; ``size`` is more than ANCHOR. Returns one row
    per input row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (the kept words joined by one blank) and
    ``spans`` (the longest runs of words that go, ``start`` to before ``end``, by their place among the text's words).

    Windows are judged on the input. Null, empty and short texts lose nothing; repeats inside one document
    stay. Rows that share a doc_id don't count against each other. A row without doc_id neither loses words
    nor takes any from others. An empty table gives an empty result.

    Equal word sequences form a class, of which only the first is searched. Suffixes are dealt to groups as the module
    says; in each subtree the leaves of a node as deep as a window are its occurrences, and all but those of the smallest
    document are repeats. An anchor in more than HOT documents is dealt to as many more groups, by document; each tells
    its smallest document of every node, and the smallest of those settles the rest.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "substring-dedup")
    small_batches(docs)
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = scratch.save(docs.mapInArrow(_first_pass(size), "doc_id long, n_words long, class long, whole string, anchors array<long>"), "rows")
    classes = rows.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    firsts = rows.join(classes, ["class", "doc_id"]).select("class", "doc_id", F.explode("anchors").alias("anchor"))
    spread = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    held = firsts.join(spread, "anchor").groupBy("class", "doc_id").agg(F.collect_list(F.struct("anchor", "n")).alias("x"))
    held = scratch.save(held.select("class", "doc_id", F.col("x.anchor").alias("anchors"), F.col("x.n").alias("spread")), "held")
    texts = scratch.save(docs.join(held, "doc_id"), "texts")
    segments = texts.mapInArrow(_segments(size), "grp long, salted boolean, doc_id long, class long, starts array<long>, words binary")
    shape = "class long, begin long, end long, node binary, doc_id long"
    found = scratch.save(segments.repartition("grp").sortWithinPartitions("grp").mapInArrow(_subtrees(size), shape), "found")
    still = found.where("node is not null")
    least = still.groupBy("node").agg(F.min("doc_id").alias("least"))
    settled = still.join(least, "node").where("doc_id > least").select("class", "begin", "end")
    runs = found.where("node is null").select("class", "begin", "end").unionByName(settled).groupBy("class").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    span = "array<struct<start:long,end:long>>"
    cut = texts.select("class", "text").join(runs, "class").mapInArrow(_cut(size), f"class long, n_gone long, left_sha256 string, gone {span}").dropDuplicates(["class"])
    nothing = hashlib.sha256(b"").hexdigest()
    told = rows.select("doc_id", "n_words", "class", "whole").join(classes.withColumnRenamed("doc_id", "first_doc"), "class", "left").join(cut, "class", "left")
    copy = F.col("doc_id") > F.col("first_doc")
    judged = F.col("doc_id").isNotNull() & F.col("n_gone").isNotNull()
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return told.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).when(judged, F.col("n_gone")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(nothing)).when(judged, F.col("left_sha256")).otherwise(F.col("whole")).alias("kept_sha256"),
        F.when(copy, all_of_it).when(judged, F.col("gone")).otherwise(F.array().cast(span)).alias("spans"),
    )
