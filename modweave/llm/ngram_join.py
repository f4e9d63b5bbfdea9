"""N-gram Jaccard join: prefix trees of globally ordered shingle sets, partitioned by set signatures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyBits, Scratch, as_long, mix64, ngram_hashes, numbers, pick, releasing, small_batches, sorted_groups
from .components import connected_components
from .words import byte_slices, find_words

#: A signature that more classes than this share is set aside; see ``_scan_signatures``.
HOT = 24
#: Shingles of one block of a candidate family; a larger family is split into blocks.
BLOCK = 1_500_000
#: Classes that a task remembers to have sent.
SENT = 1_000_000


@dataclass(frozen=True)
class JoinRule:
    """Words in a shingle, and the least similarity as the fraction ``num / den``."""

    words: int = 5
    num: int = 4
    den: int = 5

    def levels(self, n: int) -> list[tuple[int, int, bool]]:
        """Levels of a set of ``n`` shingles: (level, parts, whether it is one of the level's larger sets).

        Level k serves pairs whose larger set has ``S[k]`` to ``S[k+1]-1`` shingles. Such a pair that links
        differs by at most ``d`` shingles, so all but ``d`` parts of the hash range hold the same shingles in
        both. What parts there are beyond ``d`` allows for empty parts, for hot ones, and for a number that
        must be shared. Levels with ``d = 0`` link equal sets only and are left out.
        """
        out = []
        for k, (low, high) in enumerate(zip(_SIZES, _SIZES[1:])):
            if -(-low * self.num // self.den) > n:
                break
            if n < high and (d := self.difference(k)):
                empty = d * (self.den - self.num) // (2 * self.den)
                out.append((k, d + 1 + self.shared(k) + self.hot(k) + empty, n >= low))
        return out

    def difference(self, level: int) -> int:
        return 2 * (_SIZES[level + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def shared(self, level: int) -> int:
        """Two sets share more than so many parts that are neither empty nor hot, if empty ones are as few as allowed for."""
        return 2 + self.difference(level) // 12

    def hot(self, level: int) -> int:
        """A set with no more hot parts than this needs none of them."""
        return 1 + self.difference(level) // 6


_SIZES = [1]
while _SIZES[-1] < 1 << 32:
    _SIZES.append(max(_SIZES[-1] + 1, _SIZES[-1] * 5 // 4))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text sorted distinct hashes of its shingles; fewer words than a shingle has make one, none make none."""
    for part in byte_slices(texts, 1_000_000):
        held = find_words(texts[part])
        found = held.hashes(lower=True)
        every = ngram_hashes(found, words)
        for a, b in zip(held.first[:-1].tolist(), held.first[1:].tolist()):
            if b - a < words:
                yield ngram_hashes(found[a:b], b - a, seed=101 + b - a) if b > a else found[:0]
                continue
            grams = np.sort(every[a : b - words + 1])
            yield grams[np.concatenate(([True], grams[1:] != grams[:-1]))]


def _class_of(grams: np.ndarray) -> int:
    return int(mix64(np.array([np.sum(mix64(grams + np.uint64(77)))], np.uint64) + np.uint64(len(grams))).view(np.int64)[0])


def _sizes(rule: JoinRule):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(len(s), _class_of(s) if len(s) else None) for s in shingle_sets(numbers(batch, "text"), rule.words)]
            yield pa.RecordBatch.from_arrays(
                [numbers(batch, "doc_id"), numbers(batch, "text_hash"), pa.array([n for n, _ in told], pa.int64()), pa.array([c for _, c in told], pa.int64())],
                ["doc_id", "text_hash", "n_shingles", "class"],
            )

    return run


def _signatures(rule: JoinRule):
    def of_set(grams: np.ndarray, cls: int) -> Iterator[tuple]:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(grams))))
        for level, parts, larger in rule.levels(len(grams)):
            part = np.arange(parts, dtype=np.uint64)
            edges = np.searchsorted(grams, part[1:] * np.uint64((1 << 64) // parts))
            bounds = np.concatenate(([0], edges, [len(grams)]))
            full = bounds[1:] > bounds[:-1]
            # parts that are surely shared with any set it links to, and neither empty nor hot
            sure = int(full.sum()) - rule.difference(level) - rule.hot(level)
            need = min(max(sure, 1), 1 + rule.shared(level), 255)
            chosen = np.flatnonzero(full) if sure >= 1 else np.arange(parts)
            held = sums[bounds[chosen + 1]] - sums[bounds[chosen]]
            code = level << 8 | need
            yield mix64(held * np.uint64(0x9E3779B97F4A7C15) + part[chosen] + np.uint64(level << 32)), cls, code if larger else -code

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            found: list[tuple] = []
            rows = 0
            for grams in shingle_sets(numbers(batch, "text"), rule.words):
                if len(grams) and (cls := _class_of(grams)) not in sent:
                    # a class sends once from each task; what it sends again, the scan drops
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add(cls)
                    new = list(of_set(grams, cls))
                    found += new
                    rows += sum(len(s) for s, _, _ in new)
                if rows > 200_000:
                    yield _signature_batch(found)
                    found, rows = [], 0
            if found:
                yield _signature_batch(found)

    return run


def _signature_batch(found: list[tuple]) -> pa.RecordBatch:
    lengths = [len(s) for s, _, _ in found]
    return pa.RecordBatch.from_arrays(
        [
            as_long(np.concatenate([s for s, _, _ in found])),
            pa.array(np.repeat(np.array([c for _, c, _ in found], np.int64), lengths)),
            pa.array(np.repeat(np.array([v for _, _, v in found], np.int32), lengths)),
        ],
        ["sig", "class", "code"],
    )


def _scan_signatures(rule: JoinRule):
    """Pairs of classes that share a signature, from rows sorted by (signature, class).

    A signature of up to HOT classes gives its pairs, a bounded number. Signatures of more classes come out
    row by row (``sig`` set): a class whose hot signatures at a level are no more than the rule allows shares
    others with all that it links to and needs none of them.
    """
    allowed = np.array([rule.hot(k) for k in range(len(_SIZES) - 1)], np.int32)
    names = ["sig", "a", "b", "level", "larger", "bound"]

    def hot_rows(sig, node, code) -> pa.RecordBatch:
        larger, k = code > 0, np.abs(code) >> 8
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(k.astype(np.int32)), pa.array(larger), pa.array(allowed[k])], names)

    def pair_rows(node, code, starts, counts) -> Iterator[pa.RecordBatch]:
        """Pairs of all groups of one size at once; a pair holds one of the level's larger sets at least."""
        for size in np.unique(counts):
            first, second = np.triu_indices(int(size), 1)
            step = max(1, 200_000 // len(first))
            own = starts[counts == size]
            for k in range(0, len(own), step):
                a, b = ((own[k : k + step, None] + x).ravel() for x in (first, second))
                good = (code[a] > 0) | (code[b] > 0)
                a, b = a[good], b[good]
                if len(a):
                    need = np.maximum(np.abs(code[a]) & 255, np.abs(code[b]) & 255)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(a), pa.int64()), pa.array(node[a]), pa.array(node[b]), pa.array(np.abs(code[a]) >> 8), pa.nulls(len(a), pa.bool_()), pa.array(need)], names
                    )

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        streamed: int | None = None
        for batch in _and_last(batches):
            if batch is not None:
                new = [numbers(batch, c).to_numpy() for c in ("sig", "class", "code")]
                sig, node, code = (np.concatenate(x) for x in zip(rest, new))
            else:
                sig, node, code = rest
            if not len(sig):
                continue
            if streamed is not None:
                same = np.searchsorted(sig != streamed, True)
                if same:
                    yield hot_rows(sig[:same], node[:same], code[:same])
                sig, node, code = sig[same:], node[same:], code[same:]
                if not len(sig):
                    rest = [sig, node, code]
                    continue
                streamed = None
            cut = len(sig) if batch is None else int(np.searchsorted(sig, sig[-1]))
            rest = [sig[cut:], node[cut:], code[cut:]]
            if len(rest[0]) > 100_000:
                streamed = int(rest[0][0])
                yield hot_rows(*rest)
                rest = [x[:0] for x in rest]
            sig, node, code = sig[:cut], node[:cut], code[:cut]
            if not len(sig):
                continue
            fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
            sig, node, code = sig[fresh], node[fresh], code[fresh]
            starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            counts = np.diff(np.append(starts, len(sig)))
            some = np.logical_or.reduceat(code > 0, starts) & (counts > 1)
            hot = np.repeat(some & (counts > HOT), counts)
            if hot.any():
                yield hot_rows(sig[hot], node[hot], code[hot])
            cool = some & (counts <= HOT)
            yield from pair_rows(node, code, starts[cool], counts[cool])

    return run


def _and_last(batches):
    yield from batches
    yield None


class PrefixTree:
    """A compressed trie of sets, each a sequence of ranks; frequent members have low ranks, so paths are shared."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        rows = [sets[i] for i in order]
        shared = [0]
        for x, y in zip(rows, rows[1:]):
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:n] != y[:n])
            shared.append(int(differ[0]) if len(differ) else n)
        # nodes: depth where the edge begins and ends, row that spells the path, parent
        self.begin, self.end, self.row, self.parent = [0], [0], [0], [-1]
        ends: list[list[int]] = [[]]
        path = [0]
        for k, row in enumerate(rows):
            depth, split = shared[k], None
            while self.end[path[-1]] > depth:
                split = path.pop()
            if self.end[path[-1]] < depth:
                node = self._add(path[-1], self.begin[split], depth, self.row[split])
                ends.append([])
                self.parent[split], self.begin[split] = node, depth
                path.append(node)
            if len(row) > self.end[path[-1]]:
                path.append(self._add(path[-1], self.end[path[-1]], len(row), k))
                ends.append([])
            ends[path[-1]].append(order[k])
        count = len(self.begin)
        self.begin, self.end, self.row, self.parent = (np.array(x) for x in (self.begin, self.end, self.row, self.parent))
        self.ends = ends
        self.terminal = np.array([bool(x) for x in ends])
        # a split node is made after its child, so go by depth
        self.least = np.where(self.terminal, self.end, np.iinfo(np.int64).max)
        self.most = np.where(self.terminal, self.end, 0)
        for node in np.argsort(-self.end, kind="stable"):
            up = self.parent[node]
            if up >= 0:
                self.least[up] = min(self.least[up], self.least[node])
                self.most[up] = max(self.most[up], self.most[node])
        by_parent = np.argsort(self.parent, kind="stable")
        self.children, self.first = by_parent, np.searchsorted(self.parent[by_parent], np.arange(count + 1))
        size = self.end - self.begin
        self.offset = np.concatenate(([0], np.cumsum(size)))
        self.labels = np.concatenate([rows[self.row[i]][self.begin[i] : self.end[i]] for i in range(count)]) if count > 1 else np.empty(0, np.int64)

    def _add(self, parent: int, begin: int, end: int, row: int) -> int:
        self.begin.append(begin)
        self.end.append(end)
        self.row.append(row)
        self.parent.append(parent)
        return len(self.begin) - 1

    def links(self, probe: np.ndarray, member: np.ndarray, rule: JoinRule) -> list[int]:
        """Sets that link to ``probe``; ``member`` is scratch space, a zero for every rank.

        The overlap with a path is counted once for all sets below it. A subtree goes when even its best
        length can't reach the similarity with what is left of the probe and of the path.
        """
        found: list[int] = []
        num, total = rule.num, rule.num + rule.den
        member[probe] = 1
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            counts = self.first[nodes + 1] - self.first[nodes]
            nodes, overlap = self.children[_ranges(self.first[nodes], counts)], np.repeat(overlap, counts)
            if not len(nodes):
                break
            # before the edge is read: what of the probe lies below the edge's first label is lost
            keep = self._possible(nodes, overlap, self.begin[nodes], np.searchsorted(probe, self.labels[self.offset[nodes]]), len(probe), num, total)
            nodes, overlap = nodes[keep], overlap[keep]
            if not len(nodes):
                break
            size = self.end[nodes] - self.begin[nodes]
            hits = member[self.labels[_ranges(self.offset[nodes], size)]]
            overlap = overlap + np.add.reduceat(hits, np.concatenate(([0], np.cumsum(size)[:-1])))
            last = self.labels[self.offset[nodes + 1] - 1]
            keep = self._possible(nodes, overlap, self.end[nodes], np.searchsorted(probe, last, side="right"), len(probe), num, total)
            nodes, overlap = nodes[keep], overlap[keep]
            for node in nodes[self.terminal[nodes] & (total * overlap >= num * (len(probe) + self.end[nodes]))]:
                found += self.ends[node]
        member[probe] = 0
        return found

    def _possible(self, nodes, overlap, depth, read, size, num, total):
        best = np.clip(depth + size - read, self.least[nodes], self.most[nodes])
        return total * (overlap + np.minimum(size - read, best - depth)) >= num * (size + best)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``counts`` of them, one run after the other."""
    if not len(counts) or not (total := int(counts.sum())):
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, rule: JoinRule) -> list[tuple[int, int]]:
    """Links between ``left`` and ``right`` sets, or within ``left``; only those that join two groups not joined before."""
    sets = left + (right or [])
    lengths = [len(s) for s in sets]
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))
    ranked = [np.sort(x) for x in np.split(rank[place], np.cumsum(lengths)[:-1])]
    tree = PrefixTree(ranked[: len(left)])
    member = np.zeros(len(values), np.int64)
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(left) if right is not None else 0, len(sets)):
        for j in tree.links(ranked[i], member, rule):
            if (a := top(i)) != (b := top(j)):
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _family_sets(rule: JoinRule):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in byte_slices(numbers(batch, "text"), 1_000_000):
                part = batch.slice(rows.start, rows.stop - rows.start)
                classes = numbers(part, "class").to_pylist()
                sets = list(shingle_sets(numbers(part, "text"), rule.words))
                same = [i for i, (s, c) in enumerate(zip(sets, classes)) if len(s) and _class_of(s) == c]
                yield pa.RecordBatch.from_arrays(
                    [*(numbers(part, c).take(pa.array(same, pa.int64())) for c in ("family", "blocks", "class")), pa.array([sets[i].tobytes() for i in same], pa.binary())],
                    ["family", "blocks", "class", "grams"],
                )

    return run


def _join_blocks(rule: JoinRule):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["family", "i", "j"]):
            classes, block = group["class"].to_numpy(), group["block"].to_numpy()
            _, once = np.unique(classes, return_index=True)
            sets = group["grams"].to_pylist()
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            left = [k for k in once if block[k] == i]
            right = [k for k in once if block[k] == j] if i != j else None
            if not left or not (right or right is None):
                continue
            of = lambda part: [np.frombuffer(sets[k], np.uint64) for k in part]
            both = left + (right or [])
            found = tree_links(of(left), None if right is None else of(right), rule)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(classes[[both[x[k]] for x in found]]) for k in (0, 1)], ["a", "b"])

    return run


def ngram_jaccard_join(docs: DataFrame, rule: JoinRule = JoinRule()) -> DataFrame:
    """Groups of documents whose shingle sets have a Jaccard similarity of ``num / den`` or more.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are not read. Returns one row per input
    row: ``doc_id``, ``n_shingles``, ``component_id``, the smallest doc_id that links reach, ``text_hash``
    (xxhash64), which tells rows apart that share a doc_id, and ``group``, a number that linked rows share (null without words).

    Null, empty and blank texts have no shingles and stay alone. Rows that repeat a doc_id each count with
    their own text. A row with a null doc_id gets the component of rows with an equal set, or else null.
    An empty table gives an empty result.

    Equal sets become one class first. A class sends signatures of parts of its set (see ``JoinRule.levels``);
    classes that share enough of them make candidate families, and each family is joined exactly with a prefix tree. A
    family beyond BLOCK shingles is cut into blocks, and every pair of blocks is a task of its own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    small_batches(docs)
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sizes(rule), "doc_id long, text_hash long, n_shingles long, class long")
    rows = scratch.save(rows, "rows")
    classes = scratch.save(
        rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n"), F.count("*").alias("copies")), "classes"
    )
    signatures = docs.select("text").mapInArrow(_signatures(rule), "sig long, class long, code int")
    found = scratch.save(
        signatures.repartition("sig").sortWithinPartitions("sig", "class").mapInArrow(_scan_signatures(rule), "sig long, a long, b long, level int, larger boolean, bound int"), "found"
    )
    hot = found.where("sig is not null").select("sig", F.col("a").alias("class"), "level", "larger", "bound")
    many = hot.groupBy("class", "level").agg(F.count("*").alias("n"), F.max("bound").alias("bound")).where("n > bound").select("class", "level")
    hot = hot.join(many, ["class", "level"], "left_semi")
    lead = hot.groupBy("sig").agg(F.min("class").alias("b"), F.max("larger").alias("some")).where("some").select("sig", "b")
    cool = found.where("b is not null").groupBy("a", "b", "level").agg(F.count("*").alias("n"), F.max("bound").alias("bound")).where("n >= bound").select("a", "b")
    edges = cool.unionByName(hot.join(lead, "sig").select(F.col("class").alias("a"), "b"))
    families = connected_components(edges, scratch, "family").select(F.col("node").alias("class"), F.col("component").alias("family"))
    members = families.join(classes.where("first_doc is not null"), "class").select("family", "class", "first_doc", "n")
    sizes = members.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    members = scratch.save(members.join(sizes, "family").select(F.col("first_doc").alias("doc_id"), "family", "blocks", "class"), "members")
    # most documents have no family; their texts aren't shuffled
    few = KeyBits(members, "doc_id").select(docs, "doc_id")
    sets = few.join(members, "doc_id").mapInArrow(_family_sets(rule), "family long, blocks int, class long, grams binary")
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = sets.withColumn("block", block).select("family", "class", "grams", "block", other).select(
        "family", "class", "grams", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    links = scratch.save(
        pairs.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(_join_blocks(rule), "a long, b long"), "links"
    )
    joined = connected_components(links, scratch, "component").select(F.col("node").alias("class"), "component")
    named = classes.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class")).select("class", "component", "first_doc")
    least = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of_class = named.join(least, "component").select("class", "component_id", "component")
    return rows.join(of_class, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", F.col("component").alias("group")
    )
