"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts, probed part by part.

The filter takes more than a tenth of the text's size, so it isn't sent to every worker: it is cut by key into parts of
bounded size, and the distinct keys of a slice of texts go to the parts and their levels back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, numbers, pick, releasing, small_batches, sorted_groups
from .words import byte_slices, distinct, find_words

#: Token hashes of a text's end and of what comes before its first word, and what tells kinds of keys apart.
_END, _START, _WORD, _PAIR = (np.uint64(x) for x in (0x51ED270B27D4EB2F, 0x2127599BF4325C37, 0x880355F21E6D1965, 0x6A09E667F3BCC909))
#: Bits of a key that tell its part.
_SLOT = 24


@dataclass(frozen=True)
class LmRule:
    """A count c is held as the levels up to log(c) / log(base). The filter has ``bits`` bits an entry. A pair's count
    is mixed with ``strength`` times the word's own probability. Texts are handled in slices of ``slice_bytes``, keys in
    parts of about ``part_keys``; a part looks up about ``ask_keys`` at once, whatever slices they come from.
    """

    word_base: float = 1.2
    pair_base: float = 1.25
    strength: float = 8.0
    bits: int = 12
    probes: int = 4
    part_keys: int = 2_000_000
    slice_bytes: int = 8_000_000
    ask_keys: int = 1_000_000

    def level(self, counts: np.ndarray, base: float) -> np.ndarray:
        """Levels of counts of 1 and more: the largest q with base^(q-1) <= count."""
        return np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64) + 1


class Filter:
    """The bits of one part; a key's levels are probed from 1 on. No key has a level above ``top``, so a full filter ends too."""

    def __init__(self, bits: np.ndarray, size: int, rule: LmRule, top: int):
        self.bits, self.size, self.rule, self.top = bits, size, rule, top

    @staticmethod
    def steps(keys: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Where the probes of a key and level begin, and how far they lie apart."""
        found = mix64(keys + np.atleast_1d(level).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        return found, found >> np.uint64(29) | np.uint64(1)

    @classmethod
    def build(cls, keys: np.ndarray, levels: np.ndarray, rule: LmRule) -> Filter:
        size = max(64, rule.bits * int(levels.sum()))
        bits = np.zeros(size, np.uint8)
        for a in range(0, len(keys), 200_000):
            n = levels[a : a + 200_000]
            ends = np.cumsum(n)
            begin, far = cls.steps(np.repeat(keys[a : a + 200_000], n), np.arange(1, int(ends[-1]) + 1) - np.repeat(ends - n, n))
            for probe in range(rule.probes):
                bits[(begin + np.uint64(probe) * far) % np.uint64(size)] = 1
        return cls(np.packbits(bits, bitorder="little"), size, rule, int(levels.max()) if len(levels) else 0)

    def holds(self, keys: np.ndarray, level: int) -> np.ndarray:
        begin, far = self.steps(keys, level)
        alive = np.arange(len(keys))
        for probe in range(self.rule.probes):
            at = (begin[alive] + np.uint64(probe) * far[alive]) % np.uint64(self.size)
            alive = alive[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            if not len(alive):
                break
        out = np.zeros(len(keys), bool)
        out[alive] = True
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Each key's level, found by probing level after level until one is missing; 0 if the first is."""
        out, alive, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        while len(alive) and level < self.top:
            level += 1
            alive = alive[self.holds(keys[alive], level)]
            out[alive] = level
        return out


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs: the lowest byte of all, then the next."""
    wide = (int(values.max()).bit_length() + 7) // 8 or 1 if len(values) else 1
    return bytes([wide]) + np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view(np.uint64).ravel()


@dataclass(frozen=True)
class Deal:
    """How keys of so many bits are dealt to parts, in ascending order; kind 0 are words, kind 1 pairs."""

    parts: int
    pair_bits: int

    def least(self, part: np.ndarray, kind: int) -> np.ndarray:
        """The smallest key of a part."""
        slot = -(-(np.asarray(part, np.int64) << _SLOT) // self.parts)
        return slot.astype(np.uint64) << np.uint64((64, self.pair_bits)[kind] - _SLOT)

    def pieces(self, keys: np.ndarray, kind: int) -> Iterator[tuple[int, slice, bytes]]:
        """Of ascending distinct keys, those of each part: the part, where they are, and their differences packed."""
        edges = np.searchsorted(keys, self.least(np.arange(1, self.parts), kind))
        bounds = np.concatenate(([0], edges, [len(keys)]))
        for part in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = int(bounds[part]), int(bounds[part + 1])
            yield part, slice(a, b), _pack(np.diff(keys[a:b], prepend=self.least(part, kind)))

    def keys(self, raw: bytes, part: int, kind: int) -> np.ndarray:
        return np.cumsum(_unpack(raw)) + self.least(part, kind)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end; where each text starts."""
    found, counts = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for part in byte_slices(texts, 1_000_000):
        words = find_words(texts[part])
        found.append(np.insert(words.hashes(lower=True), words.first[1:], _END))
        counts.append(words.counts() + 1)
    return np.concatenate(found), np.cumsum(np.concatenate(counts))


def _histories(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = _START
    return before


def _pair_keys(before: np.ndarray, tokens: np.ndarray, bits: int) -> np.ndarray:
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + tokens * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


_KEYED = ["slice", "part", "kind", "keys", "counts"]


def _keyed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], _KEYED)


def _count(rule: LmRule, deal: Deal):
    """Distinct words and pairs of each slice of texts with their counts, a row for each part that has some."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches, rule.slice_bytes):
            tokens, starts = _tokens(numbers(batch, "text"))
            for kind, keys in enumerate((tokens, _pair_keys(_histories(tokens, starts), tokens, deal.pair_bits))):
                keys, counts = np.unique(keys, return_counts=True)
                yield _keyed([(None, p, kind, raw, _pack(counts[at].astype(np.uint64))) for p, at, raw in deal.pieces(keys, kind)])

    return run


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A task's rows in slices of about ``most`` bytes of text, however its batches are cut; a longer text is one of its own."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(numbers(batch, "text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        begin = 0
        while begin < len(ends):
            had = int(ends[begin - 1]) if begin else 0
            end = int(np.searchsorted(ends, had + max(0, most - size), side="right"))
            end = end if held else max(begin + 1, end)
            if end > begin:
                held.append(batch.slice(begin, end - begin))
                size += int(ends[end - 1]) - had
            begin = end
            if begin < len(ends):
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(count, first)


_PART = "part int, size long, top int, bits binary, words binary, counts binary, tokens long, distinct long"


def _build(rule: LmRule, deal: Deal):
    """Each part from its rows of counts, sorted by part: the filter, and its words with their exact counts."""

    def of_part(part: int, held: dict) -> pa.RecordBatch:
        (words, n), (pairs, m) = (_summed(*held[kind]) for kind in (0, 1))
        keys = np.concatenate((mix64(words + _WORD), mix64(pairs + _PAIR)))
        built = Filter.build(keys, np.concatenate((rule.level(n, rule.word_base), rule.level(m, rule.pair_base))), rule)
        raw = _pack(np.diff(words, prepend=deal.least(part, 0)))
        row = {"part": part, "size": built.size, "top": built.top, "bits": built.bits.tobytes(), "words": raw, "counts": _pack(n.astype(np.uint64)), "tokens": int(n.sum()), "distinct": len(words)}
        return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("size", pa.int64()), ("top", pa.int32()), *((c, pa.binary()) for c in ("bits", "words", "counts")), ("tokens", pa.int64()), ("distinct", pa.int64())]))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for part, kind, keys, counts in zip(*(numbers(batch, c).to_pylist() for c in _KEYED[1:])):
                if part != now:
                    if now is not None:
                        yield of_part(now, held)
                    now, held = part, {0: ([], []), 1: ([], [])}
                held[kind][0].append(deal.keys(keys, part, kind))
                held[kind][1].append(_unpack(counts))
        if now is not None:
            yield of_part(now, held)

    return run


@dataclass
class Model:
    """The parts of a filter as a table, and the sums that scoring needs: tokens, distinct tokens and texts."""

    rule: LmRule
    deal: Deal
    table: DataFrame
    total: int
    distinct: int
    texts: int


def _ask(rule: LmRule, deal: Deal):
    """Distinct words and pairs of each slice of texts, a row for each part that has some."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, batch in _sliced(batches, rule):
            tokens, starts = _tokens(numbers(batch, "text"))
            for kind, keys in enumerate((tokens, _pair_keys(_histories(tokens, starts), tokens, deal.pair_bits))):
                yield _keyed([(now, p, kind, raw, None) for p, _, raw in deal.pieces(np.unique(keys), kind)])

    return run


def _sliced(batches: Iterator[pa.RecordBatch], rule: LmRule) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a task's texts with their numbers, which are the same each time the task runs."""
    yield from enumerate(_cut(batches, rule.slice_bytes), TaskContext.get().partitionId() << 32)


def _texts(rule: LmRule):
    """The texts with their slice, and columns for the answers."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, batch in _sliced(batches, rule):
            n = batch.num_rows
            own = [numbers(batch, c) for c in ("row", "doc_id", "held_out", "text")]
            less = [pa.array(np.full(n, v, np.int32)) for v in (-1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, now)), *less, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), *own], [*_KEYED, "row", "doc_id", "held_out", "text"])

    return run


def _look_up(rule: LmRule, deal: Deal):
    """Levels of the keys sent to a part, and exact counts of words; rows sorted by part, the part's own first, without slice.

    A key that many slices send is probed once for all that are looked up together.
    """

    def answers(kind: int, asked: list[tuple], held: Filter | None, words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        keys, _, number = distinct(np.concatenate([a[2] for a in asked]))
        level = held.levels(mix64(keys + (_WORD, _PAIR)[kind])) if held else np.zeros(len(keys), np.int64)
        level = level.astype(np.uint64)[number]
        exact = None
        if kind == 0:
            at = np.minimum(np.searchsorted(words, keys), max(0, len(words) - 1)) if len(words) else None
            exact = (np.where(words[at] == keys, counts[at], 0) if at is not None else np.zeros(len(keys), np.uint64))[number]
        ends = np.cumsum([len(a[2]) for a in asked])
        return _keyed([(place, part, kind, _pack(level[e - len(k) : e]), _pack(exact[e - len(k) : e]) if kind == 0 else None) for (place, part, k), e in zip(asked, ends)])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        now, own, asked, size = None, (None, none, none), ([], []), 0
        for batch in batches:
            columns = (*_KEYED[:4], "size", "top", "bits", "words", "counts")
            for place, part, kind, raw, bits_size, top, bits, words, n in zip(*(numbers(batch, c).to_pylist() for c in columns)):
                if part != now or size >= rule.ask_keys:
                    yield from (answers(k, a, *own) for k, a in enumerate(asked) if a)
                    asked, size = ([], []), 0
                    if part != now:
                        now, own = part, (None, none, none)
                if place is None:
                    own = Filter(np.frombuffer(bits, np.uint8), bits_size, rule, top), deal.keys(words, part, 0), _unpack(n)
                    continue
                asked[kind].append((place, part, deal.keys(raw, part, kind)))
                size += len(asked[kind][-1][2])
        yield from (answers(k, a, *own) for k, a in enumerate(asked) if a)

    return run


def log_probabilities(tokens: np.ndarray, before: np.ndarray, levels: tuple[np.ndarray, np.ndarray], model: Model) -> np.ndarray:
    """log10 of each token's probability after its history, from the levels of the distinct words and pairs in ascending order.

    A pair's count is rounded down and its history's up, so that the probabilities of all tokens never sum above 1.
    """
    rule = model.rule
    words, of_token = np.unique(tokens, return_inverse=True)
    at = np.minimum(np.searchsorted(words, before), len(words) - 1)
    level = levels[0].astype(np.float64)
    alone = (np.where(level > 0, rule.word_base ** (level - 1), 0.0) + 0.1) / (model.total + 0.1 * (model.distinct + 1))
    known = words[at] == before
    seen = np.where(before == _START, float(model.texts), np.where(known & (level[at] > 0), rule.word_base ** level[at], 0.0))
    _, of_pair = np.unique(_pair_keys(before, tokens, model.deal.pair_bits), return_inverse=True)
    pair = levels[1][of_pair].astype(np.float64)
    pair = np.where((pair > 0) & (seen > 0), rule.pair_base ** (pair - 1), 0.0)
    return np.log10(np.minimum(1.0, (pair + rule.strength * alone[of_token]) / (seen + rule.strength)))


def _score(sent):
    """The sums of each text, from slices of texts with the answers to their keys, sorted by slice, part and kind."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for group in sorted_groups(batches, ["slice"]):
            group = group.combine_chunks().to_batches()[0]
            n = int((numbers(group, "part").to_numpy() < 0).sum())
            texts, answers = group.slice(0, n), group.slice(n)
            kind = numbers(answers, "kind").to_numpy()
            levels, raw, exact = [], numbers(answers, "keys").to_pylist(), numbers(answers, "counts").to_pylist()
            for k in (0, 1):
                levels.append(np.concatenate([np.empty(0, np.uint64), *(_unpack(raw[i]) for i in np.flatnonzero(kind == k))]).astype(np.int64))
            counts = np.concatenate([np.empty(0, np.uint64), *(_unpack(exact[i]) for i in np.flatnonzero(kind == 0))]).astype(np.float64)
            tokens, starts = _tokens(numbers(texts, "text"))
            if not n or len(np.unique(tokens)) != len(levels[0]):
                raise ValueError("a slice of texts isn't the one whose keys were looked up: the table gave other rows when it was read again")
            scores = log_probabilities(tokens, _histories(tokens, starts), tuple(levels), model)
            count = counts[np.unique(tokens, return_inverse=True)[1]]
            base = np.log10((count + 0.1) / (model.total + 0.1 * (model.distinct + 1)))
            sums = [np.add.reduceat(x, starts[:-1]) for x in ((count > 0).astype(np.int64), base, scores)]
            yield pa.RecordBatch.from_arrays(
                [numbers(texts, "doc_id"), numbers(texts, "held_out"), pa.array(np.diff(starts)), pa.array(sums[0]), pa.array(np.full(n, model.total)), pa.array(sums[1]), pa.array(sums[2])],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def fit(docs: DataFrame, rule: LmRule, scratch: Scratch) -> Model:
    """The model of all texts in ``docs``, which needs ``text``."""
    size, texts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    # at most one token in two bytes; of a thousand pairs one shares its key with another
    deal = Deal(max(1, -(-size // 6 // rule.part_keys)), min(60, max(32, (size + 2 * texts).bit_length() + 9)))
    counts = docs.select("text").mapInArrow(_count(rule, deal), "slice long, part int, kind int, keys binary, counts binary").drop("slice")
    built = counts.repartition("part").sortWithinPartitions("part")
    table = scratch.save(built.mapInArrow(_build(rule, deal), _PART), "filter")
    total, distinct = table.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    return Model(rule, deal, table, total, distinct, texts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of the texts in ``docs``, which needs ``doc_id``, ``text`` and ``held_out``."""
    kind, rule, deal = docs.schema["doc_id"].dataType.simpleString(), model.rule, model.deal
    # slices follow from the texts alone, so that both passes cut the same
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    asked = rows.mapInArrow(_ask(rule, deal), "slice long, part int, kind int, keys binary, counts binary").drop("counts")
    sent = asked.unionByName(model.table.drop("tokens", "distinct"), allowMissingColumns=True).repartition("part").sortWithinPartitions("part", F.asc_nulls_first("slice"))
    answers = sent.mapInArrow(_look_up(rule, deal), "slice long, part int, kind int, keys binary, counts binary")
    texts = rows.mapInArrow(_texts(rule), f"slice long, part int, kind int, keys binary, counts binary, row long, doc_id {kind}, held_out boolean, text string")
    met = texts.unionByName(answers, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "part", "kind", "row")
    sums = Model(rule, deal, None, model.total, model.distinct, model.texts)  # the table stays here
    shape = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return met.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(sums)), shape)


def lm_score(docs: DataFrame, rule: LmRule = LmRule()) -> DataFrame:
    """log10 probabilities of all whole texts under a model learnt from nine tenths of them.

    ``docs`` needs ``doc_id`` and ``text``; other columns aren't read. Returns one row per input row:
    ``doc_id``, ``held_out`` (crc32 of the id as text is 0 modulo 10; not learnt from), ``n_tokens`` (words and
    one end), ``n_known`` (those seen in training), ``train_tokens``, ``base_score`` (exact, by words alone) and
    ``score`` (the model's: a pair's count after its history, mixed with the word's own probability, all read from the
    filter).

    Null and empty texts have the end only. A null doc_id is learnt from. Repeated rows count each, in training
    as well. An empty table, or one without training rows, gives scores without counts, or no rows.

    Counts of words and pairs cover all training texts and are summed in each slice of texts before the shuffle. The
    filter grows with its entries and is kept as a table of parts of bounded size. The distinct keys of each slice of
    texts go to the parts, and levels, with the words' exact counts for the base, come back to the slice. ``docs`` is
    read several times and must give the same rows in the same order each time, as a table of files does.
    """
    small_batches(docs)
    docs = pick(docs, "doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    model = fit(docs.where(~held_out), rule, Scratch(docs.sparkSession, "lm"))
    return score(docs.withColumn("held_out", held_out), model)
