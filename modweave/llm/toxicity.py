"""Toxicity: a convolutional text classifier over hashed word embeddings, trained with numpy on all labelled texts.

Tasks learn side by side, each from its own texts; after every pass what they changed is averaged.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, numbers, pick, plain, releasing, small_batches
from .words import byte_slices, find_words, ranges

#: Words are runs of ASCII letters and of bytes beyond ASCII.
_IN_WORD = bytes(b >= 128 or chr(b).isalpha() for b in range(256))
#: The score at which a text counts as toxic.
THRESHOLD = 0.7


@dataclass(frozen=True)
class CnnRule:
    """Size and training of the classifier. Labelled rows are learnt from in chunks of about ``chunk`` rows, in at most ``chunks`` larger ones of a large table. Up to ``sent`` labels go to the texts, beyond that the texts are shuffled."""

    buckets: int = 1 << 15
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 8
    batch: int = 32
    chunk: int = 4000
    chunks: int = 256
    sent: int = 1_000_000
    prior: float = 4.0
    seed: int = 7


def word_buckets(texts: pa.Array, pad: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its first 4 and 5 bytes, of all texts in a row, ``pad`` blanks (bucket ``buckets``) after each; where each text starts."""
    words = find_words(texts, _IN_WORD)
    count = words.counts()
    starts = np.concatenate(([0], np.cumsum(count + pad)))
    ids = np.full((int(starts[-1]), 3), buckets, np.int32)
    at = ranges(starts[:-1], count)
    for k, most in enumerate((None, 4, 5)):
        ids[at, k] = mix64(words.hashes(lower=True, most=most) + np.uint64(k)) % np.uint64(buckets)
    return ids, starts


@dataclass
class Cnn:
    rule: CnnRule
    table: np.ndarray = field(repr=False)
    kernels: list[np.ndarray] = field(repr=False)
    bias: np.ndarray = field(repr=False)
    out: np.ndarray = field(repr=False)
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, rule: CnnRule) -> Cnn:
        rng = np.random.default_rng(rule.seed)
        table = rng.normal(0, 0.1, (rule.buckets + 1, rule.dim)).astype(np.float32)
        table[-1] = 0
        kernels = [rng.normal(0, 0.4 / w**0.5, (w, rule.dim, rule.filters)).astype(np.float32) for w in rule.widths]
        total = rule.filters * len(rule.widths)
        return cls(rule, table, kernels, np.zeros(total, np.float32), np.append(rng.normal(0, 0.3, total), 0).astype(np.float32))

    def pooled(self, parts: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of every filter in each text. ``parts``: for each width, what each offset's word adds."""
        pad = max(self.rule.widths) - 1
        answers = []
        for w, part in zip(self.rule.widths, parts):
            total = part[0].copy()
            for k in range(1, w):
                total[: len(total) - k] += part[k][k:]
            answers.append(total)
        whole = np.concatenate(answers, axis=1)
        # the last ``pad`` rows of a text start no window, but one that begins at its first row does
        last = np.zeros(len(whole), bool)
        for k in range(pad):
            last[starts[1:] - 1 - k] = True
        last[starts[:-1]] = False
        whole[last] = -np.inf
        return whole, np.maximum.reduceat(whole, starts[:-1], axis=0)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out[:-1] + self.out[-1]

    def tables(self) -> list[np.ndarray]:
        """Each kernel offset applied to the whole table once, so that scoring only gathers and adds."""
        return [np.stack([self.table @ k[j] for j in range(len(k))]) for k in self.kernels]

    def raw(self, texts: pa.Array, tables: list[np.ndarray]) -> np.ndarray:
        """Logits before the shift."""
        out = np.empty(len(texts))
        for part in byte_slices(texts, 500_000):
            ids, starts = word_buckets(texts[part], max(self.rule.widths) - 1, self.rule.buckets)
            parts = [[t[j][ids[:, 0]] + t[j][ids[:, 1]] + t[j][ids[:, 2]] for j in range(len(t))] for t in tables]
            out[part] = self.logits(self.pooled(parts, starts)[1])
        return out

    def score(self, texts: pa.Array, tables: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(texts, tables) + self.shift, -60, 60)))

    def begin_with_odds(self, seen: np.ndarray, count: np.ndarray) -> None:
        """The first dimension starts from how much oftener a bucket's words occur in texts of label 1, the rarer the less.

        ``seen`` holds how many texts of either label have words of each bucket, ``count`` how many texts there are. The
        first filter of each width starts by reading that dimension alone.
        """
        rule, count = self.rule, count[:, None]
        odds = np.diff(np.log((seen + 0.5) / (count + 1)), axis=0)[0]
        sure = seen.sum(axis=0) / (seen.sum(axis=0) + rule.prior)
        self.table[:-1, 0] = (odds * sure)[:-1]
        for k, kernel in enumerate(self.kernels):
            kernel[:, :, 0] = 0
            kernel[:, 0, 0] = 0.3
            self.out[k * rule.filters] = 0.5
            self.bias[k * rule.filters] = -0.5


class Training:
    """A classifier while it learns, with the sums of its squared gradients (AdaGrad)."""

    #: Runs of buckets that are summed apart.
    pieces = 16

    def __init__(self, cnn: Cnn):
        self.cnn, eps = cnn, 1e-6
        self.seen = np.full(cnn.table.shape, eps, np.float32)
        self.moments = [np.full(x.shape, eps, np.float32) for x in (*cnn.kernels, cnn.bias, cnn.out)]

    def learn(self, texts: pa.Array, labels: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over some texts in random order; few long texts make a step."""
        order, pad = rng.permutation(len(texts)), max(self.cnn.rule.widths) - 1
        texts, labels = texts.take(pa.array(order)), labels[order]
        for part in byte_slices(texts, 500_000):
            for k in range(part.start, part.stop, self.cnn.rule.batch):
                rows = slice(k, min(k + self.cnn.rule.batch, part.stop))
                self.step(*word_buckets(texts[rows], pad, self.cnn.rule.buckets), labels[rows])

    def step(self, ids: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> None:
        cnn, rule = self.cnn, self.cnn.rule
        vectors = cnn.table[ids].sum(axis=1)
        parts = [[vectors @ kernel[j] for j in range(len(kernel))] for kernel in cnn.kernels]
        whole, pooled = cnn.pooled(parts, starts)
        segment = np.repeat(np.arange(len(labels)), np.diff(starts))
        at = np.empty(pooled.shape, np.int64)
        for f in range(pooled.shape[1]):
            hit = np.flatnonzero(whole[:, f] == pooled[segment, f])
            at[segment[hit][::-1], f] = hit[::-1]
        active = np.maximum(pooled + cnn.bias, 0)
        error = (1 / (1 + np.exp(-np.clip(active @ cnn.out[:-1] + cnn.out[-1], -30, 30))) - labels).astype(np.float32) / len(labels)
        d_out = np.append(active.T @ error, error.sum())
        d_pool = np.outer(error, cnn.out[:-1]) * (active > 0)
        d_bias = d_pool.sum(axis=0)
        d_kernels, touched, amounts = [], [], []
        for n, (w, kernel) in enumerate(zip(rule.widths, cnn.kernels)):
            part = slice(n * rule.filters, (n + 1) * rule.filters)
            place, gain = at[:, part], d_pool[:, part]
            grad = np.zeros_like(kernel)
            for j in range(w):
                grad[j] = np.einsum("dfe,df->ef", vectors[place + j], gain)
                touched.append(ids[(place + j).ravel()])
                amounts.append(np.einsum("df,ef->dfe", gain, kernel[j]).reshape(-1, rule.dim))
            d_kernels.append(grad)
        for value, grad, moment in zip((*cnn.kernels, cnn.bias, cnn.out), (*d_kernels, d_bias, d_out), self.moments):
            moment += grad * grad
            value -= 0.1 * grad / np.sqrt(moment)
        buckets = np.concatenate(touched).ravel()
        change = np.repeat(np.concatenate(amounts), 3, axis=0)
        once, place = np.unique(buckets, return_inverse=True)
        grad = np.zeros((len(once), rule.dim), np.float32)
        np.add.at(grad, place, change)
        grad[once == rule.buckets] = 0
        self.seen[once] += grad * grad
        cnn.table[once] -= 0.1 * grad / np.sqrt(self.seen[once])

    def dense(self) -> list[np.ndarray]:
        return [*self.cnn.kernels, self.cnn.bias, self.cnn.out, *self.moments]

    def edges(self) -> list[tuple[int, int]]:
        at = np.linspace(0, len(self.seen), self.pieces + 1).astype(int).tolist()
        return list(zip(at, at[1:]))

    def changes(self, base: Training, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """What has changed since ``base`` by learning from ``n`` texts, each value ``n`` times, by piece; buckets also tell whether they changed."""
        table, seen = self.cnn.table - base.cnn.table, self.seen - base.seen
        touched = (table != 0).any(axis=1) | (seen != 0).any(axis=1)
        for k, (a, b) in enumerate(self.edges()):
            if touched[a:b].any():
                yield k, np.concatenate((table[a:b].ravel(), seen[a:b].ravel(), touched[a:b])) * np.float32(n)
        yield self.pieces, np.concatenate([*((x - y).ravel() for x, y in zip(self.dense(), base.dense())), [1]]).astype(np.float32) * np.float32(n)

    def average(self, sums: dict[int, np.ndarray]) -> None:
        """Takes up the mean of all changes, a bucket's of those tasks that changed it."""
        dim = self.cnn.rule.dim
        for k, (a, b) in enumerate(self.edges()):
            if k in sums:
                table, seen, n = np.split(sums[k], [(b - a) * dim, 2 * (b - a) * dim])
                n = np.maximum(n, 1)[:, None]
                self.cnn.table[a:b] += (table.reshape(-1, dim) / n).astype(np.float32)
                self.seen[a:b] += (seen.reshape(-1, dim) / n).astype(np.float32)
        mean, at = sums[self.pieces][:-1] / sums[self.pieces][-1], 0
        for x in self.dense():
            x += mean[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size


_SUMS = "piece int, chunk int, task int, data binary"


def _vectors(chunk: int, found: Iterator[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    rows = [(k, chunk, TaskContext.get().partitionId(), x.astype(np.float32).tobytes()) for k, x in found]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["piece", "chunk", "task", "data"])


@releasing
def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, data in zip(*(numbers(batch, c).to_pylist() for c in ("piece", "data"))):
            sums[piece] = sums.get(piece, 0) + np.frombuffer(data, np.float32).astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["piece", "data"])


def _summed(found: DataFrame) -> dict[int, np.ndarray]:
    """The sum of all tasks' vectors by piece, added in a fixed order; only the sums come to the driver."""
    met = found.repartition("piece").sortWithinPartitions("piece", "chunk", "task")
    return {r["piece"]: np.frombuffer(r["data"]) for r in met.mapInArrow(_add, "piece int, data binary").collect()}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Chunk, texts and labels of runs of rows of one chunk."""
    for batch in batches:
        chunk = numbers(batch, "chunk").to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(bounds, bounds[1:]):
            if b > a:
                yield int(chunk[a]), numbers(batch, "text").slice(a, b - a), numbers(batch, "toxic").to_numpy()[a:b].astype(np.float32)


def _texts_with(rule: CnnRule):
    """How many texts of either label have words of each bucket."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = rule.buckets + 1
        now, seen = None, np.zeros((2, wide))
        for chunk, texts, labels in _chunks(batches):
            if now not in (None, chunk):
                yield _vectors(now, enumerate(seen))
                seen[:] = 0
            now = chunk
            for part in byte_slices(texts, 1_000_000):
                ids, starts = word_buckets(texts[part], 0, rule.buckets)
                text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                for column in ids.T:
                    once = np.unique(text.astype(np.int64) * wide + column)
                    np.add.at(seen, (labels[part][once // wide].astype(np.int64), once % wide), 1)
        if now is not None:
            yield _vectors(now, enumerate(seen))

    return run


def _learn(sent, epoch: int):
    """What each chunk changes in one pass, from the same beginning."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base: Training = sent.value
        now, own, n, rng = None, None, 0, None
        for chunk, texts, labels in _chunks(batches):
            if chunk != now:
                if now is not None:
                    yield _vectors(now, own.changes(base, n))
                now, own, n = chunk, copy.deepcopy(base), 0
                rng = np.random.default_rng((base.cnn.rule.seed + 1, epoch, chunk))
            own.learn(texts, labels, rng)
            n += len(texts)
        if now is not None:
            yield _vectors(now, own.changes(base, n))

    return run


#: Bins of a unit of the logit in which scores are counted to set thresholds.
_BINS = 64


def _binned(sent):
    """The bin of each text's logit."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn: Cnn = sent.value
        tables = cnn.tables()
        for batch in batches:
            place = np.floor(np.clip(cnn.raw(numbers(batch, "text"), tables), -60, 60) * _BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), numbers(batch, "toxic"), numbers(batch, "lang")], ["bin", "toxic", "lang"])

    return run


def _best_threshold(scores: np.ndarray, clean: np.ndarray, toxic: np.ndarray, toll: float = 2.0) -> float:
    """Between two scores, where false alarms (each counts ``toll``) and misses together cost least, from the texts of each distinct score."""
    order = np.argsort(-scores, kind="stable")
    s = scores[order]
    cost = np.concatenate(([toxic.sum()], toxic.sum() - np.cumsum(toxic[order]) + toll * np.cumsum(clean[order])))
    best = np.flatnonzero(cost == cost.min())
    k = int(best[len(best) // 2])
    return float((np.append(1.0, s)[k] + np.append(s, 0.0)[k]) / 2)


def _scores(rows: list, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of bins, and how many texts of label 0 and 1 each has."""
    at = {b: k for k, b in enumerate(sorted({r["bin"] for r in rows}))}
    count = np.zeros((2, len(at)))
    for r in rows:
        count[r["toxic"], at[r["bin"]]] += r["n"]
    return 1 / (1 + np.exp(-((np.array(list(at)) + 0.5) / _BINS + shift))), count[0], count[1]


def fit(rows: DataFrame, rule: CnnRule = CnnRule()) -> Cnn:
    """A classifier from all rows of a table from ``training_rows``. Without rows of both labels every score is the same.

    Of every five rows one is kept aside to calibrate: the pooled threshold is moved to THRESHOLD by a shift of
    the logit, and each language with 20 rows of either label gets a threshold of its own. Thresholds follow from
    the counts of all these rows by bins of the logit.
    """
    model, context = Cnn.fresh(rule), rows.sparkSession.sparkContext
    held = {(r["aside"], r["toxic"]): r["n"] for r in rows.groupBy("aside", "toxic").agg(F.count("*").alias("n")).collect()}
    labels = {y for _, y in held}
    if len(labels) < 2:
        model.out[:] = 0
        model.shift = 3.0 if labels == {1} else -3.0
        return model
    fitted = test = rows
    if len(held) == 4:
        fitted, test = rows.where("not aside"), rows.where("aside")
        held = {k: n for k, n in held.items() if not k[0]}
    fitted = fitted.select("chunk", "toxic", "text")
    seen = _summed(fitted.mapInArrow(_texts_with(rule), _SUMS))
    model.begin_with_odds(np.stack([seen[0], seen[1]]), np.array([sum(n for (_, y), n in held.items() if y == label) for label in (0, 1)]))
    training = Training(model)
    for epoch in range(rule.epochs):
        sent = context.broadcast(training)
        training.average(_summed(fitted.mapInArrow(_learn(sent, epoch), _SUMS)))
        sent.unpersist()
    sent = context.broadcast(model)
    found = test.select("text", "toxic", "lang").mapInArrow(_binned(sent), "bin int, toxic int, lang string")
    # in the languages that are no others, which are many where the column holds anything
    told = found.groupBy("lang", "bin", "toxic").agg(F.count("*").alias("n"))
    known = test.groupBy("lang").agg(F.sum("toxic").alias("y"), F.count("*").alias("n")).where("y >= 20 and n - y >= 20").select("lang", F.lit(True).alias("own"))
    told = told.join(known, "lang", "left").groupBy(F.expr("if(own, lang, null)").alias("lang"), "bin", "toxic").agg(F.sum("n").alias("n")).collect()
    logit = lambda p: float(np.log(max(p, 1e-9) / max(1 - p, 1e-9)))
    model.shift = logit(THRESHOLD) - logit(_best_threshold(*_scores(told, 0.0)))
    for lang in {r["lang"] for r in told} - {None}:
        # within a band around the pooled threshold, so that a clean small sample doesn't move it to an extreme
        model.thresholds[lang] = float(np.clip(_best_threshold(*_scores([r for r in told if r["lang"] == lang], model.shift)), 0.5, 0.9))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, rule: CnnRule, held_out) -> DataFrame:
    """All labelled rows that aren't held out, whole, as a table dealt to chunks by hash: ``chunk``, ``aside``, ``toxic``, ``lang`` and ``text``."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out)
    count = docs.select("doc_id").join(known, "doc_id").count()
    # Spark's own guess of the labels' size would shuffle all texts for a few megabytes of them
    known = F.broadcast(known) if known.count() <= rule.sent else known.hint("merge")
    chunks = max(1, min(rule.chunks, -(-count // rule.chunk)))
    place = lambda seed: F.xxhash64("doc_id", "text", F.lit(seed))
    rows = docs.where(~held_out).join(known, "doc_id").select(
        F.pmod(place(rule.seed), F.lit(chunks)).cast("int").alias("chunk"), (F.pmod(place(rule.seed + 1), F.lit(5)) == 4).alias("aside"), "toxic",
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), place(rule.seed + 2).alias("place"), "doc_id",
    )
    rows = rows.repartition(chunks, "chunk").sortWithinPartitions("chunk", "place", "doc_id", "lang").drop("place", "doc_id")
    return Scratch(docs.sparkSession, "toxic").save(rows, "rows")


def toxicity(docs: DataFrame, labels: DataFrame, rule: CnnRule = CnnRule()) -> DataFrame:
    """Toxicity scores of all whole texts.

    ``docs`` needs ``doc_id``, ``text`` and ``lang``, ``labels`` needs ``doc_id`` and ``toxic``; other columns
    aren't read. Returns one row per input row: ``doc_id``, ``held_out`` (crc32 of the id as text is 1 modulo
    3; such labels aren't learnt from), ``score`` (0 to 1), ``predicted`` (score of 0.7 or more), ``threshold``
    (the language's) and ``rejected`` (score of the threshold or more).

    The score comes from the text alone. Null and empty texts are scored as texts without words. A null doc_id
    isn't held out. A document with several labels is toxic if one says so; labels other than 0 and 1 count as
    none. Without labels of both kinds every text gets the same score. An empty table gives no rows.

    All labelled rows that aren't held out are learnt from, in full, by tasks side by side (see ``Training``): words are
    counted and thresholds set over all of them, and after each pass every chunk's changes are averaged. They are kept as
    a table in the shared folder meanwhile.
    """
    small_batches(docs)
    docs, labels = pick(docs, "doc_id", "text", "lang"), pick(labels, "doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(training_rows(docs, labels, rule, held_out), rule)
    scored = score_texts(docs.withColumn("held_out", held_out), model)
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("rejected")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, rule: CnnRule = CnnRule()) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't rejected; see ``toxicity``. Nothing is shuffled."""
    small_batches(docs)
    known, labels = pick(docs, "doc_id", "text", "lang"), pick(labels, "doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    sent = docs.sparkSession.sparkContext.broadcast(fit(training_rows(known, labels, rule, held_out), rule))
    text, lang = (f"c{docs.columns.index(c)}" for c in ("text", "lang"))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn: Cnn = sent.value
        tables = cnn.tables()
        for batch in batches:
            limits = np.array([cnn.thresholds.get(x, THRESHOLD) for x in numbers(batch, lang).to_pylist()])
            kept = cnn.score(numbers(batch, text), tables) < limits
            for part in byte_slices(numbers(batch, text), 8_000_000):
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(kept[part]))

    rows = plain(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def score_texts(docs: DataFrame, model: Cnn) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn: Cnn = sent.value
        tables = cnn.tables()
        for batch in batches:
            score = cnn.score(numbers(batch, "text"), tables)
            limits = [cnn.thresholds.get(x, THRESHOLD) for x in numbers(batch, "lang").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [numbers(batch, "doc_id"), numbers(batch, "held_out"), pa.array(score), pa.array(limits, pa.float64())], ["doc_id", "held_out", "score", "threshold"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, threshold double")
