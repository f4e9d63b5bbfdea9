"""Approximate nearest neighbours: shifted Hilbert orderings of projected vectors, merged and reranked."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, as_long, numbers, pick, releasing, small_batches
from .hilbert import hilbert_key


@dataclass(frozen=True)
class CurveRule:
    """``curves`` orderings of ``axes`` random directions, ``bits`` a direction. ``sample`` rows set the ranges.

    A query meets the rows within ``reach`` (a fraction of all distinct vectors) of its place on each curve. Without one
    given it is what brings the share ``recall`` of the true neighbours of ``probes`` queries, which are compared with
    all vectors, into reach on some curve.

    A curve is cut into ``blocks`` blocks of ``block`` rows or more, but no more than ``most``, which one task holds. So a query
    that meets a share of all rows is answered by as many blocks whatever the table's size.
    """

    curves: int = 16
    axes: int = 16
    bits: int = 3
    reach: float | None = None
    recall: float = 0.93
    probes: int = 96
    block: int = 512
    blocks: int = 16
    most: int = 200_000
    sample: int = 4_000
    seed: int = 3

    def rows(self, count: int) -> int:
        """Rows of a block of a curve of ``count`` rows."""
        return max(self.block, min(self.most, -(-count // self.blocks)))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can take part and their vectors; a vector must be of finite numbers, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    starts = column.offsets.to_numpy()[:-1]
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
    width = int(np.bincount(lengths[usable]).argmax()) if usable.any() else 0
    rows = np.flatnonzero(usable & (lengths == width))
    x = values[starts[rows][:, None] + np.arange(width)] if len(rows) else np.empty((0, width))
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[good], x[good]


class Curves:
    """Directions, ranges and shifts of all orderings."""

    def __init__(self, sample: np.ndarray, rule: CurveRule):
        rng = np.random.default_rng(rule.seed)
        axes = min(rule.axes, sample.shape[1])
        self.bits = min(rule.bits, 63 // axes)
        self.ways = [np.linalg.qr(rng.normal(size=(sample.shape[1], axes)))[0] for _ in range(rule.curves)]
        ranges = [(np.quantile(p := sample @ w, 0.001, axis=0), np.quantile(p, 0.999, axis=0)) for w in self.ways]
        self.low = [a for a, _ in ranges]
        self.span = [np.maximum(b - a, 1e-12) for a, b in ranges]
        self.shift = [rng.random(axes) * 0.25 for _ in self.ways]

    def key(self, x: np.ndarray, curve: int) -> np.ndarray:
        unit = (x @ self.ways[curve] - self.low[curve]) / self.span[curve]
        cells = np.clip((unit + self.shift[curve]) / 1.25, 0, 1 - 2.0**-self.bits) * 2**self.bits
        return hilbert_key(cells.astype(np.int64), self.bits)


def _keys(curves: Curves):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _matrix(numbers(batch, "embedding"))
            part = batch.take(pa.array(rows))
            for c in range(len(curves.ways)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), c, np.int32)), pa.array(curves.key(x, c)), *(numbers(part, n) for n in ("ids", "embedding", "asks"))],
                    ["curve", "key", "ids", "embedding", "asks"],
                )

    return run


def _search(top: int, near: int):
    """Exact scores of a block's rows against the queries dealt to it, from rows sorted by (curve, block, asking, place).

    Queries are taken a few at a time, which lie together, against the rows within ``near`` of any of them.
    """

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, places, owner, flat = None, [], [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = numbers(batch, "curve").to_numpy().astype(np.int64) * (1 << 40) + numbers(batch, "block").to_numpy()
            asking = numbers(batch, "asking").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((place[1:] != place[:-1]) | (asking[1:] != asking[:-1])) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                part = batch.slice(a, b - a)
                if place[a] != now:
                    now, held, ids, places, flat = place[a], [], [], [], None
                held_vectors, at = numbers(part, "embedding"), numbers(part, "place").to_numpy()
                vectors = held_vectors.flatten().to_numpy().astype(np.float64).reshape(len(held_vectors), -1)
                if not asking[a]:
                    held.append(vectors)
                    ids.append(numbers(part, "ids"))
                    places.append(at)
                    continue
                if not held:
                    continue
                if flat is None:
                    base = np.concatenate(held)
                    flat = np.concatenate([i.flatten().to_numpy() for i in ids])
                    size = np.concatenate([i.value_lengths().to_numpy() for i in ids])
                    owner, first = np.repeat(np.arange(len(base)), size), np.concatenate(([0], np.cumsum(size)))
                    along = np.concatenate(places)
                for k in range(0, len(vectors), 32):
                    low, high = np.searchsorted(along, (at[k] - near, at[min(k + 32, len(at)) - 1] + near + 1))
                    scores = vectors[k : k + 32] @ base[low:high].T
                    own_ids, own_rows = flat[first[low] : first[high]], owner[first[low] : first[high]] - low
                    found_ids, found_scores = [], []
                    for row in scores:
                        # rows as good as the last that is needed, ties included
                        few = np.flatnonzero(row >= np.partition(row, -top)[-top]) if len(row) > top else np.arange(len(row))
                        own = np.flatnonzero(np.isin(own_rows, few)) if len(own_ids) != len(row) else few
                        order = np.lexsort((own_ids[own], -row[own_rows[own]]))[:top]
                        found_ids.append(own_ids[own][order])
                        found_scores.append(row[own_rows[own]][order])
                    yield pa.RecordBatch.from_arrays(
                        [numbers(part, "first_id").slice(k, 32), pa.array(found_ids, pa.list_(pa.int64())), pa.array(found_scores, pa.list_(pa.float64()))], ["first_id", "near", "scores"]
                    )

    return run


def _best(queries: np.ndarray, top: int):
    """Each task's ``top`` rows of largest inner product for every query: its number, the row's first id, the score."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, np.int64), np.empty(0)) for _ in queries]
        for batch in batches:
            rows, x = _matrix(numbers(batch, "embedding"))
            ids = numbers(batch, "first_id").to_numpy()[rows]
            for k, scores in enumerate(queries @ x.T):
                few = np.argpartition(-scores, top - 1)[:top] if len(scores) > top else np.arange(len(scores))
                i, s = np.append(held[k][0], ids[few]), np.append(held[k][1], scores[few])
                order = np.lexsort((i, -s))[:top]
                held[k] = i[order], s[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(held)), [len(i) for i, _ in held])), pa.array(np.concatenate([i for i, _ in held])), pa.array(np.concatenate([s for _, s in held]))],
            ["query", "first_id", "score"],
        )

    return run


def measured_reach(points: DataFrame, ranked: DataFrame, top: int, rule: CurveRule) -> int:
    """The least distance on the curves that brings ``rule.recall`` of some queries' true neighbours into reach."""
    first_id = F.element_at("ids", 1).alias("first_id")
    asked = points.where("asks").select(first_id, "embedding").orderBy(F.xxhash64("first_id"), "first_id").limit(rule.probes).collect()
    if not asked:
        return 0
    found = points.select(first_id, "embedding").mapInArrow(_best(np.array([r[1] for r in asked], np.float64), top + 1), "query long, first_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first_id")
    near = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top + 1).select("query", "first_id").collect()
    pairs = [(asked[q][0], i) for q, i in near if i != asked[q][0]]
    wanted = sorted({i for p in pairs for i in p})
    places: dict[int, dict[int, int]] = {}
    for curve, i, place in ranked.select("curve", first_id, "place").where(F.col("first_id").isin(wanted)).collect():
        places.setdefault(i, {})[curve] = place
    far = [min(abs(places[a][c] - places[b][c]) for c in places[a]) for a, b in pairs]
    return int(np.quantile(far, rule.recall, method="higher")) if far else 0


def nearest(vectors: DataFrame, every: int = 20, top: int = 20, rule: CurveRule = CurveRule()) -> DataFrame:
    """The ``top`` rows of largest inner product found for each row whose vec_id is divisible by ``every``.

    ``vectors`` needs ``vec_id`` (long) and ``embedding`` (array of numbers); other columns aren't read. Returns
    ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, nearest first, ties to the smaller vec_id; a query
    never finds itself.

    Vectors that are null, zero, empty, or hold a null or a number that isn't finite take no part, nor do rows
    without vec_id or vectors of another length than the most. Rows that repeat a vec_id are candidates once,
    with the smallest vector. Fewer candidates than ``top`` are all found. Empty tables give no rows.

    Equal vectors are one point with their ``top + 1`` smallest ids, more can't be found; their queries are
    answered once. Every point is indexed on every curve, range-sorted by key and cut into blocks by rank. A
    query goes to the blocks within its reach, where scores of the rows in reach are computed on the original vectors. How far that is
    follows from the data (see ``CurveRule``): a few rows where neighbours lie together, a large part of all where vectors
    point every way alike.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "nearest")
    shape = "query_id long, rank int, vec_id long, score double"
    small_batches(vectors)
    vectors = pick(vectors, "vec_id", "embedding")
    # single precision stays as it is; scores are computed in double precision
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    rows = rows.where("vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x != 0)")
    # -0.0 and 0.0 are one number
    rows = rows.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0).cast(kind[6:-1])).alias("embedding"))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    width = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return spark.createDataFrame([], shape)
    rows = rows.where(F.size("embedding") == width["w"])
    # the smallest ids are found in two steps, so that one vector's rows don't meet in one task
    salted = rows.withColumn("asked", (F.col("vec_id") % every == 0)).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    smallest = lambda c: F.slice(F.array_sort(c), 1, top + 1)
    points = salted.groupBy("embedding", "salt").agg(smallest(F.collect_list("vec_id")).alias("ids"), F.max("asked").alias("asks"))
    points = points.groupBy("embedding").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"), F.max("asks").alias("asks"))
    points = scratch.save(points, "points")
    sample = points.orderBy(F.xxhash64(F.element_at("ids", 1))).limit(rule.sample).select("embedding").collect()
    curves = Curves(np.array([r[0] for r in sample], np.float64), rule)
    keyed = points.mapInArrow(_keys(curves), f"curve int, key long, ids array<long>, embedding {kind}, asks boolean")
    ordered = scratch.save(
        keyed.repartitionByRange("curve", "key", F.element_at("ids", 1)).sortWithinPartitions("curve", "key").withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "ordered"
    )
    # rank on the curve: rows of the curve in earlier partitions, and those before it in its own
    sizes = ordered.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("seq").alias("base")).collect()
    ahead, total = [], {}
    for r in sorted(sizes, key=lambda r: (r["curve"], r["part"])):
        ahead.append((r["curve"], r["part"], total.get(r["curve"], 0) - r["base"]))
        total[r["curve"]] = total.get(r["curve"], 0) + r["n"]
    count = max(total.values())
    offsets = spark.createDataFrame(ahead, "curve int, part int, lift long")
    ranked = ordered.join(offsets, ["curve", "part"]).withColumn("place", F.col("seq") + F.col("lift"))
    block = lambda c: F.floor(c / rule.rows(count)).cast("long")
    near = max(top + 1, int(rule.reach * count) if rule.reach is not None else measured_reach(points, ranked, top, rule) if count > rule.block else count)
    first_id = F.element_at("ids", 1).alias("first_id")
    base = ranked.select("curve", block(F.col("place")).alias("block"), F.lit(False).alias("asking"), "place", first_id, "ids", "embedding")
    asked = ranked.where("asks").select(
        "curve", F.explode(F.sequence(block(F.greatest(F.lit(0), F.col("place") - near)), block(F.least(F.lit(count - 1), F.col("place") + near)))).alias("block"),
        F.lit(True).alias("asking"), "place", first_id, F.array().cast("array<long>").alias("ids"), "embedding",
    )
    met = base.unionByName(asked).repartition("curve", "block").sortWithinPartitions("curve", "block", "asking", "place")
    answers = met.mapInArrow(_search(top + 1, near), "first_id long, near array<long>, scores array<double>")
    # one inner product may differ in its last bit between blocks; an id counts once, with its best score
    found = answers.select("first_id", F.explode(F.arrays_zip("near", "scores")).alias("e")).groupBy("first_id", F.col("e.near").alias("id")).agg(F.max("e.scores").alias("score"))
    order = Window.partitionBy("first_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top + 1)
    asks = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    asks = asks.join(points.where("asks").select("embedding", first_id), "embedding").select("query_id", "first_id")
    own = asks.join(best, "first_id").where("id != query_id")
    # without itself the ranks move up
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("k"))
    return own.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
