"""Mixing sources to target weights: a curriculum whose schedule assigns training positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, pick, plain


@dataclass(frozen=True)
class MixRule:
    """``weights`` repeat over the sources in code-point order; ``share`` of all words is mixed, no source beyond ``repeat`` times.

    ``tilt`` makes the schedule: a source's rate is ``target * (1 + tilt * (2 t - 1))`` at time t from 0 to 1, with
    the tilt's sign alternating over the sources, so that even sources come late and odd ones early.
    """

    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    repeat: int = 2
    tilt: float = 0.5
    buckets: int = 4096


def mix(docs: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """Words that a mix takes of each document, and where in training it comes.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; other columns aren't read. Returns one row per input
    row: ``doc_id``, ``size`` (words), ``source_size``, ``target`` (of the source), ``taken`` (0, 1 or up to
    ``repeat`` times the size), ``position`` (0 to 1; of the first pass, null when nothing is taken) and ``positions``
    (of all passes in which it is taken), range-sorted by position.

    A null source is a source of its own, after all others. Null and empty texts have size 0 and are never
    taken. Rows that repeat a doc_id are rows of their own. An empty table gives no rows.

    Targets fill up like water: a source gets its weight's share until it reaches ``repeat`` times its size,
    and what it leaves is shared again. Within a source, documents are ordered by a hash of their id, summed
    by hash bucket first, so no task holds a source. A document is taken in each pass over its source in which
    its middle lies below the target. Its position in each pass inverts the integral of the source's schedule, at
    all that the source gave before, earlier passes included.
    """
    return _assigned(docs, rule).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def _assigned(docs: DataFrame, rule: MixRule, *more: str) -> DataFrame:
    docs = pick(docs, "doc_id", "text", "source", *more)
    sized = docs.select("doc_id", *more, "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = sized.withColumn("place", key).withColumn("bucket", F.conv(F.substring("place", 1, 8), 16, 10).cast("long") % rule.buckets)
    # the bucket comes first in the order; it is a hash as well
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    targets = _targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), rule)
    buckets = buckets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before")
    targets = targets.withColumnRenamed("source", "t")
    buckets = buckets.join(targets, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    within = Window.partitionBy("source", "bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    start = F.col("before") + F.col("inside")
    middle = start + F.col("size") / 2.0
    passes = sum(((F.col("size") > 0) & (middle + F.col("source_size") * F.lit(k) < F.col("target"))).cast("long") for k in range(rule.repeat))
    rows = rows.withColumn("passes", passes)
    target, late = F.when(F.col("target") > 0, F.col("target")), F.col("late") * F.lit(float(rule.tilt))
    at = [F.when(F.col("passes") > k, _time(F.least(F.lit(1.0), (start + F.col("source_size") * F.lit(k)) / target), late)) for k in range(rule.repeat)]
    return rows.select(
        "doc_id", *more, "size", "source_size", "target", (F.col("passes") * F.col("size")).alias("taken"),
        at[0].alias("position"), F.filter(F.array(*at), lambda p: p.isNotNull()).alias("positions"),
    )


def _targets(sizes: DataFrame, rule: MixRule) -> DataFrame:
    """``sizes`` with ``target`` and ``late`` (1 or -1). One row per source, so one task orders them."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(float(w)) for w in rule.weights))
    rank = F.row_number().over(order) - 1
    known = sizes.withColumn("rank", rank).select(
        "source", "source_size", F.element_at(weights, (F.col("rank") % len(rule.weights) + 1).cast("int")).alias("weight"),
        F.when(F.col("rank") % 2 == 0, 1.0).otherwise(-1.0).alias("late"), (F.col("source_size") * float(rule.repeat)).alias("most"),
    )
    # the sources that reach their bound first are those of least bound per weight
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    filled = known.withColumn("held", F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn(
        "open", F.sum("weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ).withColumn("demand", F.least(F.sum("source_size").over(every) * float(rule.share), F.sum("most").over(every)))
    level = (F.col("demand") - F.col("held")) / F.col("open")
    # the water level is that of the first source, in this order, that stays below its bound
    below = F.min(F.when(level * F.col("weight") < F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("k"), level.alias("level")))).over(every)
    return filled.withColumn("water", below["level"]).select(
        "source", "source_size", "late", F.when(F.col("water").isNull(), F.col("most")).otherwise(F.least("most", F.col("water") * F.col("weight"))).alias("target")
    )


def _time(done: Column, tilt: Column) -> Column:
    """When the fraction ``done`` of a source's demand is reached: the root of ``(1 - a) t + a t^2 = done`` in 0 to 1."""
    root = (F.sqrt((F.lit(1.0) - tilt) * (F.lit(1.0) - tilt) + F.lit(4.0) * tilt * done) - (F.lit(1.0) - tilt)) / (F.lit(2.0) * tilt)
    return F.when(F.abs(tilt) < 1e-9, done).otherwise(root)


def mixed_documents(docs: DataFrame, rule: MixRule = MixRule(), position: str | None = None) -> DataFrame:
    """The documents of a mix in training order, each as often as it is taken, with the columns of ``docs``.

    ``position`` names a further column with the place of each in training. Rows are told apart by their id and a hash
    of all columns, so rows without doc_id, and rows that share one, are taken each for itself; of equal rows each has
    its passes. Null and empty texts have no words and aren't taken. An empty table gives no rows.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = plain(docs).withColumn("row_hash", F.xxhash64(*names))
    doc_id, text, source = (names[docs.columns.index(c)] for c in ("doc_id", "text", "source"))
    slim = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"), "row_hash")
    scratch = Scratch(docs.sparkSession, "mix")
    taken = scratch.save(_assigned(slim, rule, "row_hash").where("taken > 0").select(F.col("doc_id").alias("id"), F.col("row_hash").alias("h"), "positions"), "taken")
    if taken.groupBy("id", "h").count().where("count > 1").limit(1).count():
        # of equal rows one is joined with the places of all
        rows = rows.dropDuplicates([doc_id, "row_hash"])
    rows = rows.join(taken, F.col(doc_id).eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("h"))).withColumn("position", F.explode("positions"))
    rows = rows.repartitionByRange("position", doc_id).sortWithinPartitions("position", doc_id)
    more = [position] if position else []
    return rows.select(*names, *(["position"] if more else [])).toDF(*docs.columns, *more)
