"""Haplotype blocks as categories: boundary segments, containment and overlap joins, and the outer merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions that one bucket of the interval joins covers.
BUCKET = 10_000
#: Pairs of a segment and a block that one task compares, at most but for a very full bucket.
PAIRS = 500_000


def _buckets(low: str, high: str, size: int):
    return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))


def numbered(rows: DataFrame, order: str, bucket, name: str) -> DataFrame:
    """Adds the rows' number from 0 in the order of a column without repeats.

    ``bucket`` is a number that never falls as ``order`` rises: rows are numbered within their bucket, after all those of
    the buckets before, so that no task sorts all rows.
    """
    rows = rows.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # one row a bucket
    before = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(order)) - 1
    return rows.withColumn("_own", own).join(before, "_bucket").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_bucket", "_own", "_before")


def text_buckets(rows: DataFrame, name: str, size: int = 100_000):
    """A bucket for texts in ascending order, of about ``size`` each, by splitters that a hash picks from the texts."""
    parts = rows.count() // size
    if not parts:
        return F.lit(0)
    step = max(1, size // 8)
    picked = sorted(r[0] for r in rows.where(F.pmod(F.xxhash64(name, F.lit(3)), F.lit(step)) == 0).select(name).where(F.col(name).isNotNull()).collect())
    cuts = np.array(picked[8::8], dtype=object)

    @F.arrow_udf("int")
    def bucket(texts: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, np.array(texts.to_pylist(), dtype=object), side="right"), pa.int32())

    return F.when(F.col(name).isNull(), F.lit(-1)).otherwise(bucket(F.coalesce(name, F.lit(""))))


def segments(blocks: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Stretches between consecutive block boundaries: ``seg_start``, ``seg_end``."""
    bounds = blocks.select(F.explode(F.array("snp_start", F.col("snp_end") + 1)).alias("b")).distinct().withColumn("at", F.floor(F.col("b") / bucket))
    # the last boundary of a bucket ends where the next bucket's first lies; one row a bucket
    firsts = bounds.groupBy("at").agg(F.min("b").alias("first"))
    firsts = firsts.select("at", F.lead("first").over(Window.orderBy("at")).alias("next"))
    after = F.lead("b").over(Window.partitionBy("at").orderBy("b"))
    rows = bounds.withColumn("after", after).join(firsts, "at")
    return rows.select(F.col("b").alias("seg_start"), (F.coalesce("after", "next") - 1).alias("seg_end")).where("seg_end is not null")


def shares(blocks: DataFrame, bucket: int = BUCKET) -> int:
    """Tasks among which the pairs of segments and blocks are dealt: their number follows the pairs, so a task's rows don't grow."""
    spread = blocks.select(_buckets("snp_start", "snp_end", bucket).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    # a block has two boundaries, one of which may lie beyond its last bucket
    bounds = blocks.select(F.explode(F.array("snp_start", F.col("snp_end") + 1)).alias("b")).distinct().groupBy(F.floor(F.col("b") / bucket).alias("bucket")).agg(F.count("*").alias("k"))
    pairs = spread.join(bounds, "bucket").agg(F.sum(F.col("n") * F.col("k"))).first()[0] or 0
    return max(1, -(-pairs // PAIRS))


def covering_blocks(blocks: DataFrame, bucket: int = BUCKET, parts: int | None = None) -> DataFrame:
    """Blocks that contain each segment, ``level`` in block order; segments of one block are left out.

    A block is dealt to the buckets it covers and a segment to that of its start, so the containment test
    runs inside an equi-join instead of over all pairs, and levels are counted where the join leaves them. ``parts``: the
    tasks, as ``shares`` counts them.
    """
    parts = parts or shares(blocks, bucket)
    spread = blocks.withColumn("bucket", _buckets("snp_start", "snp_end", bucket)).repartition(parts, "bucket")
    found = segments(blocks).withColumn("bucket", F.floor(F.col("seg_start") / bucket)).repartition(parts, "bucket")
    held = found.hint("merge").join(spread, "bucket").where("snp_start <= seg_start and snp_end >= seg_end")
    whole = Window.partitionBy("bucket", "seg_start", "seg_end")
    held = held.withColumn("n_levels", F.count("*").over(whole)).withColumn("level", F.row_number().over(whole.orderBy("block_ord")) - 1)
    return held.where("n_levels > 1").select("seg_start", "seg_end", "block_ord", "level", "n_levels")


def assign_levels(entries: DataFrame, covering: DataFrame, parts: int | None = None) -> DataFrame:
    """Each entry's level in each segment it overlaps; the smallest where several blocks claim it. ``parts``: tasks, as for ``covering_blocks``."""
    dealt = (lambda df, key: df.repartition(parts, key)) if parts else (lambda df, key: df)
    met = dealt(entries, "block_ord").join(dealt(covering, "block_ord"), "block_ord").where("start <= seg_end and end >= seg_start")
    return dealt(met.select("id", "seg_start", "seg_end", "level"), "seg_start").groupBy("id", "seg_start", "seg_end").agg(F.min("level").alias("level"))


def hap_dataset(entries: DataFrame, covering: DataFrame) -> DataFrame:
    """``row_ord`` (ids as first seen), ``id`` and ``cats``, a category for each segment in order."""
    names = [(r[0], r[1]) for r in covering.select("seg_start", "seg_end").distinct().orderBy("seg_start").collect()]
    first = entries.groupBy("id").agg(F.min("entry_ord").alias("first"))
    order = numbered(first, "first", F.floor(F.col("first") / 100_000), "row_ord").select("id", "row_ord")
    levels = assign_levels(entries, covering).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("seg_start", "level"))).alias("m"))
    cats = F.array(*(F.try_element_at("m", F.lit(a)) for a, _ in names)).cast("array<int>") if names else F.array().cast("array<int>")
    return order.join(levels, "id", "left").select("row_ord", "id", cats.alias("cats"))


def outer_merge(haps: DataFrame, features: DataFrame, n_categories: int, n_features: int) -> DataFrame:
    """All ids of both: those of the haplotypes in their order, then the others sorted; what is missing is null."""
    total = haps.agg(F.coalesce(F.max("row_ord") + 1, F.lit(0))).first()[0]
    ids = haps.select("id", "row_ord", "cats")
    extra = features.join(haps.select("id"), "id", "left_anti").select("id")
    extra = numbered(extra, "id", text_buckets(extra, "id"), "k").select("id", (F.col("k") + total).alias("row_ord"), F.lit(None).cast("array<int>").alias("cats"))
    none = lambda n, kind: F.array_repeat(F.lit(None).cast(kind), n)
    return ids.unionByName(extra).join(features, "id", "left").select(
        F.col("row_ord").cast("long").alias("row_ord"), "id",
        F.coalesce("cats", none(n_categories, "int")).alias("cats"), F.coalesce("meth", none(n_features, "double")).alias("meth"),
    )
