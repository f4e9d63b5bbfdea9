"""Connected components of a graph that is held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Smallest node of each node's component: columns ``node`` and ``component``.

    ``edges`` has long columns ``a`` and ``b``; nulls and loops are ignored. Every round links each
    node's larger neighbours to its smallest one (large star) and then its smaller neighbours
    (small star), until every component is one star. Each round is written to the shared folder.
    Minima are combined before the shuffle, and the joins with them can be split by the adaptive
    planner, so a hub with very many neighbours doesn't fill one task.
    """
    now = scratch.save(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{label}-0",
    )
    mark = _mark(now)
    for turn in range(1, 200):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lows, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(lows.select("a", F.col("m").alias("b"))).distinct()
        )
        now = scratch.save(small, f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND((1 << 31) - 1))).first())
