"""Site counts over a stream of calls; the batch aggregation in micro-batches, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calls import is_methylated


def stream_site_counts(calls: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours", threshold: float = 0.5) -> DataFrame:
    """Methylated and other calls by contig, site and time window."""
    hit = is_methylated(F.col("methylated"), F.col("probability"), threshold)
    return calls.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "contig", "ref_position", "motif").agg(
        F.count_if(hit).alias("meth"), F.count_if(~hit).alias("unmeth")
    ).select(F.col("w.start").alias("begin"), "contig", "ref_position", "motif", "meth", "unmeth")
