"""Joins of motif matches with modification calls, and their aggregates per read, site and block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = [k / 10 for k in range(11)]
BASES = ("A", "C", "G", "T")


def first_calls(calls: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """One call for each key, the first in the read's order. Minima combine before the shuffle."""
    rest = [c for c in calls.columns if c not in keys]
    return calls.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("c")).select(*keys, "c.*")


def match_calls(occurrences: DataFrame, calls: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Matches with their first call. ``inner`` drops matches without a call, ``left`` keeps them unmethylated."""
    joined = occurrences.join(first_calls(calls, keys), keys, how)
    return joined.withColumn("methylated", F.coalesce("methylated", F.lit(False))) if how == "left" else joined


def match_in_read(occurrences: DataFrame) -> DataFrame:
    """As ``match_calls`` where each match carries its read's ``calls``: the first of equal position and label, no shuffle."""
    own = F.expr("get(filter(calls, c -> c.position = read_position and c.label = label), 0)")
    return occurrences.withColumn("c", own).withColumn("ref_position", F.expr("try_element_at(ref_pos, cast(read_position + 1 as int))")).drop("calls", "ref_pos")


def is_methylated(methylated: Column, probability: Column, threshold: float) -> Column:
    """Called, and of unknown probability or one of the threshold or more in single precision."""
    return methylated & (probability.isNull() | (probability >= F.lit(threshold).cast("float")))


def per_read_rows(matches: DataFrame) -> DataFrame:
    """Rows of the per-read table; an unknown probability is 0 there. ``methylated`` doesn't look at it."""
    return matches.where("c is not null").select(
        "read_id", "read_ord", "contig", "strand", "motif_idx", "motif", "motif_start", "motif_position", "read_position", "ref_position",
        F.col("c.probability").alias("probability"), F.col("c.methylated").alias("methylated"), F.col("label").alias("mod_label"),
    )


def read_aggregate(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, mean and exact deciles of the known probabilities per group; groups without calls don't appear."""
    p = F.col("probability").cast("double")
    return calls.groupBy(*keys).agg(F.count("*").alias("call_count"), F.avg(p).alias("mean_probability"), F.percentile(p, F.array(*map(F.lit, QUANTILES))).alias("quantiles"))


def quantile_columns(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c != "quantiles"), *(F.col("quantiles")[k].alias(f"quantile_{10 * k}") for k in range(11)))


def motif_hits(calls: DataFrame, reads: DataFrame, key: str, motifs: list[str]) -> DataFrame:
    """A row for every read, ``hits`` with a flag for each motif in the order given."""
    flags = calls.where("methylated").where(F.col("motif").isin(motifs)).groupBy(key).agg(F.collect_set("motif").alias("held"))
    empty = F.array().cast("array<string>")
    joined = reads.select(key).distinct().join(flags, key, "left").withColumn("held", F.coalesce("held", empty))
    return joined.select(key, F.array(*(F.array_contains("held", m) for m in motifs)).alias("hits"))


def combo_label(hits: Column, motifs: list[str]) -> Column:
    """Motifs hit, joined by ``+`` in their order, or NONE."""
    names = F.array(*map(F.lit, motifs))
    held = F.filter(F.transform(F.arrays_zip(hits.alias("h"), names.alias("n")), lambda x: F.when(x["h"], x["n"])), lambda x: x.isNotNull())
    return F.when(F.size(held) == 0, "NONE").otherwise(F.array_join(held, "+"))


def feature_matrix(aggregates: DataFrame, motifs: list[str], key: str = "read_id", order: str = "read_ord") -> DataFrame:
    """Reads by motifs: the mean of the read's last record. Duplicate specs fill the last column only."""
    known = aggregates.where("mean_probability is not null").groupBy(key, "motif").agg(F.max_by("mean_probability", order).alias("value"))
    wide = known.groupBy(key).pivot("motif", sorted(set(motifs))).agg(F.first("value"))
    last = {m: k for k, m in enumerate(motifs)}
    cells = [F.col(f"`{m}`") if last[m] == k else F.lit(None).cast("double") for k, m in enumerate(motifs)]
    return wide.select(key, F.array(*cells).alias("features"))


def hit_reads(features: DataFrame) -> DataFrame:
    return features.where(F.exists("features", lambda x: x.isNotNull()))


def dense_columns(features: DataFrame, most_missing: float = 0.5) -> DataFrame:
    """``dim``, ``n_missing``, ``mean`` (0.5 if none is known) and ``kept`` (no more than the share missing)."""
    cells = features.select(F.posexplode("features").alias("dim", "value"))
    return cells.groupBy("dim").agg(
        F.count_if(F.col("value").isNull()).alias("n_missing"), F.coalesce(F.avg("value"), F.lit(0.5)).alias("mean"), F.count("*").alias("n")
    ).select("dim", "n_missing", "mean", (F.col("n_missing") / F.col("n") <= most_missing).alias("kept"))


def site_summary(matches: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Calls of each reference site; the mean probability is of the methylated calls."""
    hit = is_methylated(F.col("methylated"), F.col("probability"), threshold)
    out = matches.groupBy(*keys).agg(
        F.count_if(hit).alias("meth"), F.count_if(~hit).alias("unmeth"), F.avg(F.when(hit, F.col("probability").cast("double"))).alias("mean_probability")
    )
    return out.withColumn("fraction", F.col("meth") / (F.col("meth") + F.col("unmeth")))


def block_states(matches: DataFrame, size: int, threshold: float = 0.5) -> DataFrame:
    """The last call of each read at each site, with its block. Needs contig, ref_position, motif_idx, read_id, call_ord."""
    state = F.when(is_methylated(F.col("methylated"), F.col("probability"), threshold), "M").otherwise("U")
    block = F.floor(F.col("ref_position") / size).cast("long")
    return matches.where("ref_position is not null and contig is not null").groupBy("contig", block.alias("block"), "ref_position", "motif_idx", "read_id").agg(F.max_by(state, "call_ord").alias("state"))


def block_patterns(states: DataFrame) -> DataFrame:
    """Each read's states over all sites of its block, as a string with ``.`` for none; reads counted by pattern."""
    sites = states.groupBy("contig", "block").agg(F.array_sort(F.collect_set(F.struct("ref_position", "motif_idx"))).alias("sites"))
    reads = states.groupBy("contig", "block", "read_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("ref_position", "motif_idx"), "state"))).alias("held"))
    spelt = reads.join(sites, ["contig", "block"]).select(
        "contig", "block", "read_id", F.array_join(F.transform("sites", lambda s: F.coalesce(F.try_element_at("held", s), F.lit("."))), "").alias("pattern")
    )
    return spelt.groupBy("contig", "block", "pattern").agg(F.count("*").alias("n"))


def block_stats(states: DataFrame) -> DataFrame:
    """Reads by how their block's calls agree; mean, population variance and polarisation of their fractions."""
    reads = states.groupBy("contig", "block", "read_id").agg(F.count_if(F.col("state") == "M").alias("m"), F.count("*").alias("n"))
    f = F.col("m") / F.col("n")
    sites = states.groupBy("contig", "block").agg(F.count_distinct("ref_position", "motif_idx").alias("n_sites"))
    return reads.withColumn("f", f).groupBy("contig", "block").agg(
        F.count("*").alias("total_reads"), F.count_if(F.col("m") == F.col("n")).alias("fully_methylated"), F.count_if(F.col("m") == 0).alias("fully_unmethylated"),
        F.count_if((F.col("m") > 0) & (F.col("m") < F.col("n"))).alias("mixed"), F.avg("f").alias("mean_fraction"), F.var_pop("f").alias("variance"),
        F.avg(F.least(F.lit(1.0), F.abs(F.col("f") - 0.5) * 2)).alias("polarization"),
    ).join(sites, ["contig", "block"])


def longitudinal(states: DataFrame) -> DataFrame:
    """A row for each block and pattern, the commonest first, with the block's statistics."""
    order = Window.partitionBy("contig", "block").orderBy(F.desc("n"), "pattern")
    return block_patterns(states).withColumn("pattern_rank", F.row_number().over(order)).join(block_stats(states), ["contig", "block"])


def pileup(reads: DataFrame) -> DataFrame:
    """Standard bases of all aligned reads by contig and reference position, as four counts."""
    # the sequence is split once; taking one base at a time out of it would walk it for each
    held = F.arrays_zip(F.split(F.upper("seq"), "").alias("base"), F.col("ref_pos").alias("position"))
    bases = reads.where("contig is not null").select("contig", F.explode(held).alias("x")).select("contig", F.col("x.position").alias("position"), F.col("x.base").alias("base"))
    return bases.where("position is not null").groupBy("contig", "position").agg(*(F.count_if(F.col("base") == b).alias(b) for b in BASES))


def replacement_base(original: Column, counts: dict[str, Column]) -> Column:
    """The first base, other than the original, that no read has; else the one fewest have, the first of equals."""
    options = F.array(*(F.struct(F.when(counts[b] > 0, counts[b]).otherwise(0).alias("n"), F.lit(k).alias("k"), F.lit(b).alias("base")) for k, b in enumerate(BASES)))
    return F.array_min(F.filter(options, lambda x: x["base"] != original))["base"]


def impute_bases(reads: DataFrame, allowed: DataFrame | None, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Reads whose methylated bases are replaced, and a row for each change.

    ``allowed`` (read_ord, position, label) limits the calls, none means all. A later call at a position sees the
    base that an earlier one left; the counts stay those of the input. Qualities come from the probability.
    """
    from .rewrite import fold_calls

    counts = pileup(reads)
    calls = reads.select("read_ord", "read_id", "contig", "seq", F.explode("calls").alias("c"), "ref_pos")
    calls = calls.where(is_methylated(F.col("c.methylated"), F.col("c.probability"), threshold))
    calls = calls.select("read_ord", "contig", "c.position", "c.label", "c.ordinal", "c.probability", F.expr("try_element_at(ref_pos, c.position + 1)").alias("ref_position"))
    if allowed is not None:
        calls = calls.join(allowed.distinct(), ["read_ord", "position", "label"], "left_semi")
    known = calls.join(counts.withColumnRenamed("position", "ref_position"), ["contig", "ref_position"])
    edits = known.groupBy("read_ord").agg(F.array_sort(F.collect_list(F.struct("ordinal", "position", "ref_position", "probability", *BASES))).alias("edits"))
    return fold_calls(reads.where("mod_error is null and contig is not null").join(edits, "read_ord", "left"))
