"""Comparing groupings of reads, and summaries of their modification calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_assignments(tables: dict[str, DataFrame]) -> DataFrame:
    """All reads of several assignments, a column for each; a read's first label (by ``ord``) counts."""
    out = None
    for name, df in tables.items():
        one = df.groupBy("read_id").agg(F.min_by("label", "ord").alias(name))
        out = one if out is None else out.join(one, "read_id", "full")
    return out


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("read_id", F.col("label").alias("label_a")).join(b.select("read_id", F.col("label").alias("label_b")), "read_id").groupBy("label_a", "label_b").agg(F.count("*").alias("n"))


def pairwise_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one or both assignments, and of the shared ones those of equal label. Repeated reads meet each other."""
    both = a.select("read_id", F.col("label").alias("label_a")).join(b.select("read_id", F.col("label").alias("label_b")), "read_id", "full")
    in_a, in_b = F.col("label_a").isNotNull(), F.col("label_b").isNotNull()
    return both.agg(
        F.count_if(in_a & in_b).alias("shared"), F.count_if(in_a & ~in_b).alias("only_a"), F.count_if(~in_a & in_b).alias("only_b"),
        F.count_if(F.col("label_a") == F.col("label_b")).alias("match"), F.count_if(in_a & in_b & (F.col("label_a") != F.col("label_b"))).alias("mismatch"),
    )


def best_matching(counts: list[list[int]]) -> list[int]:
    """For each row the column of an assignment of largest total; rows or columns without partner meet zeros."""
    n = max(len(counts), max((len(r) for r in counts), default=0))
    cost = [[-(counts[i][j] if i < len(counts) and j < len(counts[i]) else 0) for j in range(n)] for i in range(n)]
    # shortest augmenting paths with potentials
    u, v, owner = [0] * (n + 1), [0] * (n + 1), [n] * (n + 1)
    for i in range(n):
        owner[n], j = i, n
        least, way, used = [float("inf")] * n, [n] * n, [False] * (n + 1)
        while owner[j] != n:
            used[j], row, step, following = True, owner[j], float("inf"), n
            for k in range(n):
                if used[k]:
                    continue
                if (d := cost[row][k] - u[row] - v[k]) < least[k]:
                    least[k], way[k] = d, j
                if least[k] < step:
                    step, following = least[k], k
            for k in range(n + 1):
                if used[k]:
                    u[owner[k]] += step
                    v[k] -= step
                elif k < n:
                    least[k] -= step
            j = following
        while j != n:
            owner[j] = owner[way[j]]
            j = way[j]
    out = [-1] * n
    for j in range(n):
        out[owner[j]] = j
    return out[: len(counts)]


def optimal_mapping(a: DataFrame, b: DataFrame) -> list[tuple[str, str, int]]:
    """Label pairs of the best one-to-one matching. The table of labels, not of reads, comes to the driver."""
    rows = contingency(a, b).collect()
    left, right = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    held = {(r[0], r[1]): r[2] for r in rows}
    chosen = best_matching([[held.get((x, y), 0) for y in right] for x in left])
    return [(x, right[j], held.get((x, right[j]), 0)) for x, j in zip(left, chosen) if j < len(right)]


def similarity_with_mapping(a: DataFrame, b: DataFrame) -> dict:
    """The pair's counts; the final match adds the optimal mapping's reads to those of equal label."""
    told = pairwise_similarity(a, b).first().asDict()
    told["optimal"] = sum(n for _, _, n in optimal_mapping(a, b))
    return told | {"final_match": told["match"] + told["optimal"]}


def level_fractions(aggregates: DataFrame, high: float = 0.5) -> DataFrame:
    """Reads of each motif by high, low or missing mean, with the fraction within the motif."""
    level = F.when(F.col("mean_probability").isNull(), "missing").when(F.col("mean_probability") >= high, "high").otherwise("low")
    counts = aggregates.groupBy("motif", level.alias("level")).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("motif")))


def chunk_quantiles(calls: DataFrame, size: int | None = None) -> DataFrame:
    """Quantiles of the probability by contig and stretch of reference; the stretch grows with the largest position."""
    if size is None:
        top = calls.agg(F.max("ref_position")).first()[0]
        size = 10_000 if top is None else max(3000, round(top / 25 / 1000) * 1000)
    chunk = (F.floor(F.col("ref_position") / size) * size).cast("long")
    return calls.groupBy("contig", chunk.alias("chunk")).agg(
        F.count("*").alias("n"), *(F.percentile(F.col("probability").cast("double"), F.lit(q)).alias(f"q{int(100 * q)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9))
    )


def histogram(aggregates: DataFrame, width: float = 0.05) -> DataFrame:
    """Reads by motif, bucket of call count and bin of the mean."""
    n = F.col("call_count")
    bucket = F.when(n < 5, "<5").when(n <= 10, "5-10").when(n <= 20, "11-20").otherwise(">20")
    return aggregates.groupBy("motif", bucket.alias("calls"), F.floor(F.col("mean_probability") / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def top_motif_pairs(aggregates: DataFrame, k: int) -> DataFrame:
    """All pairs of the k + 1 commonest motifs."""
    top = aggregates.groupBy("motif").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "motif").limit(k + 1)
    return top.select(F.col("motif").alias("a")).join(top.select(F.col("motif").alias("b")), F.col("a") < F.col("b"))
