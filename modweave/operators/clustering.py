"""Clustering of feature rows: imputation, mixtures, single linkage, density; distances by numpy blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import allpairs as A

#: Rows that are compared at once, so that no n x n matrix is held.
BLOCK = 512
#: Differences that are held at once.
CELLS = 8_000_000
FLOOR = 1e-6
#: Rows of a table that one task clusters.
TOGETHER = 4000


def nearest_impute(x: np.ndarray) -> np.ndarray:
    """Missing cells from the nearest row that has them: root mean square distance over the other shared columns.

    Only observed values are used; the earliest of equally near rows wins. Without a neighbour the column's
    mean, without any value 0.5.
    """
    known = ~np.isnan(x)
    filled, out = np.where(known, x, 0.0), x.copy()
    means = np.array([x[known[:, j], j].mean() if known[:, j].any() else 0.5 for j in range(x.shape[1])])
    for begin in range(0, len(x), BLOCK):
        rows = np.arange(begin, min(len(x), begin + BLOCK))
        for j in range(x.shape[1]):
            asked = rows[~known[rows, j]]
            if not len(asked):
                continue
            others = np.arange(x.shape[1]) != j
            k, v = known[:, others].astype(float), filled[:, others]
            shared = k[asked] @ k.T
            squares = (v[asked] ** 2) @ k.T + k[asked] @ (v**2).T - 2 * v[asked] @ v.T
            with np.errstate(invalid="ignore", divide="ignore"):
                distance = np.sqrt(np.maximum(squares, 0) / shared)
            distance[(shared == 0) | ~known[:, j]] = np.inf
            best = distance.argmin(axis=1)
            found = np.isfinite(distance[np.arange(len(asked)), best])
            out[asked, j] = np.where(found, filled[best, j], means[j])
    return out


def min_cluster_size(n: int) -> int:
    """A size given by the user is validated elsewhere and not used."""
    return max(25, math.ceil(n / 50))


def min_samples(n: int, given: int | None = None) -> int:
    return given if given is not None else max(5, math.ceil(n / 50))


def most_components(n: int, cluster_size: int) -> int:
    return n if n <= 1 else min(max(n // cluster_size, 2), n, 8)


def distances(x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    step = max(1, min(BLOCK, CELLS // max(1, x.size)))
    for begin in range(0, len(x), step):
        part = slice(begin, min(len(x), begin + step))
        yield part, np.sqrt(((x[part, None, :] - x[None, :, :]) ** 2).sum(axis=2))


def silhouettes(x: np.ndarray, labels: np.ndarray) -> np.ndarray | None:
    """Each row's silhouette; a row alone in its cluster has distance 0 within it. None for fewer than two clusters."""
    names, place = np.unique(labels, return_inverse=True)
    if len(names) < 2:
        return None
    size, out = np.bincount(place), np.empty(len(x))
    for part, d in distances(x):
        sums = np.stack([d[:, place == k].sum(axis=1) for k in range(len(names))], axis=1)
        own = place[part]
        row = np.arange(len(own))
        a = np.where(size[own] > 1, sums[row, own] / np.maximum(size[own] - 1, 1), 0.0)
        means = sums / size
        means[row, own] = np.inf
        b = means.min(axis=1)
        most = np.maximum(a, b)
        out[part] = np.where(most > 0, (b - a) / np.where(most > 0, most, 1), 0.0)
    return out


def silhouette(x: np.ndarray, labels: np.ndarray) -> float | None:
    found = silhouettes(x, labels)
    return None if found is None else float(found.mean())


def silhouette_rows(points: DataFrame) -> DataFrame:
    """``id`` and silhouette ``s`` of rows with ``id``, ``label`` and ``x`` (array); NaN for fewer than two clusters."""
    rows = A.Rows(points, "id", "x", "label")
    labels = rows.more["label"].to_numpy() if rows.n else np.empty(0)
    if len(np.unique(labels)) < 2:
        return points.select("id", F.lit(float("nan")).alias("s"))
    told = lambda keys, own, s: pa.RecordBatch.from_arrays([keys, pa.array(s[:, 0])], ["id", "s"])
    return A.silhouettes(rows, [labels], f"id {rows.kind}, s double", told)


def gmm_step(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, float]:
    """Responsibilities and log-likelihood of a mixture with diagonal variances."""
    logs = np.log(weight) - 0.5 * (np.log(2 * np.pi * var).sum(axis=1) + (((x[:, None, :] - mean) ** 2) / var).sum(axis=2))
    top = logs.max(axis=1, keepdims=True)
    total = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
    return np.exp(logs - total), float(total.sum())


def gmm(x: np.ndarray, k: int, iterations: int = 100, tolerance: float = 1e-3) -> np.ndarray:
    """Labels of a deterministic mixture: means start at rows a stride apart, variances at those of all rows."""
    n = len(x)
    every = np.maximum(x.var(axis=0), FLOOR)
    step = max(n // k, 1)
    mean, var, weight = x[[c * step % n for c in range(k)]].copy(), np.tile(every, (k, 1)), np.full(k, 1 / k)
    before = None
    for _ in range(iterations):
        r, ll = gmm_step(x, weight, mean, var)
        moved = False
        for c in range(k):
            nk = r[:, c].sum()
            if nk <= 1e-8:
                mean[c], var[c], weight[c], moved = x[c % n], every, 1e-6, True
                continue
            mean[c] = r[:, c] @ x / nk
            v = r[:, c] @ (x - mean[c]) ** 2 / nk
            var[c] = np.where((v < FLOOR) | ~np.isfinite(v), every, v)
            weight[c] = max(nk / n, 1e-6)
        if before is not None and abs(ll - before) < tolerance and not moved:
            break
        before = ll
    return gmm_step(x, weight, mean, var)[0].argmax(axis=1)


def gmm_best(x: np.ndarray) -> np.ndarray:
    """The mixture of 2 and more components with strictly the best silhouette."""
    if len(x) <= 1:
        return np.zeros(len(x), np.int64)
    best, labels = -np.inf, None
    for k in range(2, most_components(len(x), min_cluster_size(len(x))) + 1):
        found = gmm(x, k)
        if labels is None:
            labels = found
        if (s := silhouette(x, found)) is not None and s > best:
            best, labels = s, found
    return labels


def spanning_tree(x: np.ndarray, core: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Edges (from, to, weight) of Prim's tree from row 0, the first of equally near rows next; O(n) memory."""
    n = len(x)
    near, source, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    at, edges = 0, []
    left[0] = False
    for _ in range(n - 1):
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        if core is not None:
            d = np.maximum(d, np.maximum(core, core[at]))
        closer = left & (d < near)
        near[closer], source[closer] = d[closer], at
        at = int(np.where(left, near, np.inf).argmin())
        edges.append((int(source[at]), at, float(near[at])))
        left[at] = False
    return edges


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def single_linkage(x: np.ndarray) -> np.ndarray:
    """The tree without its heaviest edges, as many as the component bound asks; labels by first row."""
    return cut_tree(len(x), spanning_tree(x))


def cut_tree(n: int, edges: list[tuple[int, int, float]]) -> np.ndarray:
    if n <= 1:
        return np.zeros(n, np.int64)
    k = most_components(n, min_cluster_size(n))
    kept = sorted(edges, key=lambda e: -e[2])[k - 1 :]
    parent = list(range(n))
    for a, b, _ in kept:
        parent[_root(parent, b)] = _root(parent, a)
    names: dict[int, int] = {}
    return np.array([names.setdefault(_root(parent, i), len(names)) for i in range(n)])


def hdbscan(x: np.ndarray, cluster_size: int, samples: int | None = None) -> np.ndarray:
    """Density clusters by excess of mass over the condensed tree of mutual reachability; -1 is noise."""
    n, size = len(x), max(cluster_size, 2)
    if n < size:
        return np.full(n, -1)
    samples = min(max(samples if samples is not None else size, 1), size)
    core = np.concatenate([np.partition(d, min(samples, n) - 1, axis=1)[:, min(samples, n) - 1] for _, d in distances(x)])
    return dense_parts(n, size, spanning_tree(x, core))


def dense_parts(n: int, size: int, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels of ``hdbscan`` from the tree's edges."""
    edges = sorted(edges, key=lambda e: e[2])
    parent, node, count = list(range(n)), list(range(n)), [1] * n
    children: dict[int, tuple[int, int, float]] = {}
    for a, b, w in edges:
        a, b = _root(parent, a), _root(parent, b)
        children[len(count)] = (node[a], node[b], w)
        parent[b] = a
        node[a] = len(count)
        count.append(count[children[len(count)][0]] + count[children[len(count)][1]])
    root = len(count) - 1

    def leaves(top: int) -> list[int]:
        stack, out = [top], []
        while stack:
            t = stack.pop()
            if t < n:
                out.append(t)
            else:
                stack += children[t][:2]
        return out

    born, stability, below, members = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    stack = [(root, 0)]
    while stack:
        top, cluster = stack.pop()
        if top < n:
            continue
        left, right, w = children[top]
        rate = 1 / w if w > 0 else np.inf
        large = [c for c in (left, right) if count[c] >= size]
        gain = lambda k: k * (min(rate, 1e12) - born[cluster])  # noqa: B023, E731
        if len(large) == 2:
            stability[cluster] += gain(count[top])
            for c in large:
                new = len(born)
                born[new], stability[new], below[new], members[new] = min(rate, 1e12), 0.0, [], []
                below[cluster].append(new)
                stack.append((c, new))
            continue
        for c in (left, right):
            if c in large:
                stack.append((c, cluster))
            else:
                stability[cluster] += gain(count[c])
                members[cluster] += leaves(c)
    chosen: dict[int, bool] = {}
    value = dict(stability)
    for c in sorted(born, reverse=True):
        inner = sum(value[b] for b in below[c])
        chosen[c] = c != 0 and (not below[c] or stability[c] >= inner)
        value[c] = max(stability[c], inner) if c else inner
    labels = np.full(n, -1)
    stack, name = [(0, -1)], 0
    while stack:
        c, own = stack.pop()
        if own < 0 and chosen[c]:
            own, name = name, name + 1
        if own >= 0:
            labels[members[c]] = own
        stack += [(b, own) for b in reversed(below[c])]
    return labels


ALGORITHMS = {
    "gmm": lambda x, size, samples: gmm_best(x),
    "agglomerative": lambda x, size, samples: single_linkage(x),
    "hdbscan": lambda x, size, samples: hdbscan(x, size, samples),
}


def cluster_rows(features: DataFrame, algorithm: str = "gmm", samples: int | None = None, key: str = "read_id", group: str | None = None) -> DataFrame:
    """``key`` and ``cluster_id`` of dense feature rows; each ``group`` (a bin, or all rows) is clustered on its own.

    The kernels need a group's rows together, ordered by key; they hold the rows and a block of distances. All rows of a
    table beyond TOGETHER are compared by many tasks.
    """
    if group is None:
        return _cluster_all(A.Rows(features, key, "features"), algorithm, samples)
    rows, name = features.select(group, key, "features"), group

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(key)
        x = np.array(pdf["features"].tolist(), np.float64)
        labels = ALGORITHMS[algorithm](x, min_cluster_size(len(x)), min_samples(len(x), samples))
        return pd.DataFrame({name: pdf[name], key: pdf[key], "cluster_id": labels})

    kind = dict(rows.dtypes)
    return rows.groupBy(name).applyInPandas(run, f"{name} {kind[name]}, {key} {kind[key]}, cluster_id int")


def _cluster_all(rows: A.Rows, algorithm: str, samples: int | None) -> DataFrame:
    n = rows.n
    size, samples = min_cluster_size(n), min_samples(n, samples)
    if n <= TOGETHER:
        return A.in_one_task(rows, lambda x: ALGORITHMS[algorithm](x, size, samples))
    if algorithm == "gmm":
        return A.labelled(rows, A.best_mixture(rows, list(range(2, most_components(n, size) + 1)), FLOOR))
    if algorithm == "agglomerative":
        return A.labelled(rows, cut_tree(n, A.spanning_tree(rows)))
    if n < size:
        return A.labelled(rows, np.full(n, -1))
    core = A.core_distances(rows, min(max(samples, 1), size))
    return A.labelled(rows, dense_parts(n, max(size, 2), A.spanning_tree(rows, core)))


def impute_rows(features: DataFrame, key: str = "read_id") -> DataFrame:
    """Rows with every missing cell filled as by ``nearest_impute``, by many tasks."""
    return A.imputed(A.Rows(features, key, "features"))


def centroids(features: DataFrame, labels: DataFrame, key: str = "read_id") -> DataFrame:
    """``cluster_id``, ``dim``, ``read_count`` and mean."""
    cells = features.join(labels, key).select("cluster_id", F.posexplode("features").alias("dim", "value"))
    return cells.groupBy("cluster_id", "dim").agg(F.count("*").alias("read_count"), F.avg("value").alias("centroid"))
