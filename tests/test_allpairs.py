"""Clustering by many tasks against the kernels over all rows at once."""

import numpy as np
import pytest

from modweave.operators import allpairs as A
from modweave.operators import clustering as K


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, s, (70, 6)) for c, s in ((0, 1), (4, 0.6), (-5, 0.8), (9, 0.3))])
    return np.concatenate([x, x[:20], x[:20] + 1e-7])[rng.permutation(320)]


@pytest.fixture(autouse=True)
def several_blocks(monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 4000)
    monkeypatch.setattr(A, "TASK_ROWS", 50)
    monkeypatch.setattr(A, "NEIGHBOURS", 4)
    monkeypatch.setattr(K, "TOGETHER", 10)


def table(spark, x):
    rows = [(3 * k, [None if np.isnan(v) else float(v) for v in r]) for k, r in enumerate(x)]
    return spark.createDataFrame(rows[::-1], "read_id long, features array<double>").repartition(3)


def by_row(df, n, column):
    got = {r.read_id: r[column] for r in df.collect()}
    return [got[3 * k] for k in range(n)]


def test_imputation_by_many_tasks(spark, points):
    x = points.round(1)
    x[np.random.default_rng(3).random(x.shape) < 0.2] = np.nan
    x[7] = np.nan
    x[:, 5] = np.nan
    assert len(A.Rows(table(spark, x), "read_id", "features").sent) > 2
    got = np.array(by_row(K.impute_rows(table(spark, x)), len(x), "features"))
    known = ~np.isnan(x)
    for i, j in np.argwhere(~known):
        both = known & known[i]
        with np.errstate(invalid="ignore"):
            far = np.sqrt(np.array([sum(d) for d in np.where(both, x - x[i], 0) ** 2]) / both.sum(axis=1))
        far[np.isnan(far) | ~known[:, j]] = np.inf
        # ties go to the first row
        want = x[far.argmin(), j] if np.isfinite(far.min()) else x[known[:, j], j].mean() if known[:, j].any() else 0.5
        assert abs(got[i, j] - want) < 1e-12
    assert np.array_equal(got[known], x[known])
    assert K.impute_rows(table(spark, x).where("false")).count() == 0


@pytest.mark.parametrize("algorithm", ["gmm", "agglomerative", "hdbscan"])
def test_clusters_by_many_tasks(spark, points, algorithm):
    for x in (points, points[:, :1] * 1e-3 + 1e3):
        n = len(x)
        want = K.ALGORITHMS[algorithm](x, K.min_cluster_size(n), K.min_samples(n))
        assert by_row(K.cluster_rows(table(spark, x), algorithm), n, "cluster_id") == want.tolist()
    assert len(set(want.tolist())) > 1 and K.cluster_rows(table(spark, points).where("false"), algorithm).count() == 0


def test_silhouettes_by_many_tasks(spark, points):
    for x, most in ((points, 5), (points[:200], 90), (np.ones((12, 3)), 3)):
        label = np.arange(len(x)) % most
        want = K.silhouettes(x, label)
        rows = [(k, int(label[k]), r.tolist()) for k, r in enumerate(x)]
        df = spark.createDataFrame(rows, "id long, label int, x array<double>")
        got = {r.id: r.s for r in K.silhouette_rows(df).collect()}
        assert np.allclose([got[k] for k in range(len(x))], want, atol=1e-7)


def test_tree_by_many_tasks(spark, points):
    x = points[points[:, 0].argsort()][:150]
    rows = A.Rows(table(spark, x), "read_id", "features")
    for core in (None, np.partition(np.sqrt(((x[:, None] - x) ** 2).sum(2)), 6, axis=1)[:, 6]):
        if core is not None:
            assert np.array_equal(A.core_distances(rows, 7), core)
        got, want = A.spanning_tree(rows, core), K.spanning_tree(x, core)
        assert len(got) == 149 and sorted(e[2] for e in got) == sorted(e[2] for e in want)
