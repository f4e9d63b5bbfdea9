"""Clustering, haplotypes and latent classes against hand-worked numbers."""

import numpy as np

from modweave.operators import clustering as K
from modweave.operators import comparison as P
from modweave.operators import haplotypes as H
from modweave.operators import latent_classes as L
from modweave.sources import tables as T


def test_imputation():
    x = np.array([[0.1, 0.2], [0.3, np.nan], [0.2, 0.25]])
    assert K.nearest_impute(x).tolist() == [[0.1, 0.2], [0.3, 0.25], [0.2, 0.25]]
    assert K.nearest_impute(np.array([[np.nan, 1.0]])).tolist() == [[0.5, 1.0]]


def test_two_blobs():
    x = np.array([[0, 0], [0.1, 0.1], [5, 5], [5.1, 5.1]])
    for labels in (K.gmm_best(x), K.single_linkage(x), K.hdbscan(x, 2)):
        assert labels[0] == labels[1] != labels[2] == labels[3]
    assert set(K.hdbscan(x, 25)) == {-1}
    assert K.silhouette(x, np.array([0, 0, 1, 1])) > 0.9 and K.silhouette(x, np.zeros(4)) is None
    assert (K.min_cluster_size(5000), K.min_samples(10), K.most_components(100, 25)) == (100, 5, 4)


def test_tree_weight_is_minimal():
    x = np.random.default_rng(0).normal(size=(40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    edges = sorted((d[i, j], i, j) for i in range(40) for j in range(i))
    parent, total = list(range(40)), 0.0
    for w, i, j in edges:
        if (a := K._root(parent, i)) != (b := K._root(parent, j)):
            parent[a], total = b, total + w
    assert abs(total - sum(e[2] for e in K.spanning_tree(x))) < 1e-9


def test_haplotypes(spark, tmp_path):
    f = tmp_path / "h"
    f.write_text(">HAP0\tx SNPRANGE:1-4\nr1 1 4\nr2 1 2\n>HAP1\tx SNPRANGE:1-2\nr3 1 2\nr1 2 2\n>HAP2\tx SNPRANGE:3-6\nr4 3 6\nr5 5 6\n")
    blocks, entries = T.read_haplotypes(str(f))
    b = spark.createDataFrame(blocks, "block_ord int, hap int, snp_start long, snp_end long")
    e = spark.createDataFrame(entries, "block_ord int, entry_ord int, id string, start long, end long")
    covering = H.covering_blocks(b, 2)
    assert {(r.seg_start, r.seg_end) for r in covering.collect()} == {(1, 2), (3, 4)}
    data = H.hap_dataset(e, covering)
    assert [(r.id, list(r.cats)) for r in data.orderBy("row_ord").collect()] == [("r1", [0, 0]), ("r2", [0, None]), ("r3", [1, None]), ("r4", [None, 1]), ("r5", [None, None])]
    feats = spark.createDataFrame([("r2", [0.9]), ("z1", [0.1]), ("a1", [None])], "id string, meth array<double>")
    merged = H.outer_merge(data, feats, 2, 1).orderBy("row_ord").collect()
    assert [r.id for r in merged] == ["r1", "r2", "r3", "r4", "r5", "a1", "z1"] and merged[6].cats == [None, None] and merged[0].meth == [None]
    f.write_text(">HAP3\tx SNPRANGE:5-7\n0?1\n")
    assert [x[2:] for x in T.read_haplotypes(str(f))[1]] == [("snp_5", 5, 5), ("snp_7", 7, 7)]


def test_one_em_step(spark):
    rows = spark.createDataFrame([(0, "a", [0], []), (1, "b", [1], [])], "row_ord long, id string, cats array<int>, meth array<double>")
    p = L.Params([0.5, 0.5], [[[0.8, 0.2]], [[0.3, 0.7]]], [[], []], [[], []])
    e = L.e_step(rows, p)
    resp = [r.resp for r in e.orderBy("row_ord").collect()]
    assert np.allclose(resp, [[0.727273, 0.272727], [0.222222, 0.777778]], atol=1e-6)
    stats = L.statistics(e, p)
    assert abs(stats[1] + 1.396345) < 1e-6
    new = L.m_step(stats, p, L.Priors())
    assert np.allclose(new.pi, [0.487374, 0.512626], atol=1e-6)
    assert np.allclose([new.phi[0][0], new.phi[1][0]], [[0.585616, 0.414384], [0.417219, 0.582781]], atol=1e-6)
    assert abs(L.statistics(L.e_step(rows, new), new)[1] + 1.386296) < 1e-6
    h = L.entropy(e)
    # the penalty and entropy terms as the worked example has them
    assert L.parameter_count(2, [2], 0) == 3 and abs(h - 1.115659) < 1e-6
    bic = L.score(-1.386296, 2, 3, h, "bic")
    assert abs(bic - 6.931476) < 1e-5 and abs(L.score(-1.386296, 2, 3, h) - 9.162793) < 1e-5


def test_fit_prune_select(spark):
    rows = spark.createDataFrame([(k, str(k), [k % 2, None if k % 5 == 0 else k % 2], [k % 2 + 0.01 * (k % 7)]) for k in range(60)], "row_ord long, id string, cats array<int>, meth array<double>")
    c, fitted, scores = L.select_best(rows, 1, 3, [2, 2], 1, "bic", seed=4)
    assert c == 2 and len(scores) == 3 and fitted.converged
    assert all(abs(sum(r.resp) - 1) < 1e-9 for r in fitted.responsibilities.collect())
    classes = {r.id: r.assigned_class for r in L.map_assignments(fitted.responsibilities).collect()}
    assert classes["0"] == classes["2"] != classes["1"]
    done = L.impute(rows, fitted.params).collect()
    assert all(r.cats == [int(r.id) % 2] * 2 for r in done)
    assert L.prune(L.fit(rows, 3, [2, 2], 1, iterations=5), 0.9).params.classes == 1
    assert L.Params.from_json(fitted.params.to_json()) == fitted.params
    assert np.isfinite(L.cv_score(rows, 1, [2, 2], 1, 3, iterations=3))


def test_matching():
    assert P.best_matching([[1, 5], [4, 9], [2, 2]])[1] == 1
    rng = np.random.default_rng(1)
    from itertools import permutations

    for _ in range(20):
        m = rng.integers(0, 20, (4, 4)).tolist()
        got = sum(m[i][j] for i, j in enumerate(P.best_matching(m)))
        assert got == max(sum(m[i][p[i]] for i in range(4)) for p in permutations(range(4)))


def test_log_likelihood_follows_the_last_step(spark):
    rows = spark.createDataFrame([(0, "a", [0], []), (1, "b", [1], [])], "row_ord long, id string, cats array<int>, meth array<double>")
    begin = L.Params([0.5, 0.5], [[[0.8, 0.2]], [[0.3, 0.7]]], [[], []], [[], []])
    f = L.fit(rows, 2, [2], 0, iterations=1, begin=begin)
    assert abs(f.ll + 1.386296) < 1e-6 and (f.iterations, f.converged) == (2, False)
    assert np.allclose(f.params.pi, [0.487374, 0.512626], atol=1e-6)
    h = L.entropy(f.responsibilities)
    assert abs(L.score(f.ll, 2, 3, h, "bic") - 6.931476) < 1e-5 and abs(L.score(f.ll, 2, 3, h) - 9.162793) < 1e-5
    again = L.fit(rows, 2, [2], 0, iterations=100, begin=begin)
    assert again.converged and again.iterations < 101 and again.ll >= f.ll
    one = L.prune(f, 0.51)
    assert one.params.classes == 1 and one.params.phi == [f.params.phi[1]]
    # that of the one class that is left
    assert abs(one.ll - sum(np.log(one.params.phi[0][0]))) < 1e-9


def test_distances_in_bounded_blocks(monkeypatch):
    x = np.random.default_rng(1).normal(size=(70, 5))
    whole = np.vstack([d for _, d in K.distances(x)])
    monkeypatch.setattr(K, "CELLS", 1000)
    parts = list(K.distances(x))
    assert len(parts) == 35 and np.array_equal(np.vstack([d for _, d in parts]), whole)


def test_numbers_by_bucket(spark):
    ids = [f"read{(k * 7919) % 1000:04d}{'x' * (k % 3)}" for k in range(1000)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(5)
    buckets = H.text_buckets(df, "id", 60)
    got = {r.id: r.k for r in H.numbered(df, "id", buckets, "k").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))} and df.select(buckets.alias("b")).distinct().count() > 4
    blocks = spark.createDataFrame([(3, 9), (1, 4), (25, 25), (9, 24)], "snp_start long, snp_end long")
    for size in (1, 7, 1000):
        assert sorted(tuple(r) for r in H.segments(blocks, size).collect()) == [(1, 2), (3, 4), (5, 8), (9, 9), (10, 24), (25, 25)]
    assert H.segments(blocks.where("false")).count() == 0


def test_tasks_of_segments_follow_the_pairs(spark, monkeypatch):
    blocks = spark.range(1, 401).selectExpr("cast(id as int) block_ord", "id snp_start", "id + id % 9 snp_end")
    entries = blocks.selectExpr("block_ord", "concat('r', block_ord % 7) id", "snp_start start", "snp_end end")
    few = sorted(map(tuple, H.assign_levels(entries, H.covering_blocks(blocks, 16)).collect()))
    assert H.shares(blocks, 16) == 1 and H.shares(blocks.where("false"), 16) == 1
    monkeypatch.setattr(H, "PAIRS", 500)
    parts = H.shares(blocks, 16)
    assert 10 < parts and 1.5 < H.shares(blocks.unionByName(blocks.selectExpr("block_ord + 400", "snp_start + 4000", "snp_end + 4000").toDF(*blocks.columns)), 16) / parts < 2.5
    many = H.assign_levels(entries, H.covering_blocks(blocks, 16, parts), parts)
    assert sorted(map(tuple, many.collect())) == few and many.rdd.getNumPartitions() == parts
