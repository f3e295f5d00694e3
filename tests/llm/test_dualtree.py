"""Dual-tree rounds against plain Lloyd, and their defined cases."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from spinel.llm import dualtree


def plain(ids, x, k=16, rounds=3):
    start = sorted(range(len(ids)), key=lambda i: (ids[i] is None, hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest(), x[i].tolist()))[:k]
    c = x[start].copy()
    for last in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if last < rounds:
            for j in set(a.tolist()):
                c[j] = [int(s) // int((a == j).sum()) for s in x[a == j].sum(0)]
    return a, d.min(1), c


def check(spark, ids, vectors, **given):
    rows = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    got = dualtree.cluster(rows.repartition(3), **given).collect()
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64)
    a, d, c = plain(ids, x, given.get("k", 16), given.get("rounds", 3))
    names = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c.tolist()]
    want = [(i, int(k), int(e), int(d[a == k].sum()), int(d.sum()), names[k]) for i, k, e in zip(ids, a, d, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    check(spark, list(range(5000)), rng.normal(size=(5000, 64)))


def test_clustered_vectors_with_hot_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(dualtree, "BLOCK", 500)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 64)) * 3
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 64)) * 0.05
    x[:1000] = x[0]
    check(spark, [*range(2999), None], x)


def test_ties_repeated_ids_and_few_vectors(spark):
    x = np.zeros((40, 64))
    x[20:, 0] = 1
    check(spark, [1] * 10 + list(range(30)), x)
    check(spark, [5, 6, 7], np.eye(64)[:3])


def test_whole_nodes_go_unread():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 3, (300, 64)) + 1000 * k for k in range(4)])
    block = next(dualtree._open(pd.DataFrame([dualtree.pack(list(range(len(x))), list(x))]), 64))
    found = list(dualtree.walk(block, dualtree.Centroids(x[[0, 300, 600, 900]]), True))
    assert sum(hi - lo for lo, hi, _, _ in found) == len(x) and all(d is None for *_, d in found)


def test_tree_covers_and_separates():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(0, 4, (200, 8)) + 50 * k for k in range(5)] + [rng.integers(-900, 900, (100, 8))])
    order, bounds, radius, at = dualtree.cover_tree(x)
    assert sorted(order) == list(range(len(x))) and len(bounds) > 5
    for (lo, hi, first, n), r, p in zip(bounds, radius, at, strict=True):
        assert np.sqrt(((x[order[lo:hi]] - x[order[p]]) ** 2).sum(1)).max() <= r + 1e-9
        if n:
            assert [q for c in range(first, first + n) for q in range(*bounds[c][:2])] == list(range(lo, hi))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5] * 64
    rows = [(1, good, 1), (2, None, 2), (3, good[:-1], 3), (4, [*good[:-1], None], 4), (5, [*good[:-1], nan], 5), (6, [*good[:-1], inf], 6), (7, [], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int")
    assert [(r.vec_id, r.cluster, r.distance) for r in dualtree.cluster(df).collect()] == [(1, 0, 0)]
    none = dualtree.cluster(df.filter("vec_id > 1"))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="have to lie within"):
        dualtree.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()
