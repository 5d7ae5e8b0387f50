"""Main directions against a dense decomposition, density clusters against brute force."""

import numpy as np
import pytest
from discourse_spark.operators import density
from discourse_spark.operators.projection import main_directions, project
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F


def vectors(spark, x):
    rows = []
    for i, a in enumerate(x):
        at = np.flatnonzero(a)
        rows.append((i, Vectors.sparse(len(a), at.tolist(), a[at].tolist()) if i % 2 else Vectors.dense(a.tolist())))
    return spark.createDataFrame(rows, ["post_id", "features"]).repartition(5)


def test_directions_equal_a_dense_decomposition(spark):
    chance = np.random.default_rng(5)
    x = chance.normal(size=(200, 6)) @ (np.diag([9, 7, 5, 0.3, 0.2, 0.1]) @ chance.normal(size=(6, 60))) + 3
    got = main_directions(vectors(spark, x), 3)
    _, s, right = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(got.vectors.T @ got.vectors, np.eye(3), atol=1e-9)
    assert np.allclose(got.variance, s[:3] ** 2 / len(x), rtol=1e-6)
    assert np.allclose(np.abs((right[:3] @ got.vectors)), np.eye(3), atol=1e-4)
    assert got.captured() == pytest.approx((s[:3] ** 2).sum() / (s**2).sum(), rel=1e-6)
    placed = {r["post_id"]: r["reduced"] for r in project(vectors(spark, x), got).collect()}
    wanted = (x - x.mean(axis=0)) @ got.vectors
    assert all(np.allclose(placed[i], wanted[i], atol=1e-7) for i in range(len(x)))


def test_wide_sparse_vectors_and_nulls(spark):
    chance = np.random.default_rng(2)
    rows = [(i, Vectors.sparse(40_000, sorted(chance.choice(40_000, 5, replace=False).tolist()), [1.0] * 5)) for i in range(60)]
    df = spark.createDataFrame([*rows, (60, None)], ["post_id", "features"])
    got = main_directions(df, 4)
    assert got.vectors.shape == (40_000, 4) and np.allclose(got.vectors.T @ got.vectors, np.eye(4), atol=1e-8)
    placed = project(df, got)
    assert placed.where("reduced is null").select("post_id").collect()[0][0] == 60
    assert placed.where("size(reduced) = 4").count() == 60
    none = main_directions(df.where("post_id > 99"), 4)
    assert none.vectors.shape == (0, 0) and none.captured() == 0


def by_force(points, radius, least):
    ids = [i for i, _ in points]
    x = np.array([p for _, p in points])
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= radius * radius
    core = near.sum(axis=1) >= least
    label = {}
    for i in range(len(ids)):
        if core[i] and i not in label:
            reached, todo = {i}, [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if j not in reached:
                        reached.add(int(j))
                        todo.append(int(j))
            low = min(ids[j] for j in reached)
            label |= dict.fromkeys(reached, low)
    away = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    out = {}
    for i, own in enumerate(ids):
        close = [(away[i, j], ids[j], label[j]) for j in range(len(ids)) if core[j] and near[i, j]]
        out[own] = label[i] if core[i] else min(close)[2] if close else None
    return out


@pytest.mark.parametrize("dims, block", [(2, 2000), (2, 7), (3, 2000)])
def test_clusters_equal_brute_force(spark, monkeypatch, dims, block):
    """Blobs of several densities, a thin bridge, repeats, and noise."""
    monkeypatch.setattr(density, "BLOCK", block)
    chance = np.random.default_rng(dims)
    blobs = [chance.normal(c, s, size=(n, dims)) for c, s, n in ((0, 0.2, 60), (3, 0.5, 50), (-4, 0.1, 30))]
    bridge = np.linspace(0, 1, 12)[:, None] * np.ones(dims) * 1.2 + 6
    x = np.vstack([*blobs, bridge, chance.uniform(-9, 9, size=(25, dims)), np.repeat([[8.0] * dims], 9, axis=0)])
    points = [(int(i) * 3 + 1, p.tolist()) for i, p in zip(chance.permutation(len(x)), x)]
    odd = [(1000, None), (1001, []), (1002, [float("nan")] * dims)]
    df = spark.createDataFrame([*points, *odd], "post_id long, reduced array<double>").repartition(3)
    got = density.density_clusters(df, 0.6, 5)
    assert got.columns == ["post_id", "reduced", "cluster"]
    assert {r["post_id"]: r["cluster"] for r in got.collect()} == {**by_force(points, 0.6, 5), 1000: None, 1001: None, 1002: None}
    topics = density.with_topics(got, 10).groupBy("topic").agg(F.count("*").alias("n")).collect()
    sizes = {r["topic"]: r["n"] for r in topics}
    assert sum(sizes.values()) == len(points) + 3
    assert [sizes[k] for k in sorted(sizes) if k >= 0] == sorted((n for k, n in sizes.items() if k >= 0), reverse=True)


def test_no_points(spark):
    empty = spark.createDataFrame([], "post_id long, reduced array<double>")
    assert density.density_clusters(empty, 1.0, 3).count() == 0
