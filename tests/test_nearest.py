"""Nearest neighbours against all distances."""

import numpy as np
import pytest

from tessella.operators import nearest


def frame(spark, p, key):
    return spark.createDataFrame([(int(i), *map(float, row)) for i, row in p], f"{key} long, x double, y double, z double").repartition(3)


def plain(points, sources, k):
    out = set()
    for i, p in points:
        d = sorted((((p[0] - s[0]) * (p[0] - s[0]) + (p[1] - s[1]) * (p[1] - s[1]) + (p[2] - s[2]) * (p[2] - s[2])), j) for j, s in sources)
        out |= {(i, r + 1, j, float(np.sqrt(v))) for r, (v, j) in enumerate(d[:k])}
    return out


def crowded():
    """A third of all sources at one place, a dense cloud, a lattice with ties, and a few far away."""
    rng = np.random.default_rng(4)
    s = [np.tile([[1.0, 1.0, 1.0]], (500, 1)), rng.normal(0, 1e-3, (500, 3)), np.stack(np.meshgrid(range(6), range(6), range(6)), -1).reshape(-1, 3), rng.normal(0, 1e4, (100, 3))]
    s = np.concatenate(s)
    p = np.concatenate([s[::13] + 0.25, rng.normal(0, 1e-3, (60, 3)), rng.normal(0, 2e4, (20, 3)), [[1, 1, 1], [2.5, 2.5, 2.5]]])
    return [(1000 + i, x) for i, x in enumerate(p.tolist())], [((i * 7919) % len(s), x) for i, x in enumerate(s.tolist())]


@pytest.mark.parametrize(("k", "leaf"), [(1, 20), (4, 20), (4, 5000), (700, 30)])
def test_crowds_ties_and_far_points(spark, monkeypatch, k, leaf):
    monkeypatch.setattr(nearest, "SAMPLE", 400)
    monkeypatch.setattr(nearest, "ASKED", 30)
    points, sources = crowded()
    got = nearest.knn(frame(spark, points, "point_id"), frame(spark, sources, "source_id"), k, leaf)
    assert {tuple(r) for r in got.collect()} == plain(points, sources, k)


def test_bad_rows_and_empty_tables(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0)], "source_id long, x double, y double, z double")
    p = spark.createDataFrame([(1, 3.0, 4.0, 0.0), (2, None, 0.0, 0.0)], "point_id int, x double, y double, z double")
    assert [tuple(r) for r in nearest.knn(p, s, 2).collect()] == [(1, 1, 1, 5.0)]
    assert nearest.knn(p, s.limit(0), 2).count() == 0 and nearest.knn(p.limit(0), s, 2).count() == 0


def test_a_tree_follows_the_density():
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(0, 1e-6, (9000, 3)), rng.normal(0, 1e6, (1000, 3)), np.ones((5000, 3))])
    tree = nearest.Tree(p, 100)
    n = np.bincount(tree.leaf(p), minlength=tree.leaves)
    assert tree.leaves > 60 and np.sort(n)[-2] <= 300 and n.max() >= 5000  # one place can't be cut
