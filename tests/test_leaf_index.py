"""Nearest nodes and cells within a leaf are found without comparing every point with every one of them."""

import numpy as np
import pytest

from tessella.operators import trace
from tessella.operators.nearest import least_of


@pytest.mark.parametrize("n", [1, 5, 4000])
def test_nearest_equals_brute_force_ties_too(n):
    rng = np.random.default_rng(n)
    at = rng.integers(0, 10, (n, 3)).astype(float)
    p = np.concatenate([rng.uniform(-9, 20, (300, 3)), rng.integers(0, 9, (300, 3)) + 0.5, np.repeat([[4.5, 6.7, 40.0]], 50, 0)])
    j, d2 = trace._Index(at, at).nearest(p, at)
    _, want, far = least_of(p, at, 1)
    assert np.array_equal(j, want) and np.array_equal(d2, far)


def test_points_meet_few_boxes():
    lo = np.stack(np.meshgrid(*[np.arange(16.0)] * 3), -1).reshape(-1, 3)
    p = np.concatenate([np.random.default_rng(0).uniform(0, 16, (500, 3)), [[40.0, 3, 3], [3.0, 3, 90]]])
    met = [np.zeros(0, int)] * 2
    for pairs in trace._Index(lo, lo + 1).pairs(p, np.zeros(len(p))):
        met = [np.concatenate([a, b]) for a, b in zip(met, pairs, strict=True)]
    inside = (lo[None] <= p[:, None]).all(2) & (p[:, None] <= lo[None] + 1).all(2)
    assert set(zip(*np.nonzero(inside))) <= set(zip(met[0].tolist(), met[1].tolist()))
    assert len(met[0]) < 40 * len(p) and not (met[0] >= 500).any()  # of 4,096 boxes


def test_nodes_reach_their_leaves_without_a_broadcast(spark, sf_dir, monkeypatch):
    from tessella import catalog

    plans = {}

    def kept(df, name, keep=trace.keep):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(trace, "keep", kept)
    catalog.QUERIES["r4_surface_lines"](spark, sf_dir)
    assert plans["trace-mesh"].count("BroadcastHashJoin") == 1  # the list of leaves close to a leaf
    assert "BroadcastHashJoin" not in plans["trace-seeds"]
