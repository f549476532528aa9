"""Lines carried through leaves against lines traced one by one."""

import numpy as np
import pytest

from tessella.operators import nearest, trace


def mesh():
    """A sheared lattice of hexahedra, some cut into wedges, tetrahedra or pyramids, and a swirl."""
    rng = np.random.default_rng(6)
    n = 5
    at = lambda i, j, k: (k * n + j) * n + i
    p = np.array([(i + 0.3 * j + rng.normal(0, 0.03), j * 1.2 + 0.1 * k, k * 0.8 + 0.05 * i) for k in range(n) for j in range(n) for i in range(n)])
    cells, extra = [], []
    for k in range(n - 1):
        for j in range(n - 1):
            for i in range(n - 1):
                c = [at(i + a, j + b, k + d) for d in (0, 1) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
                kind = (i + 2 * j + 3 * k) % 4
                if kind == 1:
                    cells += [(13, [c[0], c[1], c[2], c[4], c[5], c[6]]), (13, [c[0], c[2], c[3], c[4], c[6], c[7]])]
                elif kind == 2:
                    mid = len(p) + len(extra)
                    extra.append(p[c].mean(0))
                    cells += [(14, [c[x] for x in f] + [mid]) for f in ((0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7))]
                elif kind == 3:
                    cells += [(10, [c[0], c[6], c[x], c[y]]) for x, y in ((1, 2), (2, 3), (3, 7), (7, 4), (4, 5), (5, 1))]
                else:
                    cells.append((12, c))
    p = np.concatenate([p, extra])
    v = np.stack([-(p[:, 1] - 2.4) + 0.1 * p[:, 2], p[:, 0] - 2.6, 0.2 + 0.1 * np.sin(p[:, 0])], 1)
    return p, v, cells


def frames(spark, p, v, cells):
    nodes = spark.createDataFrame([(i, *map(float, (*a, *b, a[0] * a[1]))) for i, (a, b) in enumerate(zip(p, v, strict=True))], "node_id int, x double, y double, z double, u double, v double, w double, s double")
    return nodes, spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(cells)], "cell_id int, cell_type int, nodes array<long>")


def plain(p, field, cells, seed, sign, step, steps, method, length):
    corners = np.array([[p[c[x]] for x in nearest.EIGHT[t]] for t, c in cells])
    values = np.array([[field[c[x]] for x in nearest.EIGHT[t]] for t, c in cells])
    lo, hi = p.min(0), p.max(0)
    box = (hi - lo) / 2

    def look(q):
        ok = ((corners.min(1) - 1e-9 <= q) & (q <= corners.max(1) + 1e-9)).all(1)
        w, inside = nearest.trilinear(np.repeat(q[None], ok.sum(), 0), corners[ok])
        if inside.any():
            return w[inside][0] @ values[ok][inside][0]
        return field[((p - q) ** 2).sum(1).argmin()]

    def move(q):
        f = lambda x: sign * look(x)[:3]
        k1 = f(q)
        if method == "euler":
            return step * k1
        k2 = f(q + step / 2 * k1)
        if method == "rk2":
            return step * k2
        k3 = f(q + step / 2 * k2)
        return step / 6 * (k1 + 2 * k2 + 2 * k3 + f(q + step * k3))

    q, arc, out = np.array(seed, float), 0.0, []
    out.append((*q, arc, look(q)[3]))
    for _ in range(steps):
        d = move(q)
        q, arc = q + d, arc + float(np.sqrt((d * d).sum()))
        if not ((lo - box <= q) & (q <= hi + box)).all():
            break
        out.append((*q, arc, look(q)[3]))
        if length and arc >= length:
            break
    return np.array(out)


@pytest.mark.parametrize(("method", "length", "leaf"), [("rk4", None, 25), ("rk2", 3.0, 40), ("euler", None, 10_000)])
def test_lines_through_leaves(spark, monkeypatch, method, length, leaf):
    monkeypatch.setattr(trace, "CARRIED", 3)
    p, v, cells = mesh()
    nodes, table = frames(spark, p, v, cells)
    seeds = [(k, x, y, z) for k, (x, y, z) in enumerate([(2.0, 2.0, 1.0), (3.5, 1.1, 0.4), (0.2, 0.1, 0.1), (4.5, 4.0, 2.5), (2.6, 2.4, 3.2), (-1.5, 1.0, 1.0), (60.0, 0.0, 0.0)])]
    df = spark.createDataFrame(seeds, "point_id long, x double, y double, z double")
    got = {}
    for r in trace.streamlines(df, table, nodes, ("u", "v", "w"), 0.2, 25, "both", method, length, "s", leaf).orderBy("place").collect():
        got.setdefault((r["point_id"], r["direction"]), []).append([r["x"], r["y"], r["z"], r["arc"], r["s"]])
    field = np.concatenate([v, (p[:, 0] * p[:, 1])[:, None]], 1)
    for i, *seed in seeds:
        for name, sign in (("forward", 1), ("backward", -1)):
            want = plain(p, field, cells, seed, sign, 0.2, 25, method, length)
            assert np.array(got[i, name]).shape == want.shape and np.allclose(got[i, name], want, atol=1e-7), (i, name)


def test_a_long_line_has_a_short_plan(spark):
    nodes, table = frames(spark, *mesh())
    seeds = spark.createDataFrame([(1, 2.6, 2.4, 0.5)], "point_id long, x double, y double, z double")
    got = trace.streamlines(seeds, table, nodes, ("u", "v", "w"), 0.001, 900)
    assert got.count() == 901 and len(got._jdf.queryExecution().optimizedPlan().toString().splitlines()) < 6
    assert trace.streamlines(seeds.limit(0), table, nodes, ("u", "v", "w"), 0.1, 3).count() == 0
    assert trace.streamlines(seeds, table, nodes, ("u", "v", "w"), 0.1, 0).count() == 1


def test_pathlines_go_on_from_where_they_ended(spark):
    p, v, cells = mesh()
    nodes, table = frames(spark, p, v, cells)
    still, _ = frames(spark, p, np.tile([[0.1, 0.0, 0.0]], (len(p), 1)), cells)
    seeds = spark.createDataFrame([(4, 2.0, 2.0, 1.0)], "point_id long, x double, y double, z double")
    rows = trace.pathlines(seeds, table, [nodes, still], ("u", "v", "w"), 0.1, 4).orderBy("cycle_place", "place").collect()
    field = np.concatenate([v, v[:, :1]], 1)
    first = plain(p, field, cells, (2.0, 2.0, 1.0), 1, 0.1, 4, "rk4", None)[:, :3]
    assert np.allclose([r[3:6] for r in rows[:5]], first)
    assert np.allclose([r[3:6] for r in rows[5:]], [first[-1] + [0.01 * k, 0, 0] for k in range(5)])
