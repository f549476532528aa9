"""Nearest neighbours and inverse-distance remapping, probes, and location of points in cells.

Sources are dealt to the leaves of a k-d tree that follows their density: it is built from a bounded sample (SAMPLE rows,
which only says where to cut), every source goes to its leaf, and each leaf keeps the true box of its sources. A point is
first compared with the sources of its own leaf, which gives a radius, and then with those leaves whose boxes its ball
meets, so the result is exact. Leaves are met as streams: one leaf's sources in memory, its points passing by; a leaf that
many points ask is copied to several tasks. Sources at one place beyond the k lowest ids can't be among the k nearest, so
crowds at one place shrink before anything else."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.expr import NAN, num
from tessella.plans.joins import dealt
from tessella.plans.scratch import keep

#: Sources that the tree is built from at most (about), those of a leaf, and leaves at most.
SAMPLE, LEAF, LEAVES = 1 << 16, 2048, 1 << 14
#: Points of a leaf that one task meets.
ASKED = 100_000
#: Distances that one numpy step holds.
STEP = 1 << 20


class Tree:
    """Cuts of space: node i splits axis[i] at cut[i] (less goes to left[i]); axis -1 is a leaf, whose number is left[i]."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.axis, self.cut, self.left, self.right, self.leaves = [], [], [], [], 0
        self._build(sample, max(1, -(-len(sample) // leaves)))
        self.axis, self.cut, self.left, self.right = (np.array(a) for a in (self.axis, self.cut, self.left, self.right))

    def _build(self, p: np.ndarray, most: int) -> int:
        at = len(self.axis)
        for a in (self.axis, self.cut, self.left, self.right):
            a.append(0)
        size = p.max(0) - p.min(0) if len(p) else np.zeros(3)
        axis = int(size.argmax())
        cut = float(np.median(p[:, axis])) if len(p) > most and size[axis] > 0 else None
        if cut is not None and cut == p[:, axis].min():
            cut = float(p[p[:, axis] > cut, axis].min())
        if cut is None:
            self.axis[at], self.left[at] = -1, self.leaves
            self.leaves += 1
            return at
        low = p[:, axis] < cut
        self.axis[at], self.cut[at] = axis, cut
        self.left[at], self.right[at] = self._build(p[low], most), self._build(p[~low], most)
        return at

    def leaf(self, p: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(p), np.int64)
        inner = np.flatnonzero(self.axis[node] >= 0)
        while len(inner):
            n = node[inner]
            node[inner] = np.where(p[inner, self.axis[n]] < self.cut[n], self.left[n], self.right[n])
            inner = inner[self.axis[node[inner]] >= 0]
        return self.left[node]

    def boxed(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """Gives every node the box of the sources of its leaves; lo > hi where there are none."""
        self.lo, self.hi = np.full((len(self.axis), 3), np.inf), np.full((len(self.axis), 3), -np.inf)
        for i in reversed(range(len(self.axis))):  # children come after their parents
            if self.axis[i] < 0:
                self.lo[i], self.hi[i] = lo[self.left[i]], hi[self.left[i]]
            else:
                a, b = self.left[i], self.right[i]
                self.lo[i], self.hi[i] = np.minimum(self.lo[a], self.lo[b]), np.maximum(self.hi[a], self.hi[b])

    def met(self, p: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for every leaf whose box a point's ball meets."""
        who, node, out = np.arange(len(p)), np.zeros(len(p), np.int64), []
        while len(who):
            gap = np.maximum(0, np.maximum(self.lo[node] - p[who], p[who] - self.hi[node]))
            near = (gap * gap).sum(1) <= radius[who] ** 2 * (1 + 1e-9) + 1e-300
            who, node = who[near], node[near]
            end = self.axis[node] < 0
            out.append((who[end], self.left[node[end]]))
            who, node = np.concatenate([who[~end]] * 2), np.concatenate([self.left[node[~end]], self.right[node[~end]]])
        return tuple(np.concatenate([o[k] for o in out]) for k in range(2))


def least_of(points: np.ndarray, sources: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, source, squared distance) of the k nearest sources of each point; ties go to sources that come first."""
    out = []
    for a in range(0, len(points), max(1, STEP // max(1, len(sources)))):
        part = points[a : a + max(1, STEP // max(1, len(sources)))]
        d = [part[:, None, c] - sources[None, :, c] for c in range(3)]
        d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        if k == 1:
            best = d2.argmin(1)
            out.append((a + np.arange(len(part)), best, d2[np.arange(len(part)), best]))
            continue
        n = min(k, len(sources))
        bound = np.partition(d2, n - 1, axis=1)[:, n - 1]
        i, j = np.nonzero(d2 <= bound[:, None])
        order = np.lexsort((j, d2[i, j], i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, np.arange(len(part)))
        ok = np.arange(len(i)) - first[i] < n
        out.append((a + i[ok], j[ok], d2[i[ok], j[ok]]))
    return tuple(np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3))


_XYZ = ("x", "y", "z")
_FOUND = pa.schema([("point_id", pa.int64()), ("source_id", pa.int64()), ("d2", pa.float64())])


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _XYZ])


def _dealt(df: DataFrame, key: str, tree, values: tuple[str, ...] = ()) -> DataFrame:
    """df (key, x, y, z and doubles as named) with the leaf of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.value.leaf(_columns(batch)).astype(np.int32))], names=[key, *_XYZ, *values, "leaf"])

    return df.select(key, *_XYZ, *values).mapInArrow(run, f"{key} long, " + "".join(f"{c} double, " for c in (*_XYZ, *values)) + "leaf int")


def _meet(points: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """(point_id, source_id, d2): the k nearest within one leaf, for points and sources with a leaf."""
    asked = F.broadcast(points.groupBy("leaf").agg(F.ceil(F.count("*") / ASKED).alias("copies")))  # LEAVES rows at most
    s = sources.join(asked, "leaf").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    p = points.join(asked, "leaf").withColumn("copy", F.pmod(F.xxhash64("point_id"), F.col("copies")) + 1)
    both = s.select("leaf", "copy", F.lit(0).alias("kind"), F.col("source_id").alias("id"), *_XYZ).unionByName(p.select("leaf", "copy", F.lit(1).alias("kind"), F.col("point_id").alias("id"), *_XYZ))
    both = both.repartition("leaf", "copy").sortWithinPartitions("leaf", "copy", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, at = None, [], [], None
        for batch in batches:
            key = np.column_stack([batch.column(c).to_numpy() for c in ("leaf", "copy", "kind")])
            xyz, id_ = _columns(batch), batch.column("id").to_numpy()
            for part in np.split(np.arange(len(key)), np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1):
                if not len(part):
                    continue
                leaf, kind = tuple(key[part[0], :2]), key[part[0], 2]
                if kind == 0:
                    if leaf != now:
                        now, held, ids = leaf, [], []
                    held.append(xyz[part])
                    ids.append(id_[part])
                    at = None
                elif leaf == now:
                    if at is None:
                        at, names = np.concatenate(held), np.concatenate(ids)
                    i, j, d2 = least_of(xyz[part], at, k)
                    yield pa.RecordBatch.from_arrays([pa.array(id_[part][i]), pa.array(names[j]), pa.array(d2)], schema=_FOUND)

    return both.mapInArrow(run, "point_id long, source_id long, d2 double")


def knn(points: DataFrame, sources: DataFrame, k: int = 1, leaf: int = LEAF) -> DataFrame:
    """(point_id, rank, source_id, distance): the k nearest of sources (source_id, x, y, z) to points (point_id, x, y, z).

    Ties go to the lowest source id; with fewer than k sources all are given; rows with a NULL or NaN coordinate are left
    out (J9). Ids are integers, point ids distinct. leaf: sources of a leaf, about."""
    spark = points.sparkSession
    clean = lambda df, key: df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in _XYZ)).select(F.col(key).cast("long").alias(key), *(F.col(c).cast("double").alias(c) for c in _XYZ))
    place = Window.partitionBy(*_XYZ).orderBy("source_id")
    src = keep(clean(sources, "source_id").withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k).drop("_n"), "knn-sources")
    left = clean(points, "point_id")
    n = src.count()
    if not n:
        return spark.createDataFrame([], "point_id long, rank int, source_id long, distance double")
    leaves = min(LEAVES, -(-n // max(leaf, 4 * k)))
    if leaves == 1:
        found = _meet(left.withColumn("leaf", F.lit(0)), src.withColumn("leaf", F.lit(0)), k)
    else:
        share = min(1.0, SAMPLE / n)
        sample = src.select(*_XYZ).sample(share, 7).limit(2 * SAMPLE).toArrow() if share < 1 else src.select(*_XYZ).toArrow()
        tree = Tree(np.column_stack([sample.column(c).to_numpy() for c in _XYZ]), leaves)
        cuts = spark.sparkContext.broadcast(tree)
        src = keep(_dealt(src, "source_id", cuts), "knn-leaves")
        left = keep(_dealt(left, "point_id", cuts), "knn-points")
        boxes = src.groupBy("leaf").agg(*(f(c) for c in _XYZ for f in (F.min, F.max))).toArrow()  # LEAVES rows at most
        lo, hi = np.full((tree.leaves, 3), np.inf), np.full((tree.leaves, 3), -np.inf)
        of = boxes.column("leaf").to_numpy()
        for c in range(3):
            lo[of, c], hi[of, c] = boxes.column(1 + 2 * c).to_numpy(), boxes.column(2 + 2 * c).to_numpy()
        tree.boxed(lo, hi)
        boxed = spark.sparkContext.broadcast(tree)
        near = keep(_meet(left, src, k), "knn-near")
        radius = near.groupBy("point_id").agg(F.count("*").alias("n"), F.max("d2").alias("far"))
        balls = left.join(dealt(radius.where(F.col("n") >= k)), "point_id", "left").select("point_id", *_XYZ, "leaf", F.coalesce(F.sqrt("far"), F.lit(float("inf"))).alias("far"))

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p, id_, own = _columns(batch), batch.column("point_id").to_numpy(), batch.column("leaf").to_numpy()
                i, at = boxed.value.met(p, batch.column("far").to_numpy())
                ok = at != own[i]
                i, at = i[ok], at[ok]
                yield pa.RecordBatch.from_pydict({"point_id": id_[i], "x": p[i, 0], "y": p[i, 1], "z": p[i, 2], "leaf": at.astype(np.int32)})

        more = keep(balls.mapInArrow(others, "point_id long, x double, y double, z double, leaf int"), "knn-balls")
        found = near.unionByName(_meet(more, src, k))
    rank = F.row_number().over(Window.partitionBy("point_id").orderBy("d2", "source_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("point_id", "rank", "source_id", F.sqrt("d2").alias("distance"))


def nearest(points: DataFrame, sources: DataFrame, values: list[str]) -> DataFrame:
    """points with source_id, distance and values of the nearest source."""
    n = knn(points, sources, 1).select("point_id", "source_id", "distance")
    return points.join(dealt(n), "point_id").join(dealt(sources.select("source_id", *values)), "source_id")


def idw(points: DataFrame, sources: DataFrame, value: str, k: int = 4) -> DataFrame:
    """(point_id, value): inverse squared distances of the k nearest; a hit within 1e-15 is taken as it is."""
    n = knn(points, sources, k).join(dealt(sources.select("source_id", num(value).alias("v"))), "source_id")
    w = F.lit(1.0) / F.when(F.col("distance") <= 1e-15, F.lit(1.0)).otherwise(F.col("distance") * F.col("distance"))
    g = n.groupBy("point_id").agg(F.sum(w * F.col("v")).alias("s"), F.sum(w).alias("w"), F.min_by("v", F.struct("distance", "source_id")).alias("near"), F.min("distance").alias("d"))
    return g.select("point_id", F.when(F.col("d") <= 1e-15, F.col("near")).otherwise(F.col("s") / F.col("w")).alias(value))


def probe(points: DataFrame, sources: DataFrame, names: list[str], location: str) -> DataFrame:
    """(point_id, location, entity_id, var, value): every named variable at the nearest node or cell."""
    n = nearest(points, sources, names)
    return n.select("point_id", F.lit(location).alias("location"), F.col("source_id").alias("entity_id"), *names).unpivot(["point_id", "location", "entity_id"], names, "var", "value")


def wall_distance(points: DataFrame, walls: DataFrame) -> DataFrame:
    """points with dst, the distance to the nearest wall node, and the unit vector from it (nx, ny, nz); a length under 1e-12
    divides by 1 (C7, C8). walls: (node_id, x, y, z)."""
    src = walls.select(F.col("node_id").alias("source_id"), "x", "y", "z")
    n = knn(points, src, 1).select("point_id", "source_id", F.col("distance").alias("dst"))
    j = points.join(dealt(n), "point_id").join(dealt(src.select("source_id", *(F.col(c).alias("s" + c) for c in "xyz"))), "source_id")
    by = F.when(F.col("dst") < 1e-12, F.lit(1.0)).otherwise(F.col("dst"))
    return j.withColumns({"n" + c: (F.col(c) - F.col("s" + c)) / by for c in "xyz"}).drop("sx", "sy", "sz")


def line_points(spark, start, end, n: int) -> DataFrame:
    """(point_id, t, x, y, z): n >= 2 points of a straight line (L1)."""
    if n < 2:
        raise ValueError("two points at least")
    t = F.col("id") / F.lit(float(n - 1))
    return spark.range(n).select(F.col("id").alias("point_id"), t.alias("t"), *((F.lit(float(a)) + t * F.lit(float(b) - float(a))).alias(c) for c, a, b in zip("xyz", start, end, strict=True)))


def spline_points(spark, control: list[tuple[float, float, float]], n: int) -> DataFrame:
    """(point_id, x, y, z, arc): n >= 8 points of a cubic through control points, and the arc length so far."""
    n, m = max(n, 8), len(control)
    if m < 2:
        raise ValueError("two control points at least")
    table = F.array(*(F.array(*(F.lit(float(v)) for v in p)) for p in control))
    u = F.col("id") / F.lit(float(n - 1)) * F.lit(float(m - 1))
    s = F.least(F.floor(u), F.lit(m - 2)).cast("int")
    f = u - s
    at = lambda k, c: F.get(F.get(table, F.least(F.greatest(s + k, F.lit(0)), F.lit(m - 1))), F.lit(c))
    hermite = lambda c: at(0, c) + 0.5 * f * (at(1, c) - at(-1, c) + f * (2 * at(-1, c) - 5 * at(0, c) + 4 * at(1, c) - at(2, c) + f * (3 * (at(0, c) - at(1, c)) + at(2, c) - at(-1, c))))
    p = spark.range(n).select(F.col("id").alias("point_id"), *(hermite(k).alias(c) for k, c in enumerate("xyz")))
    return arc_length(p, "point_id")


def arc_length(points: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """points with arc, the length of the polyline so far (W7); by: columns that name a line."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in "xyz"), F.lit(0.0)))
    return points.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("arc", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def plane_grid(spark, origin, u, v, nu: int, nv: int) -> DataFrame:
    """(point_id, x, y, z): a grid of nu x nv points origin + a u + b v with a, b in 0..1."""
    a, b = (F.col("id") % nu) / F.lit(float(max(nu - 1, 1))), F.floor(F.col("id") / nu) / F.lit(float(max(nv - 1, 1)))
    return spark.range(nu * nv).select(F.col("id").alias("point_id"), *((F.lit(float(o)) + a * F.lit(float(p)) + b * F.lit(float(q))).alias(c) for c, o, p, q in zip("xyz", origin, u, v, strict=True)))


# ---------------------------------------------------------------- points in cells


#: Where the corners of each cell type stand in the eight-corner cell that it is a limit of.
EIGHT = {10: (0, 1, 2, 2, 3, 3, 3, 3), 12: (0, 1, 2, 3, 4, 5, 6, 7), 13: (0, 1, 2, 2, 3, 4, 5, 5), 14: (0, 1, 2, 3, 4, 4, 4, 4)}


def hexahedra(cells: DataFrame, nodes: DataFrame, values: list[str]) -> DataFrame:
    """(cell_id, nodes, p, v, box): eight corners' ids, coordinates and values of each cell, and its bounding box; the corners of
    tetrahedra, wedges and pyramids are repeated."""
    eight = F.lit(None).cast("array<long>")
    for kind, corners in EIGHT.items():
        eight = F.when(F.col("cell_type") == kind, F.array(*(F.get("nodes", F.lit(k)) for k in corners))).otherwise(eight)
    c = cells.select("cell_id", F.posexplode(eight).alias("place", "node_id"))
    j = c.join(dealt(nodes.select("node_id", "x", "y", "z", *values)), "node_id").repartition("cell_id")
    g = j.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("place", "node_id", "x", "y", "z", *values))).alias("c"), *(f(c).alias(c + n) for c in "xyz" for f, n in ((F.min, "0"), (F.max, "1"))))
    return g.where(F.size("c") == 8).select("cell_id", F.transform("c", lambda e: e["node_id"]).alias("nodes"), F.flatten(F.transform("c", lambda e: F.array(e["x"], e["y"], e["z"]))).alias("p"), F.flatten(F.transform("c", lambda e: F.array(*(e[v].cast("double") for v in values)))).alias("v"), *(c + n for c in "xyz" for n in "01"))


def voxel_size(hexes: DataFrame) -> float:
    """The mean extent of cells along the axis where it is greatest."""
    size = hexes.agg(*(F.avg(F.col(c + "1") - F.col(c + "0")).alias(c) for c in "xyz")).first()
    return max([*(v for v in (size[c] for c in "xyz") if v), 1e-9])


_SIGNS = np.array([[-1, -1, -1], [1, -1, -1], [1, 1, -1], [-1, 1, -1], [-1, -1, 1], [1, -1, 1], [1, 1, 1], [-1, 1, 1]], float)


def trilinear(points: np.ndarray, corners: np.ndarray, steps: int = 24, own: bool = False) -> tuple[np.ndarray, ...]:
    """Weights of 8 corners at points inside cells, by Newton's method on all pairs at once; and whether each is inside. own: the
    cell's own coordinates too."""
    base, size = corners.mean(1), np.maximum((corners.max(1) - corners.min(1)).max(1), 1e-300)
    points, corners = (points - base) / size[:, None], (corners - base[:, None]) / size[:, None, None]
    s = np.zeros_like(points)
    for _ in range(steps):
        f = 1 + s[:, None, :] * _SIGNS
        w = f.prod(2) / 8
        miss = np.einsum("nk,nkd->nd", w, corners) - points
        if np.abs(miss).max(initial=0) < 1e-12:
            break
        d = np.stack([_SIGNS[:, a] * f[:, :, (a + 1) % 3] * f[:, :, (a + 2) % 3] / 8 for a in range(3)], 2)
        jac = np.einsum("nka,nkd->nda", d, corners)
        bad = np.abs(np.linalg.det(jac)) < 1e-14
        jac[bad] = np.eye(3)
        s = np.clip(s - np.linalg.solve(jac, miss[:, :, None])[:, :, 0], -4, 4)
    f = 1 + s[:, None, :] * _SIGNS
    w = f.prod(2) / 8
    # at repeated corners coordinates are free: there a point counts as inside by where the weights put it
    inside = (np.abs(s) <= 1 + 1e-9).all(1) & (np.abs(np.einsum("nk,nkd->nd", w, corners) - points).max(1, initial=0) <= 1e-6)
    return (w, inside, s) if own else (w, inside)


def interpolate(points: DataFrame, cells: DataFrame, nodes: DataFrame, values: list[str], h: float | None = None, outside: str = "nearest", hexes: DataFrame | None = None, few: bool = False) -> DataFrame:
    """points with the values interpolated in the cell that holds them (the lowest id where several do), and cell_id.

    Points in no cell get the nearest node's values and a NULL cell_id, or NaN if outside is nan. hexes: what hexahedra gives,
    with h, for many calls over one mesh. few: the points, of a grid with a fixed number of them, go to every task."""
    hexes = hexahedra(cells, nodes, values) if hexes is None else hexes
    if h is None:
        h = voxel_size(hexes)
    voxel = lambda c: F.floor(F.col(c) / F.lit(float(h))).cast("long")
    spread = hexes
    for c in "xyz":
        spread = spread.withColumn("v" + c, F.explode(F.sequence(voxel(c + "0"), voxel(c + "1"))))
    q = points.select("point_id", "x", "y", "z").withColumns({"v" + c: voxel(c) for c in "xyz"})
    near = spread.join(F.broadcast(q) if few else dealt(q), ["vx", "vy", "vz"])
    for c in "xyz":
        near = near.where(F.col(c).between(F.col(c + "0") - 1e-9, F.col(c + "1") + 1e-9))
    m = len(values)

    def locate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                w, ok = trilinear(part[["x", "y", "z"]].to_numpy(), np.stack(part["p"].to_numpy()).reshape(-1, 8, 3))
                got = np.einsum("nk,nkm->nm", w, np.stack(part["v"].to_numpy()).reshape(-1, 8, m)) if m else np.zeros((len(part), 0))
                out = part.loc[ok, ["point_id", "cell_id"]].copy()
                for k, name in enumerate(values):
                    out[name] = got[ok, k]
                yield out

    found = near.select("point_id", "cell_id", "x", "y", "z", "p", "v").mapInPandas(locate, "point_id long, cell_id long" + "".join(f", {v} double" for v in values))
    best = found.groupBy("point_id").agg(F.min("cell_id").alias("cell_id"), *(F.min_by(v, "cell_id").alias(v) for v in values))
    out = points.join(dealt(best), "point_id", "left")
    if outside == "nan":
        return out.withColumns({v: F.coalesce(v, F.lit(NAN)) for v in values})
    out = keep(out, "located")
    inside = out.where("cell_id is not null")
    rest = out.where("cell_id is null").drop("cell_id", *values)
    far = nearest(rest, nodes.withColumnRenamed("node_id", "source_id"), values).withColumn("cell_id", F.lit(None).cast("long"))
    return inside.unionByName(far.select(*inside.columns))


def resample(spark, cells: DataFrame, nodes: DataFrame, value: str, sampling: int = 1) -> DataFrame:
    """(point_id, x, y, z, value) on dim^3 points of the mesh's box, dim = 64 / sampling within 16..64; outside, the least
    value (G10)."""
    dim = max(16, min(64, 64 // max(1, sampling)))
    b = nodes.agg(*(f(c).alias(c + n) for c in "xyz" for f, n in ((F.min, "0"), (F.max, "1"))), F.min(value).alias("low")).first()
    ids = {"x": F.col("id") % dim, "y": F.floor(F.col("id") / dim) % dim, "z": F.floor(F.col("id") / dim**2)}
    grid = spark.range(dim**3).select(F.col("id").alias("point_id"), *((F.lit(b[c + "0"]) + ids[c] * F.lit((b[c + "1"] - b[c + "0"]) / (dim - 1))).alias(c) for c in "xyz"))
    got = interpolate(grid, cells, nodes, [value], outside="nan", few=True)
    return got.select("point_id", "x", "y", "z", F.when(F.isnan(value), F.lit(b["low"])).otherwise(F.col(value)).alias(value))
