"""Stream-, path- and surface lines of many seeds at once.

Space is cut by a k-d tree that follows the nodes' density. Each leaf has the cells that reach into its region, its nodes and
those of leaves close by. A round sends every live point to the leaf that it stands in; there it goes on, step after step, as
long as it stays: it carries its cell and walks from cell to cell across faces (the side that the cell's own coordinates
overstep), looks among the leaf's cells where a walk ends, and takes the nearest node's values where no cell holds it. A
point that comes to another leaf, between steps or within one, is carried on with all it knows. So lines need as many rounds
as leaves they cross, not as they have steps; each round is written, and the plan doesn't grow.

A nearest node is certain if no box of a leaf that isn't held is closer; the few points for which it isn't ask for it by
``knn`` between rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessella.operators import nearest
from tessella.operators.nearest import Tree, hexahedra, trilinear
from tessella.plans.joins import dealt
from tessella.plans.scratch import keep

#: Nodes of a leaf, leaves at most, points that one task carries at once, faces that a walk crosses at most.
LEAF, LEAVES, CARRIED, HOPS = 4096, 4096, 20_000, 12
#: Boxes of a group of a leaf's own index, pairs that one numpy step holds.
GROUP, PAIRS = 16, 1 << 19
STAGES = {"euler": 1, "rk2": 2, "rk4": 4}
CELL, NODE, POINT = range(3)
LINE, LIVE, ASKING = range(3)
#: Local faces of the eight-corner cell by axis and side of its own coordinates.
SIDES = [(0, 3, 7, 4), (1, 2, 6, 5), (0, 1, 5, 4), (3, 2, 6, 7), (0, 1, 2, 3), (4, 5, 6, 7)]
_K = [f"k{s}{c}" for s in range(3) for c in "xyz"]


class _Index:
    """Boxes in groups that a k-d tree of their middles makes, so that a point is compared with the groups it is near only."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray) -> None:
        self.tree = Tree((lo + hi) / 2, max(1, -(-len(lo) // GROUP)))
        of = self.tree.leaf((lo + hi) / 2)
        self.order = np.argsort(of, kind="stable")
        self.start = np.searchsorted(of[self.order], np.arange(self.tree.leaves + 1))
        at = self.start[:-1]  # every group has a box, as the tree is made of all
        self.tree.boxed(np.minimum.reduceat(lo[self.order], at), np.maximum.reduceat(hi[self.order], at))

    def pairs(self, p: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(point, box) for the boxes of groups whose own box a point's ball meets, all of a point at once."""
        many = np.zeros(len(p), np.int64)
        who, group = self.tree.met(p, radius)
        np.add.at(many, who, self.start[group + 1] - self.start[group])
        by = np.argsort(who, kind="stable")
        who, group = who[by], group[by]
        ends = np.searchsorted(who, np.arange(len(p) + 1))
        begin, upto = 0, np.cumsum(many)
        while begin < len(p):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, side="right")))
            g = group[ends[begin] : ends[end]]
            n = self.start[g + 1] - self.start[g]
            j = self.order[np.repeat(self.start[g] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(g) else np.zeros(0, np.int64)
            yield np.repeat(who[ends[begin] : ends[end]], n), j
            begin = end

    def nearest(self, p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of the places at, which are the boxes, and the squared distance; ties go to the first."""
        best, d2 = np.zeros(len(p), np.int64), np.full(len(p), np.inf)
        begin, end = self.start[(group := self.tree.leaf(p))], self.start[group + 1]
        own = np.full(len(p), np.inf)  # the nearest of the own group bounds the way
        for k in range(int((end - begin).max(initial=0))):
            gap = p - at[self.order[np.minimum(begin + k, end - 1)]]
            own = np.minimum(own, (gap * gap).sum(1))
        for i, j in self.pairs(p, np.sqrt(own)):
            gap = [p[i, c] - at[j, c] for c in range(3)]
            far = gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]
            order = np.lexsort((j, far, i))
            i, j, far = i[order], j[order], far[order]
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
            best[i[first]], d2[i[first]] = j[first], far[first]
        return best, d2


class _Mesh:
    """A leaf's cells and nodes in a task."""

    def __init__(self, cells: list, nodes: list, m: int) -> None:
        self.ids = np.array([c[0] for c in cells], np.int64)
        order = np.argsort(self.ids, kind="stable")
        self.ids = self.ids[order]
        self.corners = np.array([c[2] for c in cells], float).reshape(-1, 8, 3)[order]
        self.values = np.array([c[3] for c in cells], float).reshape(-1, 8, m)[order]
        self.lo, self.hi = (self.corners.min(1) - 1e-9, self.corners.max(1) + 1e-9) if len(cells) else (np.zeros((0, 3)),) * 2
        rows = sorted(nodes)
        self.at = np.array([n[2] for n in rows], float).reshape(-1, 3)
        self.node_values = np.array([n[3] for n in rows], float).reshape(-1, m)
        self.cells = self.points = None  # indexes, made where a walk ends
        self.beyond = self._beyond(np.array([c[1] for c in cells], np.int64).reshape(-1, 8)[order])

    def _beyond(self, corners: np.ndarray) -> np.ndarray:
        """The cell across each of six sides, -1 for none here."""
        out = np.full((len(corners), 6), -1, np.int64)
        if len(corners):
            faces = np.sort(corners[:, np.array(SIDES)].reshape(-1, 4), axis=1)
            order = np.lexsort(faces.T[::-1])
            same = np.flatnonzero((faces[order[1:]] == faces[order[:-1]]).all(1))
            a, b = order[same], order[same + 1]
            out.reshape(-1)[a], out.reshape(-1)[b] = b // 6, a // 6
        return out

    def place(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.full(len(ids), -1, np.int64)
        k = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[k] == ids, k, -1)

    def locate(self, p: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each point, from the one it was in, and the corners' weights; -1 for none."""
        found, weights = np.full(len(p), -1, np.int64), np.zeros((len(p), 8))
        now, on = cell.copy(), np.flatnonzero(cell >= 0)
        for _ in range(HOPS):
            if not len(on):
                break
            w, ok, s = trilinear(p[on], self.corners[now[on]], own=True)
            found[on[ok]], weights[on[ok]] = now[on[ok]], w[ok]
            axis = np.abs(s).argmax(1)
            side = 2 * axis + (s[np.arange(len(s)), axis] > 0)
            now[on] = np.where(ok, now[on], self.beyond[now[on], side])
            on = on[~ok & (now[on] >= 0)]
        rest = np.flatnonzero(found < 0)
        if len(rest) and len(self.ids):
            self.cells = self.cells or _Index(self.lo, self.hi)
            for i, j in self.cells.pairs(p[rest], np.zeros(len(rest))):
                i = rest[i]
                inside = (self.lo[j] <= p[i]).all(1) & (p[i] <= self.hi[j]).all(1)
                i, j = i[inside], j[inside]
                w, ok = trilinear(p[i], self.corners[j])
                i, j, w = i[ok], j[ok], w[ok]
                order = np.lexsort((j, i))[::-1]  # the first of several cells stays
                found[i[order]], weights[i[order]] = j[order], w[order]
        return found, weights

    def nearest(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest node of each point and the squared distance; ties go to the lowest id."""
        self.points = self.points or _Index(self.at, self.at)
        return self.points.nearest(p, self.at)


def _leaves_of_boxes(tree: Tree, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf whose region a box reaches into."""
    who, node, out = np.arange(len(lo)), np.zeros(len(lo), np.int64), []
    while len(who):
        end = tree.axis[node] < 0
        out.append((who[end], tree.left[node[end]]))
        who, node = who[~end], node[~end]
        low, high = lo[who, tree.axis[node]] < tree.cut[node], hi[who, tree.axis[node]] >= tree.cut[node]
        who, node = np.concatenate([who[low], who[high]]), np.concatenate([tree.left[node[low]], tree.right[node[high]]])
    return tuple(np.concatenate([o[k] for o in out]) for k in range(2))


class _Field:
    """A mesh with the values to look up, cut into leaves and written once."""

    def __init__(self, cells: DataFrame, nodes: DataFrame, names: list[str], leaf: int) -> None:
        spark = nodes.sparkSession
        self.names, self.m = [f"v{k}" for k in range(len(names))], len(names)
        self.nodes = keep(nodes.select(F.col("node_id").cast("long").alias("source_id"), *(F.col(c).cast("double").alias(c) for c in "xyz"), *(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(v) for v, c in zip(self.names, names, strict=True))).where("x is not null and y is not null and z is not null"), "trace-nodes")
        n = self.nodes.count()
        b = self.nodes.agg(*(f(c).alias(c + k) for c in "xyz" for f, k in ((F.min, "0"), (F.max, "1")))).first()
        self.lo, self.hi = (np.array([b[c + k] if n else 0.0 for c in "xyz"]) for k in "01")
        leaves, share = max(1, min(LEAVES, -(-n // leaf))), min(1.0, nearest.SAMPLE / max(n, 1))
        sample = self.nodes.select("x", "y", "z").sample(share, 7).limit(2 * nearest.SAMPLE).toArrow() if share < 1 else self.nodes.select("x", "y", "z").toArrow()
        tree = Tree(np.column_stack([sample.column(c).to_numpy() for c in "xyz"]), leaves)
        cuts = spark.sparkContext.broadcast(tree)
        placed = nearest._dealt(self.nodes, "source_id", cuts, tuple(self.names))
        boxes = placed.groupBy("leaf").agg(*(f(c) for c in "xyz" for f in (F.min, F.max))).toArrow()  # LEAVES rows at most
        lo, hi = np.full((tree.leaves, 3), np.inf), np.full((tree.leaves, 3), -np.inf)
        of = boxes.column("leaf").to_numpy()
        for c in range(3):
            lo[of, c], hi[of, c] = boxes.column(1 + 2 * c).to_numpy(), boxes.column(2 + 2 * c).to_numpy()
        tree.boxed(lo, hi)
        self.held = {}  # leaves close to a leaf, their nodes are its own too
        for k in of.tolist():
            gap = np.maximum(0, np.maximum(lo[k] - hi, lo - hi[k]))
            self.held[k] = np.flatnonzero((gap * gap).sum(1) <= (0.5 * (hi[k] - lo[k]).max()) ** 2)
        self.tree = spark.sparkContext.broadcast((tree, self.held))
        pairs = spark.createDataFrame([(int(a), k) for k, near in self.held.items() for a in near], "leaf int, home int")
        own = placed.join(F.broadcast(pairs), "leaf")
        rows = own.select(F.col("home").alias("leaf"), F.lit(NODE).alias("kind"), F.col("source_id").alias("id"), F.lit(None).cast("array<long>").alias("nodes"), F.array("x", "y", "z").alias("p"), F.array(*self.names).alias("v"))
        hexes = hexahedra(cells, self.nodes.withColumnRenamed("source_id", "node_id"), self.names)
        boxed = [c + k for k in "01" for c in "xyz"]

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                box = np.column_stack([batch.column(c).to_numpy() for c in boxed])
                row, at = _leaves_of_boxes(cuts.value, box[:, :3] - 1e-9, box[:, 3:] + 1e-9)
                got = batch.select(["id", "nodes", "p", "v"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), CELL, np.int32)), *got.columns], names=["leaf", "kind", "id", "nodes", "p", "v"])

        cell_rows = hexes.select(F.col("cell_id").cast("long").alias("id"), "nodes", "p", "v", *boxed).mapInArrow(spread, "leaf int, kind int, id long, nodes array<long>, p array<double>, v array<double>")
        self.table = keep(cell_rows.unionByName(rows).repartition("leaf").sortWithinPartitions("leaf"), "trace-mesh")

    def nearest_values(self, asking: DataFrame) -> DataFrame:
        """asking (point_id, sign, tx, ty, tz and more) with the values of the nearest node in g0 .."""
        q = keep(asking.withColumn("_q", F.monotonically_increasing_id()), "trace-asking")
        n = nearest.knn(q.select(F.col("_q").alias("point_id"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z")), self.nodes, 1)
        v = n.select(F.col("point_id").alias("_q"), "source_id").join(dealt(self.nodes.select("source_id", *(F.col(c).alias(f"g{k}") for k, c in enumerate(self.names)))), "source_id").drop("source_id")
        return q.drop(*(f"g{k}" for k in range(self.m))).join(dealt(v), "_q").drop("_q")


def _schema(m: int) -> StructType:
    doubles = ["x", "y", "z", "travel", *_K, "tx", "ty", "tz", *(f"g{k}" for k in range(m))]
    return StructType.fromDDL("what int, point_id long, sign int, place int, stage int, ends int, cell long, leaf int, " + ", ".join(f"{c} double" for c in doubles))


def _carry(field: _Field, step: float, steps: int, method: str, length: float | None):
    """A mapInArrow function that carries points on within their leaves."""
    m, tree_held, box = field.m, field.tree, ((field.lo - (field.hi - field.lo) / 2), (field.hi + (field.hi - field.lo) / 2))
    stages = STAGES[method]
    schema = _schema(m)
    arrow = to_arrow_schema(schema)
    given = [f"g{k}" for k in range(m)]

    def target(s: dict[str, np.ndarray]) -> np.ndarray:
        k = np.stack([s[c] for c in _K], 1).reshape(-1, 3, 3)
        part = np.choose(s["stage"], [0.0, step / 2, step / 2, step])
        last = k[np.arange(len(k)), np.maximum(s["stage"] - 1, 0)]
        return np.stack([s["x"], s["y"], s["z"]], 1) + part[:, None] * last

    def given_rows(s: dict[str, np.ndarray], pick: np.ndarray, what: int, leaf: int) -> pa.RecordBatch:
        cols = {n: s[n][pick] for n in arrow.names if n not in ("what", "leaf")}
        n = int(pick.sum()) if pick.dtype == bool else len(pick)
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name] if f.name in cols else np.full(n, what if f.name == "what" else leaf), f.type) for f in arrow], schema=arrow)

    def carried(mesh: _Mesh, leaf: int, s: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        tree, held = tree_held.value
        near_leaves = held.get(leaf, np.zeros(0, np.int64))
        while len(s["point_id"]):
            t = target(s)
            s["tx"], s["ty"], s["tz"] = t.T
            at = tree.leaf(t)
            known = ~np.isnan(s["g0"])
            away = (at != leaf) & ~known
            for other in np.unique(at[away]).tolist():
                yield given_rows(s, away & (at == other), LIVE, other)
            s, t = {k: v[~away] for k, v in s.items()}, t[~away]
            if not len(t):
                return
            known = ~np.isnan(s["g0"])
            cell, w = mesh.locate(t, mesh.place(s["cell"]))
            inside = (cell >= 0) & ~known
            values = np.stack([s[g] for g in given], 1)
            values[inside] = np.einsum("nk,nkm->nm", w[inside], mesh.values[cell[inside]])
            s["cell"] = np.where(inside, mesh.ids[np.maximum(cell, 0)] if len(mesh.ids) else -1, -1)
            out = np.flatnonzero(~inside & ~known)
            if len(out) and len(mesh.at):
                j, d2 = mesh.nearest(t[out])
                i, boxes = tree.met(t[out], np.sqrt(d2))
                unsure = np.zeros(len(out), bool)
                unsure[i[~np.isin(boxes, near_leaves)]] = True
                values[out] = mesh.node_values[j]
                ask = np.zeros(len(t), bool)
                ask[out[unsure]] = True
            else:
                ask = ~inside & ~known
            if ask.any():
                yield given_rows(s, ask, ASKING, leaf)
            s, values = {k: v[~ask] for k, v in s.items()}, values[~ask]
            for g in given:
                s[g] = np.full(len(values), np.nan)
            first = s["stage"] == 0
            if first.any():  # a point of the line, with its values
                row = {k: v[first] for k, v in s.items()} | {g: values[first, k] for k, g in enumerate(given)}
                yield given_rows(row, np.ones(int(first.sum()), bool), LINE, leaf)
            alive = ~(first & (s["ends"] == 1))
            s, values = {k: v[alive] for k, v in s.items()}, values[alive]
            v = s["sign"][:, None] * values[:, :3]
            whole = s["stage"] == stages - 1
            for stage in range(3):
                on = (s["stage"] == stage) & ~whole
                for c, axis in enumerate("xyz"):
                    s[f"k{stage}{axis}"][on] = v[on, c]
            if stages == 4:
                k = np.stack([s[c] for c in _K], 1).reshape(-1, 3, 3)
                v = (k[:, 0] + 2 * k[:, 1] + 2 * k[:, 2] + v) / 6
            move = step * v[whole]
            for c, axis in enumerate("xyz"):
                s[axis][whole] += move[:, c]
            s["travel"][whole] += np.sqrt((move * move).sum(1))
            s["place"][whole] += 1
            s["stage"] = np.where(whole, 0, s["stage"] + 1).astype(s["stage"].dtype)
            stop = s["place"] >= steps
            if length:
                stop |= s["travel"] >= length
            s["ends"] = np.where(whole & stop, 1, s["ends"]).astype(s["ends"].dtype)
            p = np.stack([s["x"], s["y"], s["z"]], 1)
            stays = ~whole | ((p >= box[0]).all(1) & (p <= box[1]).all(1))
            s = {k: x[stays] for k, x in s.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mesh, cells, nodes = None, None, [], []
        for batch in batches:
            leaf, copy, kind = (batch.column(c).to_numpy() for c in ("leaf", "copy", "kind"))
            key = np.column_stack([leaf, copy, kind])
            for part in np.split(np.arange(len(key)), np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1):
                if not len(part):
                    continue
                if (leaf[part[0]], copy[part[0]]) != now:
                    now, mesh, cells, nodes = (leaf[part[0]], copy[part[0]]), None, [], []
                rows = batch.slice(int(part[0]), len(part))
                if kind[part[0]] == POINT:
                    mesh = mesh or _Mesh(cells, nodes, m)
                    for a in range(0, len(part), CARRIED):
                        some = rows.slice(a, CARRIED)
                        yield from carried(mesh, int(now[0]), {n: some.column(n).to_numpy(zero_copy_only=False).copy() for n in arrow.names if n not in ("what", "leaf")})
                else:
                    got = list(zip(*(rows.column(c).to_pylist() for c in ("id", "nodes", "p", "v")), strict=True))
                    (cells if kind[part[0]] == CELL else nodes).extend(got)

    return run, schema


def _traced(seeds: DataFrame, field: _Field, signs: list[int], step: float, steps: int, method: str, length: float | None) -> DataFrame:
    """Rows of _schema that are points of lines."""
    spark = seeds.sparkSession
    run, schema = _carry(field, step, steps, method, length)
    doubles = {c: F.lit(0.0) for c in ("travel", *_K)} | {f"g{k}": F.lit(float("nan")) for k in range(field.m)}
    start = seeds.select(F.col("point_id").cast("long").alias("point_id"), *(F.col(c).cast("double").alias(c) for c in "xyz")).withColumn("sign", F.explode(F.array(*map(F.lit, signs))))
    start = start.withColumns({"place": F.lit(0), "stage": F.lit(0), "ends": F.lit(int(steps <= 0)), "cell": F.lit(-1).cast("long"), "what": F.lit(LIVE), **doubles}).withColumns({"t" + c: F.col(c) for c in "xyz"})
    tree = spark.sparkContext.broadcast(field.tree.value[0])

    def first_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = tree.value.leaf(np.column_stack([batch.column("t" + c).to_numpy() for c in "xyz"]))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)) if f.name == "leaf" else batch.column(f.name).cast(f.type) for f in to_arrow_schema(schema)], schema=to_arrow_schema(schema))

    live = keep(start.mapInArrow(first_leaf, schema), "trace-seeds")
    paths: list[str] = []
    while True:
        asked = F.broadcast(live.groupBy("leaf").agg(F.ceil(F.count("*") / CARRIED).alias("copies")))  # LEAVES rows at most
        here = live.join(asked, "leaf").withColumns({"copy": F.pmod(F.xxhash64("point_id", "sign"), F.col("copies")), "kind": F.lit(POINT)}).drop("copies")
        mesh = field.table.join(asked, "leaf").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
        both = mesh.unionByName(here, allowMissingColumns=True).repartition("leaf", "copy").sortWithinPartitions("leaf", "copy", "kind")
        moved = keep(both.mapInArrow(run, schema), "trace")
        paths += [f.rsplit("/", 1)[0] for f in moved.inputFiles()[:1]]
        n = moved.groupBy("what").count().collect()
        n = {r["what"]: r["count"] for r in n}
        if not n.get(LIVE) and not n.get(ASKING):
            break
        live = moved.where(F.col("what") == LIVE)
        if n.get(ASKING):
            live = live.unionByName(field.nearest_values(moved.where(F.col("what") == ASKING)))
    out = spark.read.schema(schema).parquet(*paths) if paths else moved  # one scan, however many rounds
    return out.where(F.col("what") == LINE)


def streamlines(seeds: DataFrame, cells: DataFrame, nodes: DataFrame, names: tuple[str, str, str], step: float, steps: int, direction: str = "forward", method: str = "rk4", length: float | None = None, scalar: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(point_id, direction, place, x, y, z, arc, scalar) of lines from seeds (point_id, x, y, z) (R2).

    A step goes by step times the velocity (rk4, rk2 or euler), forward, backward or both; at most steps of them. A line ends
    with the first point whose way so far, arc, is length or more, and before the first that is outside the mesh's box by
    more than half its size. Where no cell is, the nearest node's velocity counts. Missing velocities are 0."""
    if method not in STAGES:
        raise ValueError(f"unknown method {method!r}")
    field = _Field(cells, nodes, [*names, *([scalar] if scalar else [])], leaf)
    signs = {"forward": [1], "backward": [-1], "both": [1, -1]}[direction]
    out = _traced(seeds, field, signs, step, steps, method, length)
    return out.select("point_id", F.when(F.col("sign") == 1, "forward").otherwise("backward").alias("direction"), "place", "x", "y", "z", F.col("travel").alias("arc"), *([F.col("g3").alias(scalar)] if scalar else []))


def pathlines(seeds: DataFrame, cells: DataFrame, cycles: list[DataFrame], names: tuple[str, str, str], step: float, steps: int, method: str = "rk4", direction: str = "forward", scalar: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(point_id, cycle_place, place, x, y, z, scalar): each cycle's node table carries the points on from the end of the one before
    (R3), by at least one step."""
    now, out = seeds.select("point_id", "x", "y", "z"), None
    for c, nodes in enumerate(cycles):
        line = keep(streamlines(now, cells, nodes, names, step, max(1, steps), direction, method, scalar=scalar, leaf=leaf).withColumn("cycle_place", F.lit(c)), "path")
        out = line if out is None else out.unionByName(line)
        now = line.groupBy("point_id").agg(*(F.max_by(a, "place").alias(a) for a in "xyz"))
    return out.select("point_id", "cycle_place", "place", "x", "y", "z", *([scalar] if scalar else []))


def surface_lines(faces: DataFrame, nodes: DataFrame, cells: DataFrame, names: tuple[str, str, str], step: float, steps: int, method: str = "rk4", length: float | None = None, scalar: str | None = None) -> DataFrame:
    """Short lines from the centres of faces (R4); methods other than rk4 are rk2."""
    from tessella.operators.topology import face_geometry

    seeds = face_geometry(faces, nodes).select(F.col("face_id").alias("point_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return streamlines(seeds, cells, nodes, names, step, steps, "forward", "rk4" if method == "rk4" else "rk2", length, scalar)


def spacing_grid(nodes: DataFrame, origin, normal, space_u: float = 1.0, space_v: float = 1.0) -> DataFrame:
    """(point_id, x, y, z): seeds on a plane through a point, a fortieth of the mesh's greater extent in x and y apart, times
    the spacings along the plane's two directions; as many as the extents hold, centred on the point (R1)."""
    b = nodes.agg(*(f(c).alias(c + n) for c in "xy" for f, n in ((F.min, "0"), (F.max, "1")))).first()
    u, v = max(b["x1"] - b["x0"], 1e-9), max(b["y1"] - b["y0"], 1e-9)
    step = max(u, v) / 40.0
    nu, nv = max(1, int(u / max(step * space_u, 1e-9))), max(1, int(v / max(step * space_v, 1e-9)))
    n = np.array(normal, float) / max(float(np.linalg.norm(normal)), 1e-12)
    along = np.array([1.0, 0.0, 0.0]) if abs(n[0]) <= 0.99 else np.array([0.0, 1.0, 0.0])
    along = along - along @ n * n
    along /= max(float(np.linalg.norm(along)), 1e-12)
    across = np.cross(n, along)
    i, j = F.floor(F.col("id") / nv) - (nu - 1) / 2, F.col("id") % nv - (nv - 1) / 2
    at = [F.lit(float(o)) + i * F.lit(step * space_u * float(a)) + j * F.lit(step * space_v * float(c)) for o, a, c in zip(origin, along, across, strict=True)]
    return nodes.sparkSession.range(nu * nv).select(F.col("id").alias("point_id"), *(e.alias(c) for e, c in zip(at, "xyz", strict=True)))
