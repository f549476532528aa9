"""Plane cuts, iso-surfaces and iso-lines, integrals over them, and planes that move from frame to frame.

A cell is cut where its nodes lie on both sides of f = 0 (a node is above where f >= 0). Each cut edge gives a point at
t = f0 / (f0 - f1), with the fields interpolated. The points of a cell, ordered by angle about their mean, make its polygon:
cells of the four types are convex, so their cuts are. A plane through a shared face is counted once, by the cell below."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import topology
from tessella.plans.joins import dealt


def plane(origin, normal) -> Column:
    """(p - origin) . normal for a unit normal, a column over x, y, z."""
    n = math.sqrt(sum(float(c) ** 2 for c in normal))
    return sum(((F.col(c) - F.lit(float(o))) * F.lit(float(e) / n) for c, o, e in zip("xyz", origin, normal, strict=True)), F.lit(0.0))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later expressions refer to and don't repeat: a generator of one row keeps the optimizer from putting each
    expression in the place of its name, which for arrays within arrays costs far more than the row."""
    given = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once")
    return df.drop(*columns).select("*", given).select("*", "_once.*").drop("_once")


def corners(cells: DataFrame, nodes: DataFrame, f: Column, fields: list[str]) -> DataFrame:
    """(cell_id, cell_type, c, lo, hi, box): each cell's corners as structs with f and the fields, f's range and the bounding box. The
    only join of nodes and cells, however many cuts follow."""
    at = nodes.select(F.col("node_id").alias("id"), "x", "y", "z", f.alias("_f"), *fields)
    j = cells.select("cell_id", "cell_type", F.posexplode("nodes").alias("place", "id")).join(dealt(at), "id").repartition("cell_id", "cell_type")
    c = F.array_sort(F.collect_list(F.struct("place", "id", "x", "y", "z", "_f", *fields)))
    return j.groupBy("cell_id", "cell_type").agg(c.alias("c"), F.min("_f").alias("lo"), F.max("_f").alias("hi"), *(g(a).alias(a + n) for a in "xyz" for g, n in ((F.min, "0"), (F.max, "1"))))


def cut_cells(cells: DataFrame, f, fields: list[str]) -> DataFrame:
    """(slice, cell_id, p): the points where a cell's edges cross f = 0, for rows (slice, cell_id, cell_type, c); f takes a corner."""
    ends = F.lit(None)
    for kind, edges in topology.EDGES.items():
        pick = F.array(*(F.struct(F.get("c", F.lit(a)).alias("p"), F.get("c", F.lit(b)).alias("q")) for a, b in edges))
        ends = F.when(F.col("cell_type") == kind, pick).otherwise(ends)
    crossed = F.filter(ends, lambda e: (f(e["p"]) >= 0) != (f(e["q"]) >= 0))
    # from the lower node on, so that all cells of an edge get the same point
    turned = F.transform("_crossed", lambda e: F.when(e["p"]["id"] < e["q"]["id"], e).otherwise(F.struct(e["q"].alias("p"), e["p"].alias("q"))))
    timed = F.transform("_turned", lambda e: F.struct(e["p"].alias("p"), e["q"].alias("q"), (f(e["p"]) / (f(e["p"]) - f(e["q"]))).alias("t")))
    points = F.transform("_timed", lambda e: F.struct(*((e["p"][n] + e["t"] * (e["q"][n] - e["p"][n])).alias(n) for n in ("x", "y", "z", *fields))))
    out = _once(cells, _crossed=crossed).where(F.size("_crossed") >= 3)
    out = _once(_once(out, _turned=turned), _timed=timed)
    return _once(out.select("slice", "cell_id", "_timed"), p=points).select("slice", "cell_id", "p")


def at_most(sorted_: Column, v: Column, n: int) -> Column:
    """How many of a sorted array's n values are v or less, by bisection."""
    steps = [1 << k for k in reversed(range(max(1, n.bit_length())))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= n) & (F.coalesce(F.get(sorted_, F.least(at + step, F.lit(n)) - 1), F.lit(0.0)) <= v), at + step).otherwise(at))


def _basis(normal) -> tuple[list[float], list[float]]:
    n = math.sqrt(sum(float(c) ** 2 for c in normal))
    e = [float(c) / n for c in normal]
    least = min(range(3), key=lambda k: abs(e[k]))
    axis = [float(k == least) for k in range(3)]
    u = [e[1] * axis[2] - e[2] * axis[1], e[2] * axis[0] - e[0] * axis[2], e[0] * axis[1] - e[1] * axis[0]]
    m = math.sqrt(sum(c * c for c in u))
    u = [c / m for c in u]
    return u, [e[1] * u[2] - e[2] * u[1], e[2] * u[0] - e[0] * u[2], e[0] * u[1] - e[1] * u[0]]


def polygons(points: DataFrame, fields: list[str]) -> DataFrame:
    """(slice, cell_id, n, ring): the points p of each cell in order around their mean.

    Angles are taken in the plane of the three axes' projection in which the points spread most."""
    mean = lambda c: F.aggregate("p", F.lit(0.0), lambda s, e: s + e[c]) / F.size("p")
    first = F.get("p", F.lit(0))
    g = _once(points.where(F.size("p") >= 3), **{"m" + c: mean(c) for c in "xyz"}, **{"f" + c: first[c] for c in "xyz"}, n=F.size("p"))
    # normal: cross product of (first - mean) with the point that makes it longest
    a = [F.col("f" + c) - F.col("m" + c) for c in "xyz"]
    cross = lambda e: [a[1] * (e["z"] - F.col("mz")) - a[2] * (e["y"] - F.col("my")), a[2] * (e["x"] - F.col("mx")) - a[0] * (e["z"] - F.col("mz")), a[0] * (e["y"] - F.col("my")) - a[1] * (e["x"] - F.col("mx"))]
    sized = F.transform("p", lambda e: F.struct(sum((c * c for c in cross(e)), F.lit(0.0)).alias("s"), *(c.alias(n) for c, n in zip(cross(e), "xyz", strict=True))))
    g = _once(g, _n=F.array_max(sized))
    n = [F.col("_n." + c) / F.sqrt(F.col("_n.s")) for c in "xyz"]
    m = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    g = _once(g.where("_n.s > 0"), **{f"_u{c}": a[k] / m for k, c in enumerate("xyz")}, **{f"_k{c}": n[k] for k, c in enumerate("xyz")})
    u, k = [F.col("_u" + c) for c in "xyz"], [F.col("_k" + c) for c in "xyz"]
    v = [k[1] * u[2] - k[2] * u[1], k[2] * u[0] - k[0] * u[2], k[0] * u[1] - k[1] * u[0]]
    along = lambda e, d: sum(((e[c] - F.col("m" + c)) * d[i] for i, c in enumerate("xyz")), F.lit(0.0))
    ring = F.array_sort(F.transform("p", lambda e: F.struct(F.atan2(along(e, v), along(e, u)).alias("angle"), e.alias("p"))))
    return _once(g, ring=F.transform(ring, lambda e: e["p"])).select("slice", "cell_id", "n", "ring")


def slice_triangles(polys: DataFrame) -> DataFrame:
    """(slice, cell_id, i, a, b, c): fan triangles, corners as structs."""
    fan = F.transform(F.sequence(F.lit(1), F.size("ring") - 2), lambda i: F.struct(i.alias("i"), F.get("ring", F.lit(0)).alias("a"), F.get("ring", i).alias("b"), F.get("ring", i + 1).alias("c")))
    return polys.select("slice", "cell_id", F.explode(fan).alias("t")).select("slice", "cell_id", "t.*")


def integrate(tri: DataFrame, normal=None, scalar: str | None = None, vector: tuple[str, str, str] | None = None) -> DataFrame:
    """(slice, area, integral, average, flux, vx, vy, vz) of triangles: area, that of s, its mean, of v . n and of v.

    normal: of the plane; None: each triangle's own. Values are the means of the corners."""
    ab, ac = [F.col(f"b.{c}") - F.col(f"a.{c}") for c in "xyz"], [F.col(f"c.{c}") - F.col(f"a.{c}") for c in "xyz"]
    k = topology._cross(tuple(ab), tuple(ac))
    t = tri.withColumns({"kx": k[0], "ky": k[1], "kz": k[2]}).withColumn("area", F.sqrt(F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky") + F.col("kz") * F.col("kz")) / 2)
    mean = lambda f: (F.col(f"a.{f}") + F.col(f"b.{f}") + F.col(f"c.{f}")) / 3
    unit = [F.col("k" + c) / F.when(F.col("area") > 0, 2 * F.col("area")).otherwise(F.lit(1.0)) for c in "xyz"]
    if normal is not None:
        n = math.sqrt(sum(float(c) ** 2 for c in normal))
        unit = [F.lit(float(c) / n) for c in normal]
    total = [F.sum("area").alias("area")]
    if scalar:
        total.append(F.sum(mean(scalar) * F.col("area")).alias("integral"))
    if vector:
        total += [F.sum(sum((mean(v) * u for v, u in zip(vector, unit, strict=True)), F.lit(0.0)) * F.col("area")).alias("flux"), *(F.sum(mean(v) * F.col("area")).alias("v" + c) for v, c in zip(vector, "xyz", strict=True))]
    out = t.groupBy("slice").agg(*total)
    return out.withColumn("average", F.col("integral") / F.when(F.col("area") > 0, F.col("area"))) if scalar else out


def cut_where(cells: DataFrame, nodes: DataFrame, f: Column, fields: list[str]) -> DataFrame:
    """Polygons where f, a column over the nodes, is 0."""
    c = corners(cells, nodes, f, fields).where("lo < 0 and hi >= 0").withColumn("slice", F.lit(0))
    return polygons(cut_cells(c, lambda e: e["_f"], fields), fields)


def cut(cells: DataFrame, nodes: DataFrame, origin, normal, fields: list[str]) -> DataFrame:
    """Polygons of one plane."""
    return cut_where(cells, nodes, plane(origin, normal), fields)


def disk(cells: DataFrame, nodes: DataFrame, centre, normal, radius: float, fields: list[str]) -> DataFrame:
    """Polygons of a plane through a centre within a radius of it: edges that leave the disk end where the square of the
    distance, taken as linear along the edge, is that of the radius (F21)."""
    polys = cut(cells, nodes, centre, normal, fields)
    g = lambda e: F.lit(float(radius) ** 2) - sum(((e[c] - F.lit(float(o))) * (e[c] - F.lit(float(o))) for c, o in zip("xyz", centre, strict=True)), F.lit(0.0))
    names = ("x", "y", "z", *fields)
    point = lambda a, b: F.struct(*((a[n] + g(a) / (g(a) - g(b)) * (b[n] - a[n])).alias(n) for n in names))
    own = lambda a: F.struct(*(a[n].alias(n) for n in names))
    step = lambda a, b: F.when((g(a) >= 0) & (g(b) >= 0), F.array(own(a))).when(g(a) >= 0, F.array(own(a), point(a, b))).when(g(b) >= 0, F.array(point(a, b)))
    turned = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    pieces = F.filter(F.zip_with("ring", turned, step), lambda x: x.isNotNull())
    out = polys.select("slice", "cell_id", F.flatten(pieces).alias("ring"))
    return out.where(F.size("ring") >= 3).select("slice", "cell_id", F.size("ring").alias("n"), "ring")


def levels(lo: float, hi: float, n: int) -> list[float]:
    """n values strictly between two."""
    return [lo + (hi - lo) * (i + 1) / (n + 1) for i in range(n)]


def isosurfaces(cells: DataFrame, nodes: DataFrame, value: str, at: list[float], fields: list[str]) -> DataFrame:
    """Polygons where a node field has the values; slice is the value's place in the list.

    A cell's range of the field meets the sorted values by bisection, so nodes and cells join once for all levels."""
    order = sorted(range(len(at)), key=lambda k: at[k])
    if not at:
        return cut_where(cells.limit(0), nodes, F.lit(0.0), fields)
    levels_ = F.array(*(F.lit(float(at[k])) for k in order))
    places = F.array(*(F.lit(k) for k in order))
    c = corners(cells, nodes, F.col(value), fields)
    low, high = at_most(levels_, F.col("lo"), len(at)), at_most(levels_, F.col("hi"), len(at))
    c = c.withColumns({"_low": low, "_high": high}).where("_high > _low")
    hit = F.arrays_zip(F.slice(places, F.col("_low") + 1, F.col("_high") - F.col("_low")).alias("slice"), F.slice(levels_, F.col("_low") + 1, F.col("_high") - F.col("_low")).alias("level"))
    c = c.withColumn("_hit", F.explode(hit)).withColumns({"slice": F.col("_hit.slice"), "_level": F.col("_hit.level")})
    return polygons(cut_cells(c, lambda e: e["_f"] - F.col("_level"), fields), fields)


def isolines(polys: DataFrame, value: str, at: list[float]) -> DataFrame:
    """(slice, cell_id, level, x, y, z): points where edges of polygons cross a field's values."""
    ring = F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    e = polys.select("slice", "cell_id", F.explode(ring).alias("e"))
    met = F.filter(F.array(*(F.lit(float(v)) for v in at)), lambda v: (F.col(f"e.a.{value}") - v >= 0) != (F.col(f"e.b.{value}") - v >= 0))
    e = e.withColumn("level", F.explode(met))
    fa, fb = F.col(f"e.a.{value}") - F.col("level"), F.col(f"e.b.{value}") - F.col("level")
    e = e.withColumn("t", fa / (fa - fb))
    return e.select("slice", "cell_id", "level", *((F.col(f"e.a.{c}") + F.col("t") * (F.col(f"e.b.{c}") - F.col(f"e.a.{c}"))).alias(c) for c in "xyz"))


def boundary_line(cells: DataFrame, nodes: DataFrame, origin, normal) -> DataFrame:
    """(cell_id, local, x, y, z): where edges of exterior faces cross a plane."""
    f = topology.exterior_faces(cells)
    ring = F.zip_with("nodes", F.concat(F.slice("nodes", 2, F.size("nodes")), F.slice("nodes", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    e = f.select("cell_id", "local", F.explode(ring).alias("e")).select("cell_id", "local", "e.a", "e.b")
    at = nodes.select("node_id", "x", "y", "z", plane(origin, normal).alias("f"))
    for k in "ab":
        e = e.join(dealt(at.select(F.col("node_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("x", "y", "z", "f")))), k)
    e = e.where((F.col("f_a") >= 0) != (F.col("f_b") >= 0)).withColumn("t", F.col("f_a") / (F.col("f_a") - F.col("f_b")))
    return e.select("cell_id", "local", *((F.col(f"{c}_a") + F.col("t") * (F.col(f"{c}_b") - F.col(f"{c}_a"))).alias(c) for c in "xyz"))


def cylinder_cut(cells: DataFrame, nodes: DataFrame, radius: float, half_height: float, axis: str, fields: list[str]) -> DataFrame:
    """Polygons where cells cross a radius, those whose mean is within a height either way."""
    from tessella.functions.expr import cylindrical

    r, _, _ = cylindrical("x", "y", "z", axis)
    polys = cut_where(cells, nodes, r - F.lit(float(radius)), fields)
    mean = F.aggregate("ring", F.lit(0.0), lambda s, e: s + e[axis]) / F.size("ring")
    return polys.where(F.abs(mean) <= half_height)


def projected(u: Column, v: Column, w: Column, normal) -> tuple[Column, Column, Column]:
    """A vector less its part along a normal."""
    n = math.sqrt(sum(float(c) ** 2 for c in normal))
    e = [F.lit(float(c) / n) for c in normal]
    dot = u * e[0] + v * e[1] + w * e[2]
    return u - dot * e[0], v - dot * e[1], w - dot * e[2]


def moving_planes(spark, frames: int, motion: str, origin, normal, **how) -> DataFrame:
    """(slice, ox, oy, oz, nx, ny, nz): the plane of each frame.

    line: origin + k / (frames - 1) shift; sin, cos: shift times the function of 2 pi k / period; rotation: the normal turned by
    k degrees about an axis (Rodrigues); path: rows (frame, x, y, z) of a table, the nearest frame. loop=True goes on from the
    beginning beyond the last."""
    from tessella.functions.expr import rotation

    n = math.sqrt(sum(float(c) ** 2 for c in normal))
    rows = []
    for k in range(frames):
        o, e = [float(c) for c in origin], [float(c) / n for c in normal]
        shift = how.get("shift", (0.0, 0.0, 0.0))
        if motion == "line":
            steps = how.get("steps", max(frames - 1, 1))
            s = (k % (steps + 1) if how.get("loop") else min(k, steps)) / steps
        elif motion in ("sin", "cos"):
            s = getattr(math, motion)(2 * math.pi * k / how["period"])
        elif motion == "rotation":
            m = rotation(how["axis"], how["degrees"] * k)
            e, s = [sum(m[r][c] * e[c] for c in range(3)) for r in range(3)], 0.0
        elif motion == "path":
            path = sorted(how["path"])
            at = k % (path[-1][0] + 1) if how.get("loop") else k
            o, s = list(map(float, min(path, key=lambda p: (abs(p[0] - at), p[0]))[1:])), 0.0
        else:
            raise ValueError(f"unknown motion {motion!r}")
        rows.append((k, *(a + s * b for a, b in zip(o, shift, strict=True)), *e))
    return spark.createDataFrame(rows, "slice int, ox double, oy double, oz double, nx double, ny double, nz double")


def moving_cut(cells: DataFrame, nodes: DataFrame, planes: DataFrame, fields: list[str]) -> DataFrame:
    """Polygons of all planes of a table of moving_planes in one job.

    Planes of one normal are a family of sorted offsets. A cell's box spans an interval of offsets along each normal, which meets
    the family's offsets by bisection; only the cell's own planes then cut its edges. Nodes and cells join once."""
    families: dict[tuple, list] = {}
    for r in planes.toLocalIterator():  # frames, not data
        n = (r["nx"], r["ny"], r["nz"])
        families.setdefault(n, []).append((sum(r["o" + c] * e for c, e in zip("xyz", n, strict=True)), r["slice"], r["ox"], r["oy"], r["oz"]))
    c = corners(cells, nodes, F.lit(0.0), fields)
    if not families:
        return polygons(cut_cells(c.limit(0).withColumn("slice", F.lit(0)), lambda e: e["_f"], fields), fields)
    hits = []
    for n, rows in families.items():
        rows.sort()
        middle = sum(((F.col(a + "0") + F.col(a + "1")) / 2 * F.lit(e) for a, e in zip("xyz", n, strict=True)), F.lit(0.0))
        half = sum(((F.col(a + "1") - F.col(a + "0")) / 2 * F.lit(abs(e)) for a, e in zip("xyz", n, strict=True)), F.lit(0.0)) * (1 + 1e-9) + 1e-9
        offsets = F.array(*(F.lit(r[0]) for r in rows))
        low, high = at_most(offsets, middle - half, len(rows)), at_most(offsets, middle + half, len(rows))
        all_ = F.array(*(F.struct(F.lit(r[1]).alias("slice"), *(F.lit(v).alias("o" + a) for a, v in zip("xyz", r[2:], strict=True)), *(F.lit(v).alias("n" + a) for a, v in zip("xyz", n, strict=True))) for r in rows))
        hits.append(F.slice(all_, low + 1, F.greatest(high - low, F.lit(0))))
    c = c.withColumn("_cut", F.explode(F.concat(*hits))).withColumn("slice", F.col("_cut.slice"))
    f = lambda e: sum(((e[a] - F.col("_cut.o" + a)) * F.col("_cut.n" + a) for a in "xyz"), F.lit(0.0))
    return polygons(cut_cells(c, f, fields), fields)


def region_surfaces(faces: DataFrame, cells: DataFrame, parts: DataFrame) -> DataFrame:
    """(part_name, face_id): boundary faces of the cells of each part."""
    from tessella.operators.filters import boundary

    b = boundary(faces).select("face_id", F.col("owner").alias("cell_id")).join(dealt(cells.select("cell_id", "cvol_id")), "cell_id")
    return b.join(dealt(parts.select("part_name", "cvol_id").distinct()), "cvol_id").select("part_name", "face_id").distinct()
