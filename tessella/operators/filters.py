"""Filters: materials, volume and surface regions, boxes, windows, ranges of ids, particles."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_material(cells: DataFrame, materials: list[int]) -> DataFrame:
    """Cells of the materials; an empty list keeps all (F1)."""
    return cells.where(F.col("material").isin(materials)) if materials else cells


def by_part(cells: DataFrame, parts: DataFrame, names: list[str]) -> DataFrame:
    """Cells whose cvol_id one of the named parts (part_name, cvol_id) has (F4); no names, all cells (F2)."""
    if not names:
        return cells
    return cells.join(parts.where(F.col("part_name").isin(names)).select("cvol_id").distinct(), "cvol_id", "left_semi")


def resolve_regions(names: DataFrame, parts: DataFrame, strict: bool = False) -> DataFrame:
    """(name, part_name) of region names (F3): FluidRegion is all parts; then an exact part, @VPartRegion_<part>[...],
    FPHPARTS....<part>, the longest part name contained; else all parts, or none if strict. Catalogs, not data."""
    p = parts.select("part_name").distinct()
    inner = F.when(F.col("name") == F.col("part_name"), 1)
    inner = inner.when(F.col("name").startswith(F.concat(F.lit("@VPartRegion_"), F.col("part_name"), F.lit("["))), 2)
    inner = inner.when(F.col("name").startswith("FPHPARTS.") & F.col("name").endswith(F.concat(F.lit("."), F.col("part_name"))), 3)
    inner = inner.when(F.col("name").contains(F.col("part_name")), 4)
    n = names.select("name").distinct()
    found = n.where("name <> 'FluidRegion'").join(F.broadcast(p), F.col("name").contains(F.col("part_name"))).withColumn("rule", inner)
    best = found.groupBy("name").agg(F.min_by("part_name", F.struct("rule", -F.char_length("part_name"), "part_name")).alias("part_name"))
    rest = n.join(best, "name", "left_anti")
    if strict:
        rest = rest.where("name = 'FluidRegion'")
    return best.select("name", "part_name").unionByName(rest.join(F.broadcast(p)).select("name", "part_name"))


def by_overlap(cells: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """0: all cells; k: those of the k-th part by order of first id; beyond: none."""
    if k == 0:
        return cells
    order = parts.groupBy("part_name").agg(F.min("cvol_id").alias("first")).orderBy("first", "part_name").limit(k).collect()  # parts, not cells
    return by_part(cells, parts, [order[k - 1]["part_name"]]) if 0 < k <= len(order) else cells.limit(0)


def boundary(faces: DataFrame) -> DataFrame:
    """Faces without a neighbour, or with -1."""
    return faces.where(F.col("neighbour").isNull() | (F.col("neighbour") < 0))


def on_surfaces(faces: DataFrame, regions: DataFrame, names: list[str]) -> DataFrame:
    """Boundary faces of the named surface regions (name, face_id), once each; no names, all of them."""
    faces = boundary(faces)
    return faces.join(regions.where(F.col("name").isin(names)).select("face_id").distinct(), "face_id", "left_semi") if names else faces


def of_cells(faces: DataFrame, cells: DataFrame) -> DataFrame:
    """Faces whose owner is among cells (F8)."""
    return faces.join(cells.select(F.col("cell_id").alias("owner")).distinct(), "owner", "left_semi")


def in_box(df: DataFrame, x=(None, None), y=(None, None), z=(None, None)) -> DataFrame:
    """Rows with each coordinate between its bounds, None being open."""
    for name, (lo, hi) in (("x", x), ("y", y), ("z", z)):
        if lo is not None:
            df = df.where(F.col(name) >= F.lit(float(lo)))
        if hi is not None:
            df = df.where(F.col(name) <= F.lit(float(hi)))
    return df


def in_rectangle(df: DataFrame, centre, u, v, width: float, height: float) -> DataFrame:
    """Points whose offset from centre along unit vectors u and v is within half of width and height."""
    along = lambda d: sum(((F.col(c) - F.lit(float(o))) * F.lit(float(e)) for c, o, e in zip("xyz", centre, d, strict=True)), F.lit(0.0))
    return df.where((F.abs(along(u)) <= width / 2) & (F.abs(along(v)) <= height / 2))


def beside_surface(points: DataFrame, face_points: DataFrame, side: int = 1) -> DataFrame:
    """Points on one side of the nearest face of a surface given by centres and normals (face_id, x, y, z, nx, ny, nz) (F12):
    the sign of (p - c) . n. Approximate near edges."""
    from tessella.operators import nearest

    near = nearest.knn(points.select("point_id", "x", "y", "z"), face_points.select(F.col("face_id").alias("source_id"), "x", "y", "z"), 1)
    n = face_points.select(F.col("face_id").alias("source_id"), *(F.col(c).alias("_" + c) for c in ("x", "y", "z", "nx", "ny", "nz")))
    joined = points.join(near.select("point_id", "source_id"), "point_id").join(n, "source_id")
    dot = sum(((F.col(c) - F.col("_" + c)) * F.col("_n" + c) for c in "xyz"), F.lit(0.0))
    return joined.where(dot * side > 0).select(*points.columns)


def in_any_box(points: DataFrame, boxes: list[tuple[float, float, float, float, float, float]]) -> DataFrame:
    """Points in at least one of the boxes (x0, y0, z0, x1, y1, z1); no boxes keep all."""
    if not boxes:
        return points
    one = lambda b: reduce(Column.__and__, (F.col(c).between(F.lit(float(min(b[k], b[k + 3]))), F.lit(float(max(b[k], b[k + 3])))) for k, c in enumerate("xyz")))
    return points.where(reduce(Column.__or__, map(one, boxes)))


def id_ranges(text: str) -> list[tuple[int, int]]:
    """Ranges of a list such as 1-5,9;11; what isn't a number or range is left out."""
    out = []
    for token in re.split(r"[,;\s]+", text.strip()):
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", token)
        if m:
            lo, hi = int(m[1]), int(m[2] or m[1])
            out.append((min(lo, hi), max(lo, hi)))
    return out


def by_ids(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose id is in a list of ranges; an empty list keeps all."""
    ranges = id_ranges(text)
    return df.where(reduce(Column.__or__, (F.col(column).between(a, b) for a, b in ranges))) if ranges else df


def by_size(df: DataFrame, sizes: list[int], vector=("vx", "vy", "vz")) -> DataFrame:
    """Particles whose speed, rounded half to even, is in the list."""
    from tessella.functions.expr import magnitude

    return df.where(F.bround(magnitude(*vector), 0).cast("long").isin(sizes)) if sizes else df


def particle_scalar(df: DataFrame, name: str | None = None) -> Column:
    """A particle's scalar: the magnitude of a named vector, its x component for a base name and -, else the speed (F16)."""
    from tessella.functions.expr import magnitude

    if name and all(f"{name}_{c}" in df.columns for c in "xyz"):
        return magnitude(*(f"{name}_{c}" for c in "xyz"))
    if name and f"{name}_x" in df.columns:
        return F.col(f"{name}_x")
    return magnitude("vx", "vy", "vz")


def near_radius(df: DataFrame, radius: float, tolerance: float, axis: str = "z") -> DataFrame:
    """(..., arc, height) of the points whose radius is within tolerance of one (F17); arc is r theta."""
    from tessella.functions.expr import cylindrical

    r, theta, h = cylindrical("x", "y", "z", axis)
    return df.where(F.abs(r - F.lit(float(radius))) < tolerance).withColumns({"arc": r * theta, "height": h})


def every_nth(cells: DataFrame, n: int) -> DataFrame:
    """Every n-th cell by id, all of fewer than 8."""
    if n <= 1 or cells.limit(8).count() < 8:
        return cells
    return cells.where(F.col("cell_id") % n == 0)


def in_disk(df: DataFrame, centre, radius: float, normal: str = "z") -> DataFrame:
    """Points within radius of the centre in the plane across an axis."""
    at = dict(zip("xyz", centre, strict=True))
    return df.where(sum(((F.col(c) - F.lit(float(at[c]))) * (F.col(c) - F.lit(float(at[c]))) for c in "xyz" if c != normal), F.lit(0.0)) <= radius**2)


def split_by_material(faces: DataFrame, cells: DataFrame, name: str = "name") -> DataFrame:
    """Faces with their region's name followed by the owner's material, as in wall(MAT2)."""
    return faces.join(cells.select(F.col("cell_id").alias("owner"), "material"), "owner").withColumn(name, F.concat(name, F.lit("(MAT"), F.col("material").cast("string"), F.lit(")")))


def frame_of_step(particles: DataFrame, step: int, variables: DataFrame | None = None) -> DataFrame:
    """Particles of frame step mod frames (frames counted from the first, F23); variables (frame, particle_id, value) that
    have fewer frames give their last."""
    frames = [r[0] for r in particles.select("frame").distinct().orderBy("frame").collect()]  # frame numbers
    if not frames:
        return particles
    out = particles.where(F.col("frame") == frames[step % len(frames)])
    if variables is None:
        return out
    there = [r[0] for r in variables.select("frame").distinct().orderBy("frame").collect()]
    if not there:
        return out.withColumn("value", F.lit(None).cast("double"))
    chosen = there[min(step % len(frames), len(there) - 1)]
    return out.join(variables.where(F.col("frame") == chosen).drop("frame"), "particle_id", "left")


def keywords(names: DataFrame, words: list[str], without: list[str] = (), name: str = "name") -> DataFrame:
    """Names that hold one of the words and none of the others, case aside (H5)."""
    any_of = lambda ws: reduce(Column.__or__, (F.lower(name).contains(w.lower()) for w in ws), F.lit(False))
    return names.where(any_of(words) & ~any_of(without))
