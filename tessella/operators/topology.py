"""Mesh topology and look-ups: cells, faces, edges, nodes, regions, materials, areas, volumes and centres.

Tables: node (node_id, x, y, z), cell (cell_id, cell_type, nodes, material, cvol_id), face (face_id, owner, neighbour,
nodes), part (part_name, cvol_id), surface_region (name, face_id), volume_region (volid, name). Cell types: 10 tetrahedron,
12 hexahedron, 13 wedge, 14 pyramid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans import prefix
from tessella.plans.joins import dealt

#: Corners of the edges and faces of each cell type.
EDGES = {
    10: [(0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3)],
    12: [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)],
    13: [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)],
    14: [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 4), (2, 4), (3, 4)],
}
FACES = {
    12: [(0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)],
    10: [(0, 1, 2), (0, 3, 1), (1, 3, 2), (2, 3, 0)],
    13: [(0, 1, 2), (3, 4, 5), (0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5)],
    14: [(0, 1, 2, 3), (0, 3, 4), (3, 2, 4), (2, 1, 4), (1, 0, 4)],
}
#: Nodes of each cell type; element family and node count of cell types for classification.
CORNERS = {10: 4, 12: 8, 13: 6, 14: 5}


def _template(shapes: dict[int, list[tuple[int, ...]]]) -> Column:
    pick = lambda c: F.array(*(F.get(F.col("nodes"), i) for i in c))
    out = F.array().cast("array<array<long>>")
    for kind, corners in shapes.items():
        out = F.when(F.col("cell_type") == kind, F.array(*map(pick, corners))).otherwise(out)
    return out


def cell_edges(cells: DataFrame) -> DataFrame:
    """(cell_id, a, b): edges of each cell, a < b (G1)."""
    e = cells.select("cell_id", F.explode(_template(EDGES)).alias("e"))
    return e.select("cell_id", F.array_min("e").alias("a"), F.array_max("e").alias("b"))


def edges(cells: DataFrame) -> DataFrame:
    """(a, b): edges of the mesh, once each, a < b."""
    return cell_edges(cells).select("a", "b").distinct()


def cell_faces(cells: DataFrame) -> DataFrame:
    """(cell_id, local, nodes): local faces of each cell."""
    return cells.select("cell_id", F.posexplode(_template(FACES)).alias("local", "nodes"))


def cell_nodes(cells: DataFrame) -> DataFrame:
    """(cell_id, place, node_id)."""
    return cells.select("cell_id", F.posexplode("nodes").alias("place", "node_id"))


def face_nodes(faces: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(face_id, place, node_id), with x, y, z if nodes are given."""
    out = faces.select("face_id", F.posexplode("nodes").alias("place", "node_id"))
    return out if nodes is None else out.join(dealt(nodes.select("node_id", "x", "y", "z")), "node_id")


def faces_of_cells(faces: DataFrame, owner_only: bool = False) -> DataFrame:
    """(cell_id, face_id): faces of polyhedral cells, of the owner and the neighbour."""
    own = faces.select(F.col("owner").alias("cell_id"), "face_id")
    return own if owner_only else own.unionByName(faces.where("neighbour >= 0").select(F.col("neighbour").alias("cell_id"), "face_id"))


def polyhedron_nodes(faces: DataFrame) -> DataFrame:
    """(cell_id, node_id): distinct nodes of polyhedral cells, from their faces."""
    both = F.when(F.col("neighbour") >= 0, F.array("owner", "neighbour")).otherwise(F.array("owner"))
    rings = faces.where("face_id is not null").select(F.explode(both).alias("cell_id"), "nodes").repartition("cell_id")
    return rings.select("cell_id", F.explode("nodes").alias("node_id")).distinct()


def adjacent_cells(faces: DataFrame) -> DataFrame:
    """(cell_id, other): pairs of cells that share a face, both ways."""
    inner = faces.where("neighbour >= 0")
    return inner.select(F.col("owner").alias("cell_id"), F.col("neighbour").alias("other")).unionByName(inner.select(F.col("neighbour").alias("cell_id"), F.col("owner").alias("other"))).distinct()


def across_face(queries: DataFrame, faces: DataFrame) -> DataFrame:
    """queries (cell_id, face_id) with the cell on the other side, -1 if there is none."""
    f = faces.select("face_id", "owner", "neighbour")
    other = F.when(F.col("owner") == F.col("cell_id"), F.col("neighbour")).when(F.col("neighbour") == F.col("cell_id"), F.col("owner"))
    return queries.join(dealt(f), "face_id").select("cell_id", "face_id", F.coalesce(other, F.lit(-1).cast("long")).alias("other"))


def local_faces(faces: DataFrame) -> DataFrame:
    """(cell_id, local, face_id): 0-based numbers of a polyhedral cell's faces, in order of face id."""
    w = Window.partitionBy("cell_id").orderBy("face_id")
    return faces_of_cells(faces).withColumn("local", (F.row_number().over(w) - 1).cast("int")).select("cell_id", "local", "face_id")


def across_local_face(queries: DataFrame, faces: DataFrame) -> DataFrame:
    """queries (cell_id, local) with face_id and the cell on the other side of the local face, -1 if there is none or no such face
    (J6)."""
    own = F.struct(F.col("owner").alias("cell_id"), F.col("neighbour").alias("other"))
    beside = F.struct(F.col("neighbour").alias("cell_id"), F.col("owner").alias("other"))
    sides = faces.where("face_id is not null").select("face_id", F.explode(F.when(F.col("neighbour") >= 0, F.array(own, beside)).otherwise(F.array(own))).alias("s")).select("face_id", "s.cell_id", "s.other")
    place = F.row_number().over(Window.partitionBy("cell_id").orderBy("face_id")) - 1
    known = sides.withColumn("local", place.cast("int"))
    return queries.join(dealt(known), ["cell_id", "local"], "left").select("cell_id", "local", "face_id", F.coalesce("other", F.lit(-1).cast("long")).alias("other"))


def across_cell_faces(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """queries (cell_id, local) with the cell across a local face of cells of the four types, found by the face's nodes; -1 if none
    (J6)."""
    # of the cells of a face's nodes the lowest, or the next one for the lowest itself
    same = Window.partitionBy("key")
    f = cell_faces(cells).select("cell_id", "local", F.array_sort("nodes").alias("key")).withColumn("low", F.min("cell_id").over(same))
    f = f.withColumn("next", F.min(F.when(F.col("cell_id") > F.col("low"), F.col("cell_id"))).over(same))
    other = f.select("cell_id", "local", F.when(F.col("cell_id") > F.col("low"), F.col("low")).otherwise(F.col("next")).alias("other"))
    other = other.where("other is not null").repartition("cell_id", "local").groupBy("cell_id", "local").agg(F.min("other").alias("other"))
    return queries.join(dealt(other), ["cell_id", "local"], "left").select("cell_id", "local", F.coalesce("other", F.lit(-1).cast("long")).alias("other"))


def node_neighbours(cells: DataFrame) -> DataFrame:
    """(node_id, other): nodes joined by a cell edge, both ways."""
    e = edges(cells)
    return e.select(F.col("a").alias("node_id"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("node_id"), F.col("a").alias("other")))


def exterior_faces(cells: DataFrame) -> DataFrame:
    """(cell_id, local, nodes): local faces whose node set no other cell has."""
    # dealt out by node set before they are counted, as before that hardly two faces of a set meet; of a set's only face the least
    # value is its own, and numbers, unlike arrays, are counted without a sort
    f = cell_faces(cells).withColumn("key", F.array_sort("nodes")).repartition("key")
    once = f.groupBy("key").agg(F.count("*").alias("n"), F.min("cell_id").alias("cell_id"), F.min("local").alias("local"), *(F.min(F.get("nodes", F.lit(k))).alias(f"n{k}") for k in range(4)))
    return once.where("n = 1").select("cell_id", "local", F.slice(F.array(*(f"n{k}" for k in range(4))), F.lit(1), F.size("key")).alias("nodes"))


def wall_nodes(faces: DataFrame, regions: DataFrame, names: list[str]) -> DataFrame:
    """(node_id): nodes of the named surface regions, or of all if none is named."""
    chosen = regions.where(F.col("name").isin(names)) if names else regions
    return faces.join(dealt(chosen.select("face_id").distinct()), "face_id", "left_semi").select(F.explode("nodes").alias("node_id")).distinct()


def nodes_of_cells(cells: DataFrame) -> DataFrame:
    """(node_id): distinct nodes of cells, such as those of a volume region."""
    return cells.select(F.explode("nodes").alias("node_id")).distinct()


def blade_boundary(faces: DataFrame, cells: DataFrame) -> DataFrame:
    """Faces whose owner is among cells and whose neighbour isn't, or is absent (U4)."""
    ids = cells.select(F.col("cell_id").alias("owner")).distinct()
    inside = cells.select(F.col("cell_id").alias("neighbour")).distinct()
    return faces.join(dealt(ids), "owner", "left_semi").join(dealt(inside), "neighbour", "left_anti")


# ---------------------------------------------------------------- geometry


def triangles(polygons: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """Fan triangles of polygons (key, nodes) with corner coordinates x0 .. z2 (G7); n nodes give n - 2."""
    fan = F.transform(F.sequence(F.lit(1), F.size("nodes") - 2), lambda i: F.struct(i.alias("i"), F.get(F.col("nodes"), F.lit(0)).alias("a"), F.get(F.col("nodes"), i).alias("b"), F.get(F.col("nodes"), i + 1).alias("c")))
    out = polygons.where(F.size("nodes") >= 3).select(key, F.explode(fan).alias("t")).select(key, "t.i", "t.a", "t.b", "t.c")
    for k, c in enumerate("abc"):
        out = out.join(dealt(nodes.select(F.col("node_id").alias(c), *(F.col(d).alias(f"{d}{k}") for d in "xyz"))), c)
    return out


def _cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def face_geometry(faces: DataFrame, nodes: DataFrame) -> DataFrame:
    """(face_id, cx, cy, cz, nx, ny, nz, area): mean of the corners, and Newell's normal and area."""
    ring = face_nodes(faces, nodes).repartition("face_id").groupBy("face_id").agg(F.array_sort(F.collect_list(F.struct("place", "x", "y", "z"))).alias("p"))
    turned = F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1))
    terms = F.zip_with("p", turned, lambda a, b: F.struct(*(c.alias(n) for c, n in zip(_cross((a["x"], a["y"], a["z"]), (b["x"], b["y"], b["z"])), "xyz", strict=True))))
    total = lambda arr, c: F.aggregate(arr, F.lit(0.0), lambda s, e: s + e[c])
    out = ring.withColumn("c", terms).select("face_id", *((total(F.col("p"), d) / F.size("p")).alias("c" + d) for d in "xyz"), *((total(F.col("c"), d) / 2).alias("n" + d) for d in "xyz"))
    out = out.withColumn("area", F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")))
    return out.withColumns({f"n{d}": F.col(f"n{d}") / F.when(F.col("area") > 1e-12, F.col("area")).otherwise(F.lit(1.0)) for d in "xyz"})


def outward_faces(faces: DataFrame, nodes: DataFrame, centres: DataFrame) -> DataFrame:
    """face_geometry with unit normals that point away from the owner's centre."""
    g = face_geometry(faces, nodes).join(dealt(faces.select("face_id", "owner")), "face_id")
    c = centres.select(F.col("cell_id").alias("owner"), *(F.col(d).alias("o" + d) for d in "xyz"))
    g = g.join(dealt(c), "owner")
    inward = sum(((F.col("c" + d) - F.col("o" + d)) * F.col("n" + d) for d in "xyz"), F.lit(0.0)) < 0
    return g.withColumns({f"n{d}": F.when(inward, -F.col(f"n{d}")).otherwise(F.col(f"n{d}")) for d in "xyz"}).drop("ox", "oy", "oz")


def cell_centres(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cell_id, x, y, z): given centres (cx, cy, cz) where there are, else the mean of the cell's nodes."""
    mean = cell_nodes(cells).join(dealt(nodes.select("node_id", "x", "y", "z")), "node_id").repartition("cell_id").groupBy("cell_id").agg(*(F.avg(c).alias(c) for c in "xyz"))
    if "cx" not in cells.columns:
        return mean
    given = cells.select("cell_id", "cx", "cy", "cz")
    return mean.join(dealt(given), "cell_id").select("cell_id", *(F.coalesce("c" + c, c).alias(c) for c in "xyz"))


def polyhedron_centres(faces: DataFrame, nodes: DataFrame, owner_only: bool = False) -> DataFrame:
    """(cell_id, x, y, z): mean over the nodes of a cell's faces, repeated nodes counted again."""
    return faces_of_cells(faces, owner_only).join(dealt(face_nodes(faces, nodes)), "face_id").repartition("cell_id").groupBy("cell_id").agg(*(F.avg(c).alias(c) for c in "xyz"))


def cell_volumes(cells: DataFrame, nodes: DataFrame, polyhedra: DataFrame | None = None) -> DataFrame:
    """(cell_id, volume): pyramids from the cell's mean point over fan triangles of its faces.

    polyhedra: faces of polyhedral cells, used instead of the cell types' templates."""
    at = nodes.select("node_id", "x", "y", "z")
    if polyhedra is None:
        # nodes and cells join once; a corner that isn't among the nodes is NULL, and so are its triangles
        c = cells.select("cell_id", "cell_type", F.posexplode("nodes").alias("place", "node_id")).join(dealt(at), "node_id")
        corner = lambda k, d: F.max(F.when(F.col("place") == k, F.col(d))).alias(f"{d}{k}")
        c = c.repartition("cell_id", "cell_type").groupBy("cell_id", "cell_type").agg(*(F.avg(d).alias(d) for d in "xyz"), *(corner(k, d) for k in range(max(CORNERS.values())) for d in "xyz"))
        c = c.select("cell_id", "cell_type", *((F.col(f"{d}{k}") - F.col(d)).alias(f"{d}{k}") for k in range(max(CORNERS.values())) for d in "xyz"))
        volume = F.lit(None).cast("double")
        for kind, shapes in FACES.items():
            fans = [tuple(tuple(F.col(f"{d}{k}") for d in "xyz") for k in (s[0], s[i], s[i + 1])) for s in shapes for i in range(1, len(s) - 1)]
            terms = [F.abs(sum((x * y for x, y in zip(a, _cross(b, c_), strict=True)), F.lit(0.0))) for a, b, c_ in fans]
            whole = F.coalesce(*terms).isNotNull()
            volume = F.when((F.col("cell_type") == kind) & whole, sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0)) / 6).otherwise(volume)
        return c.select("cell_id", volume.alias("volume")).where("volume is not null")
    ring = face_nodes(polyhedra).join(dealt(at), "node_id", "left").repartition("face_id").groupBy("face_id").agg(F.array_sort(F.collect_list(F.struct("place", "node_id", "x", "y", "z"))).alias("p"))
    ring = faces_of_cells(polyhedra).join(dealt(ring.select("face_id", F.transform("p", lambda e: F.struct(*(e[c].alias(c) for c in ("node_id", "x", "y", "z")))).alias("p"))), "face_id")
    c = ring.repartition("cell_id").groupBy("cell_id").agg(F.collect_list("p").alias("rings"))
    corners = F.array_distinct(F.flatten("rings"))
    some = lambda d: F.filter(F.transform("corners", lambda e: e[d]), lambda v: v.isNotNull())
    c = c.withColumn("corners", corners).select("cell_id", F.filter("rings", lambda p: F.size(p) >= 3).alias("rings"), *((F.aggregate(some(d), F.lit(0.0), lambda s, v: s + v) / F.size(some(d))).alias(d) for d in "xyz"))
    fan = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 2), lambda i: F.struct(F.get(p, F.lit(0)).alias("a"), F.get(p, i).alias("b"), F.get(p, i + 1).alias("c")))
    t = c.select("cell_id", "x", "y", "z", F.explode(F.flatten(F.transform("rings", fan))).alias("t"))
    a, b, c = (tuple(F.col(f"t.{k}.{d}") - F.col(d) for d in "xyz") for k in "abc")
    cross = _cross(b, c)
    return t.groupBy("cell_id").agg((F.sum(F.abs(sum((x * y for x, y in zip(a, cross, strict=True)), F.lit(0.0)))) / 6).alias("volume")).where("volume is not null")


def bounding_box(nodes: DataFrame) -> DataFrame:
    """One row of least and greatest coordinates (A5)."""
    return nodes.agg(*(f(c).alias(c + n) for c in "xyz" for f, n in ((F.min, "0"), (F.max, "1"))))


def cell_to_node(cells: DataFrame, values: DataFrame, value: str = "value") -> DataFrame:
    """(node_id, value): mean over the cells around each node."""
    return cell_nodes(cells).join(dealt(values.select("cell_id", value)), "cell_id").groupBy("node_id").agg(F.avg(value).alias(value))


def onto_faces(faces: DataFrame, values: DataFrame, value: str = "value") -> DataFrame:
    """(face_id, value): the owner cell's value."""
    return faces.select("face_id", F.col("owner").alias("cell_id")).join(dealt(values.select("cell_id", value)), "cell_id").select("face_id", value)


# ---------------------------------------------------------------- values, regions, materials


def values_at(queries: DataFrame, table: DataFrame, key: str, names: list[str]) -> DataFrame:
    """queries with the named values of their ids (J1); unknown ids have NULL."""
    return queries.join(dealt(table.select(key, *names)), key, "left")


def scattered(points: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """Points (key, x, y, z) with a value at their own location, nodes or cells."""
    return points.select(key, "x", "y", "z").join(dealt(values.select(key, value)), key)


def regions_of_face(regions: DataFrame) -> DataFrame:
    """(face_id, names): sorted."""
    return regions.groupBy("face_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def region_table(regions: DataFrame, key: str) -> DataFrame:
    """(name, ids): sorted ids of each region (J18). For catalogs whose regions fit a row; else use regions itself."""
    return regions.groupBy("name").agg(F.array_sort(F.collect_set(key)).alias("ids"))


def region_ids(volume_regions: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (asked string: a 1-based id or a name) with volid and name, NULL if unknown."""
    r = F.broadcast(volume_regions.select(F.col("volid").alias("_v"), F.col("name").alias("_n")))
    hit = (F.col("asked") == F.col("_n")) | (F.expr("try_cast(asked AS long)") == F.col("_v"))
    return queries.join(r, hit, "left").select("asked", F.col("_v").alias("volid"), F.col("_n").alias("name"))


def materials(cells: DataFrame) -> DataFrame:
    """(material, place, name): distinct materials, their 0-based place and name MAT<n>."""
    m = cells.select("material").distinct()  # materials, not cells
    return m.select("material", (F.row_number().over(Window.orderBy("material")) - 1).alias("place"), F.concat(F.lit("MAT"), F.col("material").cast("string")).alias("name"))


def material_place(cells: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (material) with its place, -1 if unknown."""
    return queries.join(F.broadcast(materials(cells).select("material", "place")), "material", "left").withColumn("place", F.coalesce("place", F.lit(-1)))


def region_counts(regions: DataFrame) -> DataFrame:
    """(place, name, faces): surface regions in order of name with their face counts."""
    n = regions.groupBy("name").agg(F.countDistinct("face_id").alias("faces"))
    return n.withColumn("place", F.row_number().over(Window.orderBy("name")) - 1)


def cell_regions(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """(cell_id, material, cvol_id, names): material, volume id and names of the parts of each cell."""
    named = cells.select("cell_id", "cvol_id").join(parts.select("cvol_id", "part_name").distinct(), "cvol_id").groupBy("cell_id").agg(F.array_sort(F.collect_set("part_name")).alias("names"))
    return cells.select("cell_id", "material", "cvol_id").join(named, "cell_id", "left")


def material_of_region(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """(part_name, material, materials): the material, -1 if mixed, NULL if a part has no cells; how many."""
    j = parts.select("part_name", "cvol_id").distinct().join(cells.select("cvol_id", "material"), "cvol_id", "left")
    g = j.groupBy("part_name").agg(F.countDistinct("material").alias("materials"), F.min("material").alias("least"))
    return g.select("part_name", F.when(F.col("materials") == 1, F.col("least")).when(F.col("materials") > 1, F.lit(-1)).alias("material"), "materials")


def overlapping_regions(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """(overlapping): how many parts share a cell with another."""
    member = cells.select("cell_id", "cvol_id").join(parts.select("part_name", "cvol_id").distinct(), "cvol_id").select("cell_id", "part_name").distinct()
    many = member.groupBy("cell_id").agg(F.count("*").alias("n")).where("n > 1").select("cell_id")
    return member.join(many, "cell_id", "left_semi").agg(F.countDistinct("part_name").alias("overlapping"))


def counts(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: nodes, cells, nodes used by cells (A4)."""
    return nodes.agg(F.count("*").alias("nodes")).join(cells.agg(F.count("*").alias("cells"))).join(nodes_of_cells(cells).agg(F.count("*").alias("used")))


def value_range(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(count, lo, hi) of a variable, NaN left out (A1, A2, A3)."""
    v = F.when(~F.isnan(value), F.col(value))
    return (df.groupBy(*by) if by else df.groupBy()).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def data_range(df: DataFrame, value: str) -> DataFrame:
    """(lo, hi) for levels; equal ends move apart by 1 each."""
    r = value_range(df, value)
    same = F.col("lo") == F.col("hi")
    return r.select(F.when(same, F.col("lo") - 1).otherwise(F.col("lo")).alias("lo"), F.when(same, F.col("hi") + 1).otherwise(F.col("hi")).alias("hi"))


def clamp_nodes(cells: DataFrame, nodes: int) -> DataFrame:
    """Cells whose node ids beyond the last one are the last one (H4)."""
    return cells.withColumn("nodes", F.transform("nodes", lambda n: F.least(n, F.lit(nodes - 1).cast("long"))))


def slices(values: DataFrame, offsets: DataFrame) -> DataFrame:
    """(id, place, value): rows of a CSR structure: values (position, value) cut at offsets (id, start, stop) (H1).

    A slice's first position is marked and carried forward over chunks of positions, so neither table is gathered or
    broadcast. Slices that overlap are an error; positions in no slice are left out."""
    cut = offsets.where("stop > start").select("id", "start", "stop")
    marked = values.select("position", "value").join(cut.withColumnRenamed("start", "position").select("position", F.struct("id", F.col("position").alias("start"), "stop").alias("_cut")), "position", "left")
    out = prefix.carried(marked.withColumn("_all", F.lit(0)), "_cut", "_in", ["_all"], "position")
    # where a slice begins, how far the ones before reach: their marks stand just after their starts
    marks = cut.select(F.lit(0).alias("_all"), (F.col("start") * 2 + 1).alias("at"), F.col("stop").alias("_stop"))
    reach = prefix.carried(cut.select(F.lit(0).alias("_all"), (F.col("start") * 2).alias("at"), F.lit(None).cast("long").alias("_stop")).unionByName(marks), "_stop", "_upto", ["_all"], "at")
    clash = reach.where("at % 2 = 0 and _upto > at / 2")
    if not clash.isEmpty() or cut.count() != cut.select("start").distinct().count():
        raise ValueError("slices overlap")
    return out.where("_in is not null and position < _in.stop").select("_in.id", (F.col("position") - F.col("_in.start")).cast("int").alias("place"), "value")


def grouped_faces(pairs: DataFrame, cells: int) -> tuple[DataFrame, DataFrame]:
    """The CSR structure of faces by cell (H2): values (position, face_id) in order of cell and then of place, and offsets (cell_id, start,
    stop) of the cells that have any, for pairs (cell_id, face_id, place); ids outside 0 .. cells - 1 are left out.

    Positions are ranks in a range-partitioned order plus the counts of the partitions before."""
    ranked = dense_index(pairs.where((F.col("cell_id") >= 0) & (F.col("cell_id") < cells)).select("cell_id", "place", "face_id"), ["cell_id", "place", "face_id"], "position")
    offsets = ranked.groupBy("cell_id").agg(F.min("position").alias("start"), (F.max("position") + 1).alias("stop"))
    return ranked.select("position", "face_id"), offsets


def structured_cells(spark, ni: int, nj: int, nk: int) -> DataFrame:
    """(cell_id, cell_type, nodes) of a lattice of ni x nj x nk nodes, node (k nj + j) ni + i."""
    c = spark.range((ni - 1) * (nj - 1) * (nk - 1)).select(F.col("id").alias("cell_id"))
    i, j, k = F.col("cell_id") % (ni - 1), F.floor(F.col("cell_id") / (ni - 1)) % (nj - 1), F.floor(F.col("cell_id") / ((ni - 1) * (nj - 1)))
    at = lambda a, b, d: ((k + d) * nj + j + b) * ni + i + a
    ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
    return c.select("cell_id", F.lit(12).alias("cell_type"), F.array(*(at(a, b, d).cast("long") for d in (0, 1) for a, b in ring)).alias("nodes"))


def classify(elements: DataFrame) -> DataFrame:
    """elements (cell_id, family, dimension, nodes) with cell_type and only the corner nodes.

    3-D: by family name, else by node count 4/10, 5/13, 6/15, 8/20; 2-D: 5 triangle or 9 quadrilateral."""
    n = F.size("nodes")
    family = F.lower(F.coalesce("family", F.lit("")))
    kind = F.when(family == "tet", 10).when(family == "hex", 12).when(family == "wedge", 13).when(family == "pyramid", 14).when(family == "tri", 5).when(family == "quad", 9)
    kind = kind.when((F.col("dimension") == 3) & n.isin(4, 10), 10).when((F.col("dimension") == 3) & n.isin(5, 13), 14).when((F.col("dimension") == 3) & n.isin(6, 15), 13).when((F.col("dimension") == 3) & n.isin(8, 20), 12)
    kind = kind.when((F.col("dimension") == 2) & n.isin(3, 6), 5).when((F.col("dimension") == 2) & n.isin(4, 8), 9)
    out = elements.withColumn("cell_type", kind).where("cell_type is not null")
    many = F.when(F.col("cell_type") == 5, 3).when(F.col("cell_type") == 9, 4)
    for t, k in CORNERS.items():
        many = many.when(F.col("cell_type") == t, k)
    return out.withColumn("nodes", F.slice("nodes", F.lit(1), many)).where(F.size("nodes") == many)


def dense_index(df: DataFrame, order: list[str], name: str = "dense_id") -> DataFrame:
    """df with 0-based dense numbers in an order (S7, H3): a range-partitioned sort, counts of its partitions, and a number
    within each; no row goes to a single task but the counts."""
    from tessella.plans.scratch import keep

    ranged = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "dense")
    n = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    base = n.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_base")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + place - 1).drop("_part", "_base")


def first_use(cells: DataFrame) -> DataFrame:
    """(node_id, dense_id): nodes numbered by first use in cells in order of id (H3)."""
    used = cell_nodes(cells).groupBy("node_id").agg(F.min(F.struct("cell_id", "place")).alias("f")).select("node_id", "f.cell_id", "f.place")
    return dense_index(used, ["cell_id", "place"]).select("node_id", "dense_id")


def renumbered(cells: DataFrame, numbers: DataFrame) -> DataFrame:
    """Cells with their nodes' new numbers; cells with a node that has none go."""
    j = cell_nodes(cells).join(dealt(numbers.select("node_id", "dense_id")), "node_id", "left").repartition("cell_id")
    g = j.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("place", "dense_id"))).alias("p"), F.bool_and(F.col("dense_id").isNotNull()).alias("whole"))
    return cells.drop("nodes").join(dealt(g.where("whole").select("cell_id", F.transform("p", lambda x: x["dense_id"]).alias("nodes"))), "cell_id")


def trim_to_box(nodes: DataFrame, cells: DataFrame, x=(None, None), y=(None, None), z=(None, None)) -> tuple[DataFrame, DataFrame]:
    """Nodes in a box, densely renumbered, and the cells all of whose nodes are in it.

    An inverted box or one that holds no node is an error."""
    from tessella.operators.filters import in_box

    for lo, hi in (x, y, z):
        if lo is not None and hi is not None and lo > hi:
            raise ValueError("the box is inverted")
    kept = dense_index(in_box(nodes, x, y, z), ["node_id"])
    if kept.isEmpty():
        raise ValueError("no node is in the box")
    return kept, renumbered(cells, kept)


def check_mesh(nodes: DataFrame, cells: DataFrame) -> None:
    """Raises ValueError for no cells, an unknown cell type, wrong node counts or ids that aren't nodes."""
    want = F.lit(None).cast("int")
    for t, k in CORNERS.items():
        want = F.when(F.col("cell_type") == t, k).otherwise(want)
    n = cells.agg(F.count("*").alias("n"), F.count_if(want.isNull()).alias("odd"), F.count_if(F.size("nodes") != want).alias("short")).first()
    if not n["n"]:
        raise ValueError("no connectivity")
    if n["odd"]:
        raise ValueError(f"{n['odd']} cells of an unsupported type")
    if n["short"]:
        raise ValueError(f"{n['short']} cells whose node count isn't that of their type")
    if not nodes_of_cells(cells).join(nodes, "node_id", "left_anti").isEmpty():
        raise ValueError("node ids out of range")
