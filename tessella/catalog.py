"""Registered queries over the given tables, with their SQL. A query's name begins with the ids of the operators it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import expr
from tessella.operators import bins, blades, calculus, compare, cycles, filters, modal, nearest, slices, topology, trace
from tessella.plans import scratch, views
from tessella.plans.joins import dealt
from tessella.plans.views import table
from tessella.sources import datasets, ingest
from tessella.streaming import monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, *names: str, extra: str = "", recursive: bool = False):
    """Registers a function (spark, sf_dir); oracle: SQL over the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = views.sql(oracle, *names, extra=extra, recursive=recursive)
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    """Six decimals, and 0.0 for -0.0: sums in another order differ further down."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return out.alias(name or c) if name or isinstance(c, str) else out


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    """df with its doubles rounded."""
    return df.select(*(r6(f.name) if f.dataType.typeName() == "double" and f.name not in keys else F.col(f.name) for f in df.schema.fields))


def sql_bin(x: str, lo: str, hi: str, n: int) -> str:
    return f"CAST(CASE WHEN {hi} > {lo} THEN least({n} - 1, greatest(0, floor(({x} - {lo}) / ({hi} - {lo}) * {n}))) ELSE {n} - 1 END AS INTEGER)"


def parts_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lat_cell").select("part_name", "cvol_id").distinct()


def regions_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lat_face").where("region is not null").select(F.col("region").alias("name"), "face_id")


# ---------------------------------------------------------------- bins (flagship first)

_BIN2 = """
b AS (SELECT {x} AS ba, {y} AS bb, {v} AS v, {w} AS w FROM {source}),
m AS (SELECT min(ba) AS x0, max(ba) AS x1, min(bb) AS y0, max(bb) AS y1 FROM b),
g AS (SELECT {xbin} AS xbin, {ybin} AS ybin, count(*) AS n, sum(v * w) AS s, sum(w) AS sw, avg(v) AS a FROM b, m GROUP BY 1, 2),
grid AS (SELECT CAST(x.range AS INTEGER) AS xbin, CAST(y.range AS INTEGER) AS ybin FROM range({nx}) x, range({ny}) y)"""
_BIN2_OUT = "SELECT grid.xbin, grid.ybin, coalesce(n, 0) AS n, coalesce(round(CASE WHEN abs(sw) < 1e-12 THEN a ELSE s / sw END, 6) + 0.0, 'NaN'::DOUBLE) AS value FROM grid LEFT JOIN g ON grid.xbin = g.xbin AND grid.ybin = g.ybin"


def bin2(x: str, y: str, v: str, nx: int, ny: int, w: str = "1.0::DOUBLE", source: str = "cloud") -> str:
    return _BIN2.format(x=x, y=y, v=v, w=w, nx=nx, ny=ny, source=source, xbin=sql_bin("ba", "x0", "x1", nx), ybin=sql_bin("bb", "y0", "y1", ny))


@query(_BIN2_OUT, "cloud", extra=bin2("sqrt(x * x + y * y)", "z", "pres", 12, 9))
def a17_circumferential_average(spark, sf):
    return rounded(bins.circumferential_average(table(spark, sf, "cloud"), "pres", 12, 9))


@query(_BIN2_OUT, "cloud", extra=bin2("sqrt(x * x + y * y)", "z", "pres", 12, 9, "density * sqrt(velx * velx + vely * vely + velz * velz)"))
def a18_circumferential_mass_average(spark, sf):
    return rounded(bins.circumferential_average(table(spark, sf, "cloud"), "pres", 12, 9, weight=bins.mass_weight("density")))


@query("SELECT round(CASE WHEN abs(sum(density * abs(velz))) < 1e-12 THEN avg(pres) ELSE sum(density * abs(velz) * pres) / sum(density * abs(velz)) END, 6) + 0.0 AS average FROM cloud", "cloud")
def a19_mass_flow_average(spark, sf):
    return rounded(bins.mass_flow_average(table(spark, sf, "cloud"), "pres", "density", "velz"))


@query(f"""SELECT grid.bin, round(lo + (grid.bin + 0.5) * (hi - lo) / 10, 6) + 0.0 AS centre, coalesce(round(v, 6) + 0.0, 'NaN'::DOUBLE) AS value
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) grid, e LEFT JOIN (SELECT {sql_bin('z', 'lo', 'hi', 10)} AS bin, avg(pres) AS v FROM cloud, e GROUP BY 1) g ON g.bin = grid.bin""", "cloud", extra="e AS (SELECT min(z) AS lo, max(z) AS hi FROM cloud)")
def a15_profile(spark, sf):
    return rounded(bins.profile(table(spark, sf, "cloud"), "z", "pres", 10))


@query(_BIN2_OUT, "cloud", extra=bin2("x", "y", "pres", 8, 8))
def a16_binned_mean(spark, sf):
    return rounded(bins.binned(table(spark, sf, "cloud"), "x", "y", "pres", 8, 8))


@query(_BIN2_OUT, "cloud", extra=bin2("sqrt(x * x + y * y)", "atan2(y, x)", "pres", 6, 9))
def a20_polar_map(spark, sf):
    return rounded(bins.polar_map(table(spark, sf, "cloud"), "pres", 6, 9))


@query(_BIN2_OUT, "cloud", extra=bin2("sqrt(x * x + y * y) * atan2(y, x)", "z", "pres", 6, 4, source="(SELECT * FROM cloud WHERE abs(sqrt(x * x + y * y) - 10) < 2)"))
def f17_a20_blade_to_blade_map(spark, sf):
    return rounded(bins.blade_to_blade_map(table(spark, sf, "cloud"), "pres", 10.0, 2.0, 6, 4))


# ---------------------------------------------------------------- expressions


@query("""SELECT node_id, round(pres + temp * 2 - velx, 6) + 0.0 AS e2, CASE WHEN velx = 0 THEN CASE WHEN temp > 0 THEN 'Infinity'::DOUBLE WHEN temp < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END ELSE round(temp / velx, 6) + 0.0 END AS e3,
round(pow(temp, 2), 6) + 0.0 AS e4, CASE WHEN velx <> 0 AND vely <> 0 THEN 1.0::DOUBLE ELSE 0.0 END AS e5_and, CASE WHEN velx <> 0 OR z <> 0 THEN 1.0::DOUBLE ELSE 0.0 END AS e5_or, abs(velx) + 0.0 AS e6,
CASE WHEN velx < 0 THEN 'NaN'::DOUBLE ELSE round(sqrt(CASE WHEN velx < 0 THEN 0 ELSE velx END), 6) + 0.0 END AS e7, least(x, y) + 0.0 AS e8_min, greatest(x, y) + 0.0 AS e8_max, round(sqrt(velx * velx + vely * vely + velz * velz), 6) + 0.0 AS e9,
CASE WHEN x > y THEN 1.0::DOUBLE ELSE 0.0 END AS e10_gt, CASE WHEN x >= y THEN 1.0::DOUBLE ELSE 0.0 END AS e10_ge, CASE WHEN x = y THEN 1.0::DOUBLE ELSE 0.0 END AS e10_eq, CASE WHEN x <> y THEN 1.0::DOUBLE ELSE 0.0 END AS e10_ne, CASE WHEN x < y THEN 1.0::DOUBLE ELSE 0.0 END AS e10_lt, CASE WHEN x <= y THEN 1.0::DOUBLE ELSE 0.0 END AS e10_le,
CASE WHEN x = 0 THEN '-Infinity'::DOUBLE ELSE round(ln(CASE WHEN x = 0 THEN 1 ELSE x END), 6) + 0.0 END AS e11_log, round(exp(-x), 6) + 0.0 AS e11_exp, round(sin(x), 6) + 0.0 AS e11_sin,
round((pres - 1000) / 50.0, 6) + 0.0 AS e16 FROM lat_node""", "lat_node")
def e1_e16_expressions(spark, sf):
    n = table(spark, sf, "lat_node")
    c = F.col
    out = expr.add_variable(n, "e2", c("pres") + c("temp") * 2 - c("velx"))
    for name, value in {"e3": expr.div("temp", "velx"), "e4": expr.power("temp", 2), "e5_and": expr.both("velx", "vely"), "e5_or": expr.either("velx", "z"), "e6": F.abs("velx"), "e7": expr.sqrt("velx"), "e8_min": expr.least("x", "y"), "e8_max": expr.greatest("x", "y"), "e9": expr.magnitude("velx", "vely", "velz"), **{f"e10_{o}": expr.compare("x", o, "y") for o in ("gt", "ge", "eq", "ne", "lt", "le")}, "e11_log": expr.log("x"), "e11_exp": F.exp(-c("x")), "e11_sin": F.sin("x"), "e16": expr.pressure_coefficient("pres", 1000.0, 10.0, 1.0)}.items():
        out = expr.add_variable(out, name, value)
    return rounded(out.select("node_id", *(x for x in out.columns if x.startswith("e") and x[1].isdigit())))


@query("""SELECT node_id, round(sqrt(0.5 * ((x - y) * (x - y) + (y - z) * (y - z) + (z - x) * (z - x)) + 3.0 * (velx * velx + vely * vely + velz * velz)), 6) + 0.0 AS von_mises,
round(sqrt(x * x + y * y), 6) + 0.0 AS r, round(atan2(y, x), 6) + 0.0 AS theta, round(sqrt((x - 1) * (x - 1) + (y - 2) * (y - 2) + (z - 3) * (z - 3)), 6) + 0.0 AS distance,
round(1 - y, 6) + 0.0 AS gx, round(2 + x, 6) + 0.0 AS gy, round(3 + z, 6) + 0.0 AS gz FROM lat_node""", "lat_node")
def e17_e20_e21_e23_geometry(spark, sf):
    n = table(spark, sf, "lat_node")
    r, theta, _ = expr.cylindrical("x", "y", "z")
    g = expr.to_global("x", "y", "z", expr.rotation((0, 0, 1), 90.0), (1.0, 2.0, 3.0))
    at = tuple(F.lit(float(v)) for v in (1, 2, 3))
    return rounded(n.select("node_id", expr.von_mises("x", "y", "z", "velx", "vely", "velz").alias("von_mises"), r.alias("r"), theta.alias("theta"), expr.distance(("x", "y", "z"), at).alias("distance"), *(c.alias(a) for c, a in zip(g, ("gx", "gy", "gz"), strict=True))))


@query("SELECT node_id, 0 AS copy, x + 0.0 AS x, y, z FROM lat_node UNION ALL SELECT node_id, 1, -x + 0.0, y, z FROM lat_node", "lat_node")
def e25_mirror(spark, sf):
    m = expr.mirrored(table(spark, sf, "lat_node"), "yz")
    return m.select("node_id", "copy", (F.col("x") + 0.0).alias("x"), "y", "z")


@query("""SELECT node_id, c.copy, round(cos(radians(90.0 * c.copy)) * x - sin(radians(90.0 * c.copy)) * y, 6) + 0.0 AS x, round(sin(radians(90.0 * c.copy)) * x + cos(radians(90.0 * c.copy)) * y, 6) + 0.0 AS y
FROM lat_node, (SELECT 1 AS copy UNION ALL SELECT 2 UNION ALL SELECT 3) c""", "lat_node")
def e25_periodic(spark, sf):
    return rounded(expr.periodic(table(spark, sf, "lat_node"), 4).select("node_id", "copy", "x", "y"))


@query("SELECT p_partkey AS node_id, p_size AS code, CASE WHEN p_size BETWEEN 1 AND 6 THEN 'stress_' || p_size WHEN p_size BETWEEN 11 AND 16 THEN 'strain_' || (p_size - 10) WHEN p_size = 20 THEN 'temperature' ELSE 'CODE' || p_size END AS name FROM part")
def e19_code_names(spark, sf):
    names = spark.createDataFrame([(1, "stress", 6), (11, "strain", 6), (20, "temperature", 1)], "base int, name string, width int")
    return expr.code_names(table(spark, sf, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("code")), names).select("node_id", "code", "name")


@query("""SELECT node_id, CASE WHEN label LIKE 'l%' THEN replace(label, ' ', '_') WHEN code BETWEEN 1 AND 6 THEN 'Strain_' || ['XX', 'YY', 'ZZ', 'XY', 'YZ', 'ZX'][code] WHEN code BETWEEN 11 AND 16 THEN 'Stress_' || ['XX', 'YY', 'ZZ', 'XY', 'YZ', 'ZX'][code - 10]
WHEN code BETWEEN 21 AND 26 THEN 'Plastic_Strain_' || ['XX', 'YY', 'ZZ', 'XY', 'YZ', 'ZX'][code - 20] WHEN code IN (7, 8, 9, 10, 17, 20, 38, 47, 48) THEN map {7: 'Equiv_Plastic_Strain', 8: 'Equiv_Creep_Strain', 9: 'Total_Temperature', 10: 'Temperature_Increment', 17: 'Equiv_Mises', 20: 'Thickness', 38: 'Swelling_Strain', 47: 'Equiv_Cauchy', 48: 'Strain_Energy_Density'}[code]
ELSE 'POST_' || code END AS name FROM (SELECT p_partkey AS node_id, p_size AS code, CASE p_partkey % 7 WHEN 0 THEN 'label of ' || p_size WHEN 1 THEN ' 12 ' ELSE '' END AS label FROM part)""")
def e19_post_names(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey") % 7
    label = F.when(k == 0, F.concat(F.lit("label of "), F.col("p_size").cast("string"))).when(k == 1, F.lit(" 12 ")).otherwise(F.lit(""))
    return p.select(F.col("p_partkey").alias("node_id"), expr.post_name("p_size", label).alias("name"))


@query("SELECT 'run' AS series_id, c AS cycle, node_id AS entity_id, 'both' AS var, round(pres * c + temp, 6) + 0.0 AS value FROM lat_node, (SELECT unnest([1, 2, 3]) AS c)", "lat_node")
def e15_on_every_cycle(spark, sf):
    """Cycles of unlike variables; the new one comes on each."""
    n = table(spark, sf, "lat_node").withColumn("cycle", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    long_ = n.select(F.lit("run").alias("series_id"), "cycle", F.col("node_id").alias("entity_id"), F.explode(F.map_from_arrays(F.array(F.lit("pres"), F.lit("temp"), F.concat(F.lit("only"), F.col("cycle").cast("string"))), F.array(F.col("pres") * F.col("cycle"), "temp", "velx"))).alias("var", "value"))
    return rounded(cycles.on_every_cycle(long_, "both", ["pres", "temp"], F.col("pres") + F.col("temp")))


@query("SELECT node_id, CASE WHEN i < 5 THEN round(sqrt(velx * velx + vely * vely + velz * velz), 6) + 0.0 ELSE 0.0 END AS disp FROM lat_node", "lat_node")
def e18_result_magnitude(spark, sf):
    n = table(spark, sf, "lat_node")
    return rounded(expr.result_magnitude(n.select("node_id"), n.where("i < 5"), ["velx", "vely", "velz"], "disp"))


# ---------------------------------------------------------------- filters


@query("SELECT cell_id FROM lat_cell WHERE material IN (1, 3) AND part_name IN ('ECONOMY', 'STANDARD')", "lat_cell")
def f1_f2_f4_material_and_part(spark, sf):
    c = filters.by_material(table(spark, sf, "lat_cell"), [1, 3])
    return filters.by_part(c, parts_of(spark, sf), ["ECONOMY", "STANDARD"]).select("cell_id")


@query("""SELECT n.name, p.part_name FROM n, (SELECT DISTINCT p_type AS part_name FROM part) p WHERE
n.name = 'FluidRegion' OR n.name = p.part_name OR n.name = '@VPartRegion_' || p.part_name || '[0]' OR n.name LIKE 'FPHPARTS.%.' || p.part_name
OR (n.name = 'all of it')""", extra="n AS (SELECT unnest(['FluidRegion', 'ECONOMY', '@VPartRegion_STANDARD[0]', 'FPHPARTS.x.ECONOMY', 'all of it']) AS name)")
def f3_region_names(spark, sf):
    names = spark.createDataFrame([(n,) for n in ("FluidRegion", "ECONOMY", "@VPartRegion_STANDARD[0]", "FPHPARTS.x.ECONOMY", "all of it")], "name string")
    return filters.resolve_regions(names, table(spark, sf, "part").select(F.col("p_type").alias("part_name")))


@query("SELECT face_id FROM lat_face WHERE region IN ('Xmin', 'Zmax')", "lat_face")
def f6_f7_u2_u3_surfaces(spark, sf):
    return filters.on_surfaces(table(spark, sf, "lat_face"), regions_of(spark, sf), ["Xmin", "Zmax"]).select("face_id")


@query("SELECT face_id, concat(region, '(MAT', material, ')') AS name FROM lat_face f JOIN lat_cell c ON f.owner = c.cell_id WHERE region IS NOT NULL AND material = 2", "lat_face", "lat_cell")
def f8_f22_faces_of_cells(spark, sf):
    cells = filters.by_material(table(spark, sf, "lat_cell"), [2])
    faces = filters.of_cells(filters.boundary(table(spark, sf, "lat_face")), cells)
    return filters.split_by_material(faces, cells, "region").select("face_id", F.col("region").alias("name"))


@query("SELECT node_id FROM lat_node WHERE x >= 2 AND x <= 6 AND y <= 9 AND z >= 0.5 AND abs(x - 4) <= 1.5 AND abs(y - 4.5) <= 2", "lat_node")
def f9_f10_f11_windows(spark, sf):
    n = filters.in_box(table(spark, sf, "lat_node"), (2, 6), (None, 9), (0.5, None))
    return filters.in_rectangle(n, (4, 4.5, 0), (1, 0, 0), (0, 1, 0), 3.0, 4.0).select("node_id")


@query("SELECT particle_id, round(sqrt(vx * vx + vy * vy + vz * vz), 6) + 0.0 AS speed FROM ptcl WHERE ((x BETWEEN 0 AND 6 AND y BETWEEN 0 AND 20 AND z BETWEEN 0 AND 100) OR (x BETWEEN 12 AND 18 AND y BETWEEN 10 AND 50 AND z BETWEEN 50 AND 1000)) AND (particle_id BETWEEN 5 AND 4000 OR particle_id = 4500) AND round_even(sqrt(vx * vx + vy * vy + vz * vz), 0) IN (1, 2, 3, 5, 8, 13, 21)", "ptcl")
def f13_f14_f15_f16_particles(spark, sf):
    p = filters.in_any_box(table(spark, sf, "ptcl"), [(0, 0, 0, 6, 20, 100), (12, 10, 50, 18, 50, 1000)])
    p = filters.by_size(filters.by_ids(p, "particle_id", "5-4000;4500,x"), [1, 2, 3, 5, 8, 13, 21])
    return rounded(p.select("particle_id", filters.particle_scalar(p).alias("speed")))


@query("SELECT cell_id FROM lat_cell WHERE cell_id % 7 = 0 AND part_name = (SELECT part_name FROM lat_cell GROUP BY part_name ORDER BY min(cvol_id), part_name LIMIT 1 OFFSET 1)", "lat_cell")
def f5_f18_overlap_and_sampling(spark, sf):
    return filters.every_nth(filters.by_overlap(table(spark, sf, "lat_cell"), parts_of(spark, sf), 2), 7).select("cell_id")


@query("SELECT node_id FROM lat_node WHERE (x - 4) * (x - 4) + (y - 6) * (y - 6) <= 9 AND z = 1.0", "lat_node")
def f21_disk(spark, sf):
    return filters.in_disk(table(spark, sf, "lat_node").where("z = 1.0"), (4, 6, 0), 3.0).select("node_id")


# polygons of the plane through the nodes' layer, clipped: their area is between those of the cells wholly in and of those that are met
@query("""SELECT c.cell_id, CASE WHEN n = 4 THEN 1.5::DOUBLE END AS area FROM (SELECT c.cell_id, count(*) FILTER ((n.x - 4) * (n.x - 4) + (n.y - 6) * (n.y - 6) <= 9) AS n FROM lat_cell c JOIN lat_node n ON n.k = c.k AND n.i BETWEEN c.i AND c.i + 1 AND n.j BETWEEN c.j AND c.j + 1 WHERE c.k = 0 GROUP BY c.cell_id) c
WHERE n > 0 ORDER BY 1""", "lat_cell", "lat_node")
def f21_disk_of_plane(spark, sf):
    p = slices.disk(table(spark, sf, "lat_cell"), table(spark, sf, "lat_node"), (4, 6, 0.25), (0, 0, 1), 3.0, [])
    got = slices.slice_triangles(p).withColumn("slice", F.col("cell_id"))
    area = slices.integrate(got).select(F.col("slice").alias("cell_id"), r6("area"))
    return area.select("cell_id", F.when(F.col("area") == 1.5, F.col("area")).alias("area"))


@query("SELECT particle_id, x, y FROM ptcl WHERE frame = (SELECT list(DISTINCT frame ORDER BY frame)[32 % count(DISTINCT frame) + 1] FROM ptcl)", "ptcl")
def f23_frame_of_step(spark, sf):
    return filters.frame_of_step(table(spark, sf, "ptcl"), 32).select("particle_id", "x", "y")


# ---------------------------------------------------------------- topology

_CELL_NODES = "cn AS (SELECT cell_id, unnest([n0, n1, n2, n3, n4, n5, n6, n7]) AS node_id FROM lat_cell)"
_PAIRS = ", ".join(f"[n{a}, n{b}]" for a, b in topology.EDGES[12])
_EDGES = f"ed AS (SELECT DISTINCT least(e[1], e[2]) AS a, greatest(e[1], e[2]) AS b FROM (SELECT unnest([{_PAIRS}]) AS e FROM lat_cell))"


@query("SELECT a, b FROM ed", "lat_cell", extra=_EDGES)
def g1_g8_edges(spark, sf):
    return topology.edges(table(spark, sf, "lat_cell"))


@query("SELECT a AS node_id, b AS other FROM ed UNION ALL SELECT b, a FROM ed", "lat_cell", extra=_EDGES)
def j7_node_neighbours(spark, sf):
    return topology.node_neighbours(table(spark, sf, "lat_cell"))


@query("SELECT owner AS cell_id, neighbour AS other FROM lat_face WHERE neighbour IS NOT NULL UNION ALL SELECT neighbour, owner FROM lat_face WHERE neighbour IS NOT NULL", "lat_face")
def j4_j5_adjacent_cells(spark, sf):
    return topology.adjacent_cells(table(spark, sf, "lat_face"))


@query("SELECT owner AS cell_id, face_id, coalesce(neighbour, -1) AS other FROM lat_face", "lat_face")
def j6_across_face(spark, sf):
    f = table(spark, sf, "lat_face")
    return topology.across_face(f.select(F.col("owner").alias("cell_id"), "face_id"), f)


_LOCAL = "lf AS (SELECT cell_id, face_id, row_number() OVER (PARTITION BY cell_id ORDER BY face_id) - 1 AS local FROM (SELECT owner AS cell_id, face_id FROM lat_face UNION ALL SELECT neighbour, face_id FROM lat_face WHERE neighbour IS NOT NULL))"


@query("SELECT cell_id, CAST(local AS INTEGER) AS local, face_id, coalesce(CASE WHEN owner = cell_id THEN neighbour ELSE owner END, -1) AS other FROM lf JOIN lat_face USING (face_id) UNION ALL SELECT cell_id, 6, NULL, -1 FROM lat_cell", "lat_face", "lat_cell", extra=_LOCAL)
def j6_across_local_face(spark, sf):
    q = table(spark, sf, "lat_cell").select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("local"))
    return topology.across_local_face(q, table(spark, sf, "lat_face"))


# the six faces of a cell look down, up, and to lower y, higher x, higher y and lower x
@query("""SELECT cell_id, l.local::INT AS local, coalesce((SELECT d.cell_id FROM lat_cell d WHERE d.i = c.i + [0, 0, 0, 1, 0, -1][l.local + 1] AND d.j = c.j + [0, 0, -1, 0, 1, 0][l.local + 1] AND d.k = c.k + [-1, 1, 0, 0, 0, 0][l.local + 1]), -1) AS other
FROM lat_cell c, (SELECT unnest(range(6)) AS local) l""", "lat_cell")
def j3_j6_across_cell_face(spark, sf):
    c = table(spark, sf, "lat_cell")
    return topology.across_cell_faces(c.select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("local")), c)


_TURN = ", ".join("(" + ", ".join(str(v) for v in (k, *f)) + ")" for k, f in enumerate(topology.FACES[12]))


@query(f"SELECT cell_id, v.m AS local, [n0, n1, n2, n3, n4, n5, n6, n7][v.a + 1] AS first, [n0, n1, n2, n3, n4, n5, n6, n7][v.b + 1] AS second FROM lat_cell, (VALUES {_TURN}) v(m, a, b, c, d)", "lat_cell")
def j3_local_faces(spark, sf):
    return topology.cell_faces(table(spark, sf, "lat_cell")).select("cell_id", "local", F.get("nodes", F.lit(0)).alias("first"), F.get("nodes", F.lit(1)).alias("second"))


@query("SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linenumber) - 1 AS INTEGER) AS place, l_partkey AS value FROM lineitem")
def h1_slices(spark, sf):
    """Lines of orders as the rows of a CSR structure whose offsets are the running counts of lines."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    at = topology.dense_index(l.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linenumber"), ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linenumber"], "position")
    offsets = at.groupBy(F.col("l_orderkey").alias("id")).agg(F.min("position").alias("start"), (F.max("position") + 1).alias("stop"))
    return topology.slices(at.select("position", F.col("l_partkey").alias("value")), offsets)


@query("SELECT cell_id, face_id, n AS position, min(n) OVER (PARTITION BY cell_id) AS start, max(n) OVER (PARTITION BY cell_id) + 1 AS stop FROM (SELECT cell_id, face_id, row_number() OVER (ORDER BY cell_id, face_id) - 1 AS n FROM lf WHERE cell_id < (SELECT count(*) - 5 FROM lat_cell))", "lat_face", "lat_cell", extra=_LOCAL)
def h2_faces_by_cell(spark, sf):
    pairs = topology.faces_of_cells(table(spark, sf, "lat_face")).withColumn("place", F.col("face_id"))
    values, offsets = topology.grouped_faces(pairs, table(spark, sf, "lat_cell").count() - 5)
    rows = topology.slices(values.withColumnRenamed("face_id", "value"), offsets.withColumnRenamed("cell_id", "id"))
    j = rows.join(offsets.withColumnRenamed("cell_id", "id"), "id")
    return j.select(F.col("id").alias("cell_id"), F.col("value").alias("face_id"), (F.col("start") + F.col("place")).alias("position"), "start", "stop")


@query("SELECT cell_id, count(DISTINCT node_id) AS nodes, (SELECT count(*) FROM lat_face f WHERE f.owner = cn.cell_id OR f.neighbour = cn.cell_id) AS faces FROM cn GROUP BY cell_id", "lat_cell", "lat_face", extra=_CELL_NODES)
def j2_j3_counts_of_cells(spark, sf):
    f = table(spark, sf, "lat_face")
    n = topology.polyhedron_nodes(f).groupBy("cell_id").agg(F.count("*").alias("nodes"))
    return n.join(dealt(topology.faces_of_cells(f).groupBy("cell_id").agg(F.count("*").alias("faces"))), "cell_id")


@query("SELECT DISTINCT unnest([n0, n1, n2, n3]) AS node_id FROM lat_face WHERE region IN ('Ymin', 'Zmin')", "lat_face")
def j16_u6_wall_nodes(spark, sf):
    return topology.wall_nodes(table(spark, sf, "lat_face"), regions_of(spark, sf), ["Ymin", "Zmin"])


@query("SELECT owner AS cell_id, list_sort([n0, n1, n2, n3])[1] AS low FROM lat_face WHERE neighbour IS NULL", "lat_face")
def u5_g2_exterior_faces(spark, sf):
    return topology.exterior_faces(table(spark, sf, "lat_cell")).select("cell_id", F.array_min("nodes").alias("low"))


@query("SELECT f.face_id FROM lat_face f JOIN lat_cell c ON f.owner = c.cell_id AND c.material = 1 LEFT JOIN lat_cell d ON f.neighbour = d.cell_id WHERE d.cell_id IS NULL OR d.material <> 1", "lat_face", "lat_cell")
def u4_part_boundary(spark, sf):
    return topology.blade_boundary(table(spark, sf, "lat_face"), filters.by_material(table(spark, sf, "lat_cell"), [1])).select("face_id")


@query("SELECT face_id, CASE WHEN face_id < 10000000 THEN 0.75 WHEN face_id < 20000000 THEN 0.5 ELSE 1.5 END::DOUBLE AS area, CASE WHEN face_id < 10000000 THEN 1.0 ELSE 0.0 END::DOUBLE AS nx, CASE WHEN face_id BETWEEN 10000000 AND 19999999 THEN 1.0 ELSE 0.0 END::DOUBLE AS ny FROM lat_face", "lat_face")
def a10_a12_face_geometry(spark, sf):
    g = topology.face_geometry(table(spark, sf, "lat_face"), table(spark, sf, "lat_node"))
    return g.select("face_id", r6("area"), r6(F.abs("nx"), "nx"), r6(F.abs("ny"), "ny"))


@query("""SELECT f.face_id, CASE WHEN f.region IN ('Xmin', 'Ymin', 'Zmin') THEN -1.0 ELSE 1.0 END::DOUBLE AS toward FROM lat_face f""", "lat_face")
def a12_outward_normals(spark, sf):
    n, f = table(spark, sf, "lat_node"), table(spark, sf, "lat_face")
    g = topology.outward_faces(f, n, topology.cell_centres(table(spark, sf, "lat_cell"), n))
    return g.select("face_id", r6(F.col("nx") + F.col("ny") + F.col("nz"), "toward"))


@query("SELECT cell_id, 0.75::DOUBLE AS volume FROM lat_cell", "lat_cell")
def a11_cell_volumes(spark, sf):
    return rounded(topology.cell_volumes(table(spark, sf, "lat_cell"), table(spark, sf, "lat_node")))


@query("SELECT cell_id, 0.75::DOUBLE AS volume FROM lat_cell", "lat_cell")
def a11_polyhedron_volumes(spark, sf):
    return rounded(topology.cell_volumes(table(spark, sf, "lat_cell"), table(spark, sf, "lat_node"), table(spark, sf, "lat_face")))


@query("SELECT cell_id, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z FROM cn JOIN lat_node USING (node_id) GROUP BY cell_id", "lat_cell", "lat_node", extra=_CELL_NODES)
def a9_cell_centres(spark, sf):
    return rounded(topology.cell_centres(table(spark, sf, "lat_cell"), table(spark, sf, "lat_node")))


@query("SELECT cell_id, round(i + 0.5, 6) AS x, round((j + 0.5) * 1.5, 6) AS y, round((k + 0.5) * 0.5, 6) AS z FROM (SELECT cell_id, i::DOUBLE AS i, j::DOUBLE AS j, k::DOUBLE AS k FROM lat_cell)", "lat_cell")
def a9_polyhedron_centres(spark, sf):
    return rounded(topology.polyhedron_centres(table(spark, sf, "lat_face"), table(spark, sf, "lat_node")))


@query("SELECT node_id, round(avg(ctemp), 6) + 0.0 AS ctemp FROM cn JOIN lat_cell USING (cell_id) GROUP BY node_id", "lat_cell", extra=_CELL_NODES)
def a13_cell_to_node(spark, sf):
    c = table(spark, sf, "lat_cell")
    return rounded(topology.cell_to_node(c, c, "ctemp"))


@query("SELECT face_id, ctemp FROM lat_face JOIN lat_cell ON owner = cell_id WHERE region IS NOT NULL", "lat_face", "lat_cell")
def j28_onto_faces(spark, sf):
    return topology.onto_faces(filters.boundary(table(spark, sf, "lat_face")), table(spark, sf, "lat_cell"), "ctemp")


@query("SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM lat_node", "lat_node")
def a5_bounding_box(spark, sf):
    return topology.bounding_box(table(spark, sf, "lat_node"))


@query("SELECT (SELECT count(*) FROM lat_node) AS nodes, (SELECT count(*) FROM lat_cell) AS cells, (SELECT count(DISTINCT node_id) FROM cn) AS used", "lat_node", "lat_cell", extra=_CELL_NODES)
def a4_counts(spark, sf):
    return topology.counts(table(spark, sf, "lat_node"), table(spark, sf, "lat_cell"))


@query("SELECT part_name, CASE WHEN count(DISTINCT material) = 1 THEN min(material) ELSE -1 END AS material, count(DISTINCT material) AS materials FROM lat_cell GROUP BY part_name", "lat_cell")
def a7_material_of_region(spark, sf):
    return topology.material_of_region(table(spark, sf, "lat_cell"), parts_of(spark, sf))


@query("SELECT material, row_number() OVER (ORDER BY material) - 1 AS place, 'MAT' || material AS name FROM (SELECT DISTINCT material FROM lat_cell)", "lat_cell")
def a6_j20_materials(spark, sf):
    return topology.materials(table(spark, sf, "lat_cell")).withColumn("place", F.col("place").cast("long"))


@query("SELECT count(DISTINCT g) AS overlapping FROM (SELECT cell_id, unnest(CASE WHEN i < 5 AND j < 5 THEN ['low', 'left'] WHEN i < 5 THEN ['left'] WHEN k < 1 THEN ['ground'] ELSE [] END) AS g, CASE WHEN i < 5 AND j < 5 THEN 2 ELSE 1 END AS n FROM lat_cell) WHERE n > 1", "lat_cell")
def a8_overlapping_regions(spark, sf):
    c = table(spark, sf, "lat_cell")
    parts = c.where("i < 5").select(F.lit("left").alias("part_name"), "cvol_id").unionByName(c.where("i < 5 and j < 5").select(F.lit("low").alias("part_name"), "cvol_id")).unionByName(c.where("i >= 5 and k < 1").select(F.lit("ground").alias("part_name"), "cvol_id"))
    return topology.overlapping_regions(c, parts)


@query("SELECT region AS name, count(*) AS faces, row_number() OVER (ORDER BY region) - 1 AS place FROM lat_face WHERE region IS NOT NULL GROUP BY region", "lat_face")
def j21_region_counts(spark, sf):
    return topology.region_counts(regions_of(spark, sf)).select("name", "faces", F.col("place").cast("long").alias("place"))


@query("SELECT part_name, count(*) AS n, min(pres) AS lo, max(pres) AS hi FROM lat_node GROUP BY part_name", "lat_node")
def a1_a2_a3_ranges(spark, sf):
    return topology.value_range(table(spark, sf, "lat_node"), "pres", ["part_name"])


@query("SELECT min(velz) - 1 AS lo, max(velz) + 1 AS hi FROM lat_node", "lat_node")
def a24_data_range(spark, sf):
    return topology.data_range(table(spark, sf, "lat_node"), "velz")


@query("SELECT cell_id, n0, n6 FROM lat_cell", "lat_cell")
def s25_structured_cells(spark, sf):
    k = table(spark, sf, "lat_node").agg(F.max("k")).first()[0]
    return topology.structured_cells(spark, 10, 10, k + 1).select("cell_id", F.get("nodes", F.lit(0)).alias("n0"), F.get("nodes", F.lit(6)).alias("n6"))


@query("SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS dense_id FROM lat_node WHERE x >= 3 AND y <= 9", "lat_node")
def s7_s8_h3_trimmed_nodes(spark, sf):
    nodes, _ = topology.trim_to_box(table(spark, sf, "lat_node"), table(spark, sf, "lat_cell"), x=(3, None), y=(None, 9))
    return nodes.select("node_id", "dense_id")


@query("SELECT cell_id FROM lat_cell WHERE i >= 3 AND j + 1 <= 6", "lat_cell")
def s7_trimmed_cells(spark, sf):
    _, cells = topology.trim_to_box(table(spark, sf, "lat_node"), table(spark, sf, "lat_cell"), x=(3, None), y=(None, 9))
    return cells.select("cell_id")


@query("SELECT cell_id, material, cvol_id, part_name AS name FROM lat_cell", "lat_cell")
def j17_j22_cell_regions(spark, sf):
    return topology.cell_regions(table(spark, sf, "lat_cell"), parts_of(spark, sf)).select("cell_id", "material", "cvol_id", F.get("names", F.lit(0)).alias("name"))


@query("SELECT asked, v.volid, v.name FROM (SELECT unnest(['2', 'ECONOMY', 'none', '99']) AS asked) q LEFT JOIN v ON asked = v.name OR try_cast(asked AS BIGINT) = v.volid", extra="v AS (SELECT row_number() OVER (ORDER BY p_type) AS volid, p_type AS name FROM (SELECT DISTINCT p_type FROM part))")
def j19_region_ids(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    v = spark.sql("SELECT CAST(row_number() OVER (ORDER BY p_type) AS LONG) AS volid, p_type AS name FROM (SELECT DISTINCT p_type FROM part)")
    return topology.region_ids(v, spark.createDataFrame([(a,) for a in ("2", "ECONOMY", "none", "99")], "asked string"))


# ---------------------------------------------------------------- cycles

_CYC = "c AS (SELECT DISTINCT series_id, cycle, time FROM cyc_field), m AS (SELECT *, row_number() OVER (ORDER BY cycle) - 1 AS ord, lead(cycle) OVER (ORDER BY cycle) AS next FROM c)"


def cycles_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cyc_field").select("series_id", "cycle", "time").distinct()


def asked(spark: SparkSession, values: list, kind: str = "double") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"asked {kind}")


@query("SELECT q.asked, 'run' AS series_id, coalesce((SELECT min(cycle) FROM c WHERE cycle >= q.asked), (SELECT max(cycle) FROM c)) AS cycle FROM (SELECT unnest([0, 7, 40]) AS asked) q", "cyc_field", extra=_CYC)
def j23_j24_as_of_cycle(spark, sf):
    return cycles.as_of(cycles_of(spark, sf), asked(spark, [0, 7, 40], "int"))


@query("SELECT ord, series_id, cycle, time FROM m WHERE ord IN (0, 3)", "cyc_field", extra=_CYC)
def j25_by_ordinal(spark, sf):
    return cycles.by_ordinal(cycles_of(spark, sf), asked(spark, [0, 3, 99], "long"))


@query("SELECT q.asked, 'run' AS series_id, (SELECT cycle FROM c ORDER BY abs(time - q.asked), cycle LIMIT 1) AS cycle FROM (SELECT unnest([0.0::DOUBLE, 1.44, 9.0]) AS asked) q", "cyc_field", extra=_CYC)
def j27_nearest_time(spark, sf):
    return cycles.nearest_time(cycles_of(spark, sf), asked(spark, [0.0, 1.44, 9.0]))


@query("SELECT min(cycle) AS min_cycle, max(cycle) AS max_cycle, max(ord) AS max_index, count(*) AS members FROM m", "cyc_field", extra=_CYC)
def w5_w6_ranges(spark, sf):
    return cycles.ranges(cycles_of(spark, sf))


_INTERP = """SELECT q.asked, a.series_id, a.entity_id, a.var, round((1 - q.f) * a.value + q.f * coalesce(b.value, 0), 6) + 0.0 AS value
FROM q JOIN cyc_field a ON a.cycle = q.c0 LEFT JOIN cyc_field b ON b.cycle = q.c1 AND b.var = a.var"""


@query(_INTERP, "cyc_field", extra=_CYC + ", q AS (SELECT asked, cycle AS c0, next AS c1, CASE WHEN next IS NULL THEN 0 ELSE asked - floor(asked) END AS f FROM (SELECT unnest([0.25::DOUBLE, 4.0, 29.5]) AS asked) q JOIN m ON m.ord = floor(asked))")
def w1_w2_at_index(spark, sf):
    return rounded(cycles.at_index(table(spark, sf, "cyc_field"), cycles_of(spark, sf), asked(spark, [0.25, 4.0, 29.5, 77.0])), "asked")


@query(_INTERP, "cyc_field", extra=_CYC + ", q AS (SELECT asked, cycle AS c0, next AS c1, CASE WHEN next IS NULL THEN 0 ELSE (t - cycle * 0.1) / ((next - cycle) * 0.1) END AS f FROM (SELECT asked, least(greatest(asked, 0.1), 3.0) AS t FROM (SELECT unnest([0.0::DOUBLE, 0.55, 1.23, 9.0]) AS asked)) q JOIN m ON m.cycle * 0.1 <= t + 1e-9 AND (next IS NULL OR t < next * 0.1 - 1e-9))")
def w3_at_time(spark, sf):
    return rounded(cycles.at_time(table(spark, sf, "cyc_field"), cycles_of(spark, sf), asked(spark, [0.0, 0.55, 1.23, 9.0])), "asked")


@query(_INTERP, "cyc_field", extra=_CYC + ", q AS (SELECT asked, cycle AS c0, next AS c1, CASE WHEN next IS NULL THEN 0 ELSE (asked - cycle) / (next - cycle) END AS f FROM (SELECT unnest([2.5::DOUBLE, 7.0, 12.75]) AS asked) q JOIN m ON m.cycle <= asked AND (next IS NULL OR asked < next))")
def w4_at_cycle(spark, sf):
    return rounded(cycles.at_cycle(table(spark, sf, "cyc_field"), cycles_of(spark, sf), asked(spark, [2.5, 7.0, 12.75])), "asked")


@query("SELECT series_id, cycle, var, round(avg(value), 6) + 0.0 AS value FROM cyc_field GROUP BY ALL", "cyc_field")
def a21_series_means(spark, sf):
    return rounded(cycles.series_means(table(spark, sf, "cyc_field")))


@query("""SELECT series_id, entity_id, var, round(sum(value), 4) + 0.0 AS s, round(avg(value), 4) + 0.0 AS a, round(-sum(value), 4) + 0.0 AS d, round(sum(value * value), 4) + 0.0 AS q, round(avg(value * value), 4) + 0.0 AS qa,
round(ln(product(value)), 4) + 0.0 AS p, round(ln(1 / product(value)), 4) + 0.0 AS v FROM cyc_field GROUP BY ALL""", "cyc_field")
def a23_cycle_operations(spark, sf):
    f = table(spark, sf, "cyc_field")
    out = None
    for op, name in (("sum", "s"), ("average", "a"), ("subtract", "d"), ("square_sum", "q"), ("square_average", "qa"), ("multiply", "p"), ("divide", "v")):
        v = F.ln("value") if name in "pv" else F.col("value")
        one = cycles.accumulate(f, op).select("series_id", "entity_id", "var", (F.round(v, 4) + 0.0).alias(name))
        out = one if out is None else out.join(one, ["series_id", "entity_id", "var"])
    return out


@query("SELECT event_id AS path, 'cycle' AS ds_id, event_id % 3 = 0 AS has_mesh, user_id AS stem, min(CASE WHEN event_id % 3 = 0 THEN event_id END) OVER (PARTITION BY user_id) AS first, CASE WHEN event_id % 3 = 0 THEN event_id ELSE min(CASE WHEN event_id % 3 = 0 THEN event_id END) OVER (PARTITION BY user_id) END AS mesh_id FROM events")
def s6_inherited_mesh(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("path"), F.col("event_id").alias("ds_id"), (F.col("event_id") % 3 == 0).alias("has_mesh"), F.col("user_id").alias("stem"))
    m = cycles.with_mesh(e)
    first = F.min(F.when(F.col("has_mesh"), F.col("path"))).over(cycles.Window.partitionBy("stem"))
    return m.select("path", F.lit("cycle").alias("ds_id"), "has_mesh", "stem", first.alias("first"), "mesh_id")


@query("SELECT path, cycle, row_number() OVER (ORDER BY cycle, path) - 1 AS ord FROM (SELECT 'run/res_' || p_partkey || '.dat' AS path, CAST(p_partkey AS INTEGER) AS cycle FROM part ORDER BY 1 LIMIT 500)")
def s3_s4_series(spark, sf):
    files = table(spark, sf, "part").select(F.concat(F.lit("run/res_"), F.col("p_partkey"), F.lit(".dat")).alias("path")).unionByName(spark.createDataFrame([("run/other_1.dat",), ("run/res.dat",)], "path string"))
    return datasets.scan_series(files, "run/res_100.dat").select("path", "cycle", F.col("ord").cast("long").alias("ord"))


@query("SELECT series_id AS ds_id, count(*) AS rows, count(DISTINCT entity_id) AS entities, count(DISTINCT cycle) AS cycles FROM cyc_field GROUP BY series_id", "cyc_field")
def s9_summary(spark, sf):
    return datasets.summary(table(spark, sf, "cyc_field").withColumnRenamed("series_id", "ds_id")).drop("names")


# ---------------------------------------------------------------- calculus

_SIDES = "e AS (SELECT a AS n, b AS o FROM ed UNION ALL SELECT b, a FROM ed)"


def _central(f: str, axis: str) -> str:
    step = {"x": 1, "y": 10, "z": 100}[axis]
    here = {"x": "i", "y": "j", "z": "k"}[axis]
    return f"CASE WHEN p.{here} = (SELECT min({here}) FROM lat_node) OR p.{here} = (SELECT max({here}) FROM lat_node) THEN 0 ELSE (SELECT (u.{f} - d.{f}) / (u.{axis} - d.{axis}) FROM lat_node u, lat_node d WHERE u.node_id = p.node_id + {step} AND d.node_id = p.node_id - {step}) END"


@query(f"SELECT node_id, round({_central('pres', 'x')}, 6) + 0.0 AS dpres_dx, round({_central('pres', 'y')}, 6) + 0.0 AS dpres_dy, round({_central('pres', 'z')}, 6) + 0.0 AS dpres_dz FROM lat_node p", "lat_node")
def c1_c3_node_gradient(spark, sf):
    return rounded(calculus.node_gradient(table(spark, sf, "lat_cell"), table(spark, sf, "lat_node"), ["pres"]))


@query("""SELECT c.cell_id, round(CASE WHEN i BETWEEN 1 AND 7 THEN (SELECT ctemp FROM lat_cell u WHERE u.cell_id = c.cell_id + 1) / 2 - (SELECT ctemp FROM lat_cell u WHERE u.cell_id = c.cell_id - 1) / 2 ELSE 0 END, 6) + 0.0 AS dctemp_dx,
round(CASE WHEN j BETWEEN 1 AND 7 THEN ((SELECT ctemp FROM lat_cell u WHERE u.cell_id = c.cell_id + 9) - (SELECT ctemp FROM lat_cell u WHERE u.cell_id = c.cell_id - 9)) / 3 ELSE 0 END, 6) + 0.0 AS dctemp_dy FROM lat_cell c""", "lat_cell")
def c2_cell_gradient(spark, sf):
    c = table(spark, sf, "lat_cell")
    centres = topology.cell_centres(c, table(spark, sf, "lat_node")).join(c.select("cell_id", "ctemp"), "cell_id")
    return rounded(calculus.cell_gradient(table(spark, sf, "lat_face"), centres, ["ctemp"]).drop("dctemp_dz"))


@query("SELECT node_id, 0.0::DOUBLE AS div, 0.0::DOUBLE AS rx, 0.0::DOUBLE AS ry, 2.0::DOUBLE AS rz FROM lat_node WHERE i BETWEEN 1 AND 8 AND j BETWEEN 1 AND 8 AND k BETWEEN 1 AND (SELECT max(k) FROM lat_node) - 1", "lat_node")
def c4_c5_divergence_and_rotation(spark, sf):
    n = table(spark, sf, "lat_node")
    inner = n.where("i between 1 and 8 and j between 1 and 8").join(F.broadcast(n.agg(F.max("k").alias("top")))).where("k >= 1 and k < top").select("node_id")
    g = calculus.node_gradient(table(spark, sf, "lat_cell"), n, ["velx", "vely", "velz"]).join(inner, "node_id", "left_semi")
    rot = calculus.rotation("velx", "vely", "velz")
    return rounded(g.select("node_id", calculus.divergence("velx", "vely", "velz").alias("div"), *(c.alias(a) for c, a in zip(rot, ("rx", "ry", "rz"), strict=True))))


# ---------------------------------------------------------------- nearest

_QUERY = "q AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS point_id, s_suppkey % 11 - 0.4::DOUBLE AS x, s_suppkey % 13 + 0.2::DOUBLE AS y, s_suppkey % 7 + 0.1::DOUBLE AS z FROM (SELECT * FROM supplier ORDER BY s_suppkey)), d AS (SELECT point_id, node_id, q.x, q.y, q.z, n.pres, n.x AS sx, n.y AS sy, n.z AS sz, sqrt((q.x - n.x) * (q.x - n.x) + (q.y - n.y) * (q.y - n.y) + (q.z - n.z) * (q.z - n.z)) AS distance, row_number() OVER (PARTITION BY point_id ORDER BY (q.x - n.x) * (q.x - n.x) + (q.y - n.y) * (q.y - n.y) + (q.z - n.z) * (q.z - n.z), node_id) AS rank FROM q, lat_node n)"


def query_points(spark: SparkSession, sf: str) -> DataFrame:
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    return s.select(k.cast("long").alias("point_id"), (k % 11 - F.lit(0.4)).cast("double").alias("x"), (k % 13 + F.lit(0.2)).cast("double").alias("y"), (k % 7 + F.lit(0.1)).cast("double").alias("z"))


def node_sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lat_node").withColumnRenamed("node_id", "source_id")


@query("SELECT point_id, CAST(rank AS INTEGER) AS rank, round(distance, 6) + 0.0 AS distance FROM d WHERE rank <= 4", "lat_node", extra=_QUERY)
def j9_four_nearest(spark, sf):
    return rounded(nearest.knn(query_points(spark, sf), node_sources(spark, sf), 4).drop("source_id"))


@query("SELECT point_id, node_id AS source_id, pres FROM d WHERE rank = 1", "lat_node", extra=_QUERY)
def j9_j11_j13_nearest_value(spark, sf):
    return nearest.nearest(query_points(spark, sf), node_sources(spark, sf), ["pres"]).select("point_id", "source_id", "pres")


@query("SELECT point_id, round(sum(pres / (distance * distance)) / sum(1 / (distance * distance)), 6) + 0.0 AS pres FROM d WHERE rank <= 4 GROUP BY point_id", "lat_node", extra=_QUERY)
def j10_inverse_distance(spark, sf):
    return rounded(nearest.idw(query_points(spark, sf), node_sources(spark, sf), "pres"))


@query("SELECT point_id, 'node' AS location, node_id AS entity_id, unnest(['pres', 'temp']) AS var, unnest([pres, (SELECT temp FROM lat_node n WHERE n.node_id = d.node_id)]) AS value FROM d WHERE rank = 1", "lat_node", extra=_QUERY)
def j12_probe(spark, sf):
    return nearest.probe(query_points(spark, sf), node_sources(spark, sf), ["pres", "temp"], "node")


@query("SELECT node_id AS point_id, x + 0.0 AS dst, CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS nx FROM lat_node", "lat_node")
def c7_c8_wall_distance(spark, sf):
    n = table(spark, sf, "lat_node")
    walls = topology.wall_nodes(table(spark, sf, "lat_face"), regions_of(spark, sf), ["Xmin"]).join(n.select("node_id", "x", "y", "z"), "node_id")
    return nearest.wall_distance(n.select(F.col("node_id").alias("point_id"), "x", "y", "z"), walls).select("point_id", r6("dst"), r6("nx"))


@query("SELECT l.i AS point_id, round(l.i / 40.0, 6) AS t, n.pres FROM (SELECT range AS i FROM range(41)) l JOIN lat_node n ON n.node_id = CAST(ceil(9.0 * l.i / 40 - 0.5) AS BIGINT)", "lat_node")
def l1_line(spark, sf):
    p = nearest.line_points(spark, (0, 0, 0), (9, 0, 0), 41)
    return nearest.nearest(p, node_sources(spark, sf), ["pres"]).select("point_id", r6("t"), "pres")


@query()
def l2_w7_spline(spark, sf):
    p = nearest.spline_points(spark, [(0, 0, 0), (4, 6, 1), (9, 13, 2)], 64)
    return nearest.nearest(p, node_sources(spark, sf), ["pres"]).select("point_id", "arc", "pres")


@query("SELECT p.point_id, round(abs(p.pres - d.pres), 6) + 0.0 AS value FROM (SELECT point_id, 1000.0::DOUBLE AS pres FROM q) p JOIN d ON d.point_id = p.point_id AND d.rank = 1", "lat_node", extra=_QUERY)
def d2_remapped_difference(spark, sf):
    return rounded(compare.difference_remapped(query_points(spark, sf).withColumn("pres", F.lit(1000.0)), node_sources(spark, sf), "pres"))


@query("SELECT cell_id AS point_id, cell_id, round(avg(pres), 6) + 0.0 AS pres FROM cn JOIN lat_node USING (node_id) GROUP BY cell_id", "lat_cell", "lat_node", extra=_CELL_NODES)
def j14_j15_interpolation(spark, sf):
    n, c = table(spark, sf, "lat_node"), table(spark, sf, "lat_cell")
    p = topology.cell_centres(c, n).withColumnRenamed("cell_id", "point_id")
    return nearest.interpolate(p, c, n, ["pres"]).select("point_id", "cell_id", r6("pres"))


@query()
def g10_resample(spark, sf):
    return rounded(nearest.resample(spark, table(spark, sf, "lat_cell"), table(spark, sf, "lat_node"), "pres", 4))


# ---------------------------------------------------------------- slices


@query("SELECT 0 AS slice, count(*) AS cells, 121.5::DOUBLE AS area, 121.5::DOUBLE AS flux FROM lat_cell WHERE k = 0", "lat_cell")
def g3_g7_a14_plane_flux(spark, sf):
    p = slices.cut(table(spark, sf, "lat_cell"), table(spark, sf, "lat_node"), (0, 0, 0.2), (0, 0, 1), ["velx", "vely", "velz"])
    t = slices.slice_triangles(p)
    got = slices.integrate(t, (0, 0, 1), vector=("velx", "vely", "velz"))
    return got.join(p.groupBy("slice").agg(F.count("*").alias("cells")), "slice").select("slice", "cells", r6("area"), r6("flux"))


@query("SELECT 0 AS slice, 121.5::DOUBLE AS area, round(sum(s.v) * 1.5, 4) + 0.0 AS integral FROM (SELECT (a.x + 0.5) AS v FROM lat_node a WHERE a.i < 9 AND a.j < 9 AND a.k = 0) s", "lat_node")
def a14_scalar_integral(spark, sf):
    p = slices.cut(table(spark, sf, "lat_cell"), table(spark, sf, "lat_node").withColumn("s", F.col("x")), (0, 0, 0.3), (0, 0, 1), ["s"])
    return slices.integrate(slices.slice_triangles(p), (0, 0, 1), scalar="s").select("slice", r6("area"), (F.round("integral", 4) + 0.0).alias("integral"))


@query("SELECT CAST(s AS INTEGER) AS slice, 121.5::DOUBLE AS area, 81::BIGINT AS cells FROM (SELECT unnest(range(4)) AS s), (SELECT max(k) AS top FROM lat_node) WHERE 0.1 + s * 0.1 < top * 0.5", "lat_node")
def g12_moving_plane(spark, sf):
    planes = slices.moving_planes(spark, 4, "line", (0, 0, 0.1), (0, 0, 1), shift=(0, 0, 0.3))
    p = slices.moving_cut(table(spark, sf, "lat_cell"), table(spark, sf, "lat_node"), planes, [])
    return slices.integrate(slices.slice_triangles(p)).join(p.groupBy("slice").agg(F.count("*").alias("cells")), "slice").select("slice", r6("area"), "cells")


@query("SELECT CAST(l - 1 AS INTEGER) AS slice, count(*) AS cells, round(count(*) * 0.75::DOUBLE, 6) + 0.0 AS area FROM lat_cell, (SELECT unnest([1, 2]) AS l) WHERE (l = 1 AND i = 2) OR (l = 2 AND i = 5) GROUP BY l", "lat_cell")
def g4_isosurfaces(spark, sf):
    n = table(spark, sf, "lat_node").withColumn("f", F.col("x") * 2)
    p = slices.isosurfaces(table(spark, sf, "lat_cell"), n, "f", [5.0, 11.0], [])
    return slices.integrate(slices.slice_triangles(p)).join(p.groupBy("slice").agg(F.count("*").alias("cells")), "slice").select("slice", "cells", r6("area"))


@query("SELECT count(*) * 2 AS points, 4.5::DOUBLE AS x FROM lat_cell WHERE k = 0 AND i = 4", "lat_cell")
def g5_isolines(spark, sf):
    n = table(spark, sf, "lat_node").withColumn("f", F.col("x"))
    p = slices.cut(table(spark, sf, "lat_cell"), n, (0, 0, 0.2), (0, 0, 1), ["f"])
    return slices.isolines(p, "f", [4.5]).groupBy(r6("x")).agg(F.count("*").alias("points")).toDF("x", "points")


@query("SELECT 4 * 9 * 2 AS points")
def g6_boundary_line(spark, sf):
    return slices.boundary_line(table(spark, sf, "lat_cell"), table(spark, sf, "lat_node"), (0, 0, 0.2), (0, 0, 1)).agg(F.count("*").cast("int").alias("points"))


@query("SELECT part_name, count(*) AS faces FROM lat_face f JOIN lat_cell c ON f.owner = c.cell_id WHERE f.neighbour IS NULL GROUP BY part_name", "lat_face", "lat_cell")
def g13_region_surfaces(spark, sf):
    return slices.region_surfaces(table(spark, sf, "lat_face"), table(spark, sf, "lat_cell"), parts_of(spark, sf)).groupBy("part_name").agg(F.count("*").alias("faces"))


@query("SELECT node_id, velx + 0.0 AS u, vely + 0.0 AS v, 0.0::DOUBLE AS w FROM lat_node", "lat_node")
def g11_projected_vectors(spark, sf):
    n = table(spark, sf, "lat_node")
    u = slices.projected(F.col("velx"), F.col("vely"), F.col("velz"), (0, 0, 1))
    return rounded(n.select("node_id", *(c.alias(a) for c, a in zip(u, "uvw", strict=True))))


@query("""SELECT count(*) AS cells FROM (SELECT c.cell_id FROM lat_cell c JOIN cn USING (cell_id) JOIN lat_node n USING (node_id) GROUP BY c.cell_id
HAVING min(sqrt(n.x * n.x + n.y * n.y)) < 5 AND max(sqrt(n.x * n.x + n.y * n.y)) > 5)""", "lat_cell", "lat_node", extra=_CELL_NODES)
def f19_cylinder(spark, sf):
    return slices.cylinder_cut(table(spark, sf, "lat_cell"), table(spark, sf, "lat_node"), 5.0, 1e9, "z", []).agg(F.count("*").alias("cells"))


# ---------------------------------------------------------------- blades

_SPAN = f"b AS (SELECT *, {sql_bin('z', 'lo', 'hi', 6)} AS span FROM (SELECT *, velx AS nx, vely AS ny, CASE WHEN sqrt(x * x + y * y) < 1e-12 THEN 0 ELSE (vely * x - velx * y) / sqrt(x * x + y * y) END AS n FROM cloud), (SELECT min(z) AS lo, max(z) AS hi FROM cloud))"


@query("""SELECT span, coalesce(round(avg(CASE WHEN n > 0 THEN pres END), 6) + 0.0, 'NaN'::DOUBLE) AS ps, coalesce(round(avg(CASE WHEN n < 0 THEN pres END), 6) + 0.0, 'NaN'::DOUBLE) AS ss FROM b GROUP BY span""", "cloud", extra=_SPAN.replace("vely * x - velx * y", "(velz - 1.04) * x - 0.01 * y").replace("vely AS ny", "velz - 1.04 AS ny"))
def b2_b3_loading(spark, sf):
    c = table(spark, sf, "cloud").withColumns({"nx": F.lit(0.01), "ny": F.col("velz") - 1.04})
    return rounded(blades.loading(c, "pres", 6)).where("not isnan(ps) or not isnan(ss)")


@query("""SELECT span, round(avg(CASE WHEN t >= m THEN pres END), 6) + 0.0 AS ps, round(avg(CASE WHEN t < m THEN pres END), 6) + 0.0 AS ss, round(coalesce(avg(CASE WHEN t >= m THEN pres END) - avg(CASE WHEN t < m THEN pres END), 0), 6) + 0.0 AS dp FROM (SELECT *, atan2(y, x) AS t, median(atan2(y, x)) OVER (PARTITION BY span) AS m FROM b) GROUP BY span""", "cloud", extra=_SPAN)
def b4_b5_loading_of_volume(spark, sf):
    got = blades.loading_curve(blades.loading_of_volume(table(spark, sf, "cloud"), "pres", 6))
    return rounded(got).where("not isnan(ps)")


@query("""SELECT round(CASE WHEN r > 0.35 THEN lag * 2 * pi() / 720 ELSE 2 * pi() END, 6) + 0.0 AS pitch FROM (
SELECT a.lag, sum(x.v * y.v) / (SELECT sum(v * v) FROM h) AS r FROM (SELECT unnest(range(22, 720)) AS lag) a JOIN h x ON true JOIN h y ON y.bin = x.bin + a.lag GROUP BY a.lag) ORDER BY round(r, 12) DESC, lag LIMIT 1""", "cloud",
extra="""t AS (SELECT line % 4 * 1.5707963267948966::DOUBLE + 0.2::DOUBLE + density * 0.05::DOUBLE AS t FROM cloud), c AS (SELECT CAST(least(719, floor(t / 6.283185307179586::DOUBLE * 720)) AS BIGINT) AS bin, count(*) AS n FROM t WHERE t BETWEEN 0 AND 6.283185307179586::DOUBLE GROUP BY 1),
h AS (SELECT g.bin, coalesce(n, 0) - (SELECT sum(n) FROM c) / 720.0::DOUBLE AS v FROM (SELECT unnest(range(720)) AS bin) g LEFT JOIN c USING (bin))""")
def b6_pitch(spark, sf):
    t = table(spark, sf, "cloud")
    theta = F.pmod(F.col("line"), F.lit(4)) * F.lit(1.5707963267948966) + F.lit(0.2) + F.col("density") * 0.05
    return rounded(blades.pitch(t, theta))


@query("SELECT face_id, 'named' AS rule FROM lat_face WHERE region = 'Zmax' UNION ALL SELECT face_id, 'word' FROM lat_face WHERE region = 'Xmin' UNION ALL SELECT f.face_id, 'part' FROM lat_face f JOIN lat_cell c ON f.owner = c.cell_id AND c.material = 2 LEFT JOIN lat_cell d ON f.neighbour = d.cell_id WHERE d.cell_id IS NULL OR d.material <> 2", "lat_face", "lat_cell")
def b1_three_rules(spark, sf):
    """Regions by name, by words, and none of either, with parts of which one has a rotating word in its name."""
    f, c = scratch.keep(table(spark, sf, "lat_face"), "faces"), scratch.keep(table(spark, sf, "lat_cell").withColumn("cvol_id", F.col("material")), "cells")
    plain = f.where("region is not null").select(F.col("region").alias("name"), "face_id")
    names = plain.withColumn("name", F.when(F.col("name") == "Xmin", "Fan_Wing_1").when(F.col("name") == "Ymin", "Rotor_Hub").otherwise(F.col("name")))
    parts = c.select(F.when(F.col("material") == 2, "ImpellerZone").otherwise(F.concat(F.lit("Case"), F.col("material").cast("string"))).alias("part_name"), "cvol_id").distinct()
    ways = {"named": blades.wall_faces(f, names, c, ["Zmax"], parts), "word": blades.wall_faces(f, names, c, ["absent"], parts), "part": blades.wall_faces(f, plain, c, None, parts)}
    out = None
    for rule, df in ways.items():
        one = df.select("face_id", F.lit(rule).alias("rule"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c.copy, count(*) AS n, round(sum(sqrt(x * x + y * y) * (t - floor(t / 1.5) * 1.5 + c.copy * 1.5)), 2) + 0.0 AS arc FROM (SELECT *, atan2(y, x) AS t FROM cloud), (SELECT 0 AS copy UNION ALL SELECT 1) c GROUP BY c.copy", "cloud")
def b7_unwrapped(spark, sf):
    return blades.unwrapped(table(spark, sf, "cloud"), 1.5, 2).groupBy("copy").agg(F.count("*").alias("n"), (F.round(F.sum("arc"), 2) + 0.0).alias("arc"))


@query("SELECT face_id FROM lat_face WHERE region = 'Xmin'", "lat_face")
def b1_h5_wall_faces(spark, sf):
    names = regions_of(spark, sf).withColumn("name", F.when(F.col("name") == "Xmin", "Blade_x").when(F.col("name") == "Ymin", "rotor_Hub").otherwise(F.col("name")))
    return blades.wall_faces(table(spark, sf, "lat_face"), names, table(spark, sf, "lat_cell")).select("face_id")


# ---------------------------------------------------------------- comparison


@query("SELECT node_id, round(abs(pres - (temp + pres * 0.5)), 6) + 0.0 AS value FROM lat_node", "lat_node")
def d1_difference(spark, sf):
    n = table(spark, sf, "lat_node")
    return rounded(compare.difference(n, n.withColumn("pres", F.col("temp") + F.col("pres") * 0.5), "node_id", "pres"))


@query("SELECT var, count(*) AS n, round(min(d), 6) + 0.0 AS lo, round(max(d), 6) + 0.0 AS hi, round(avg(d), 6) + 0.0 AS mean, round(sqrt(avg(d * d)), 6) + 0.0 AS rms FROM (SELECT 'pres' AS var, pres * 0.5 AS d FROM lat_node UNION ALL SELECT 'temp', 1.0 FROM lat_node) GROUP BY var", "lat_node")
def d3_a22_u1_summary(spark, sf):
    n = table(spark, sf, "lat_node").select("node_id", "pres", "temp")
    return rounded(compare.summary(n, n.withColumns({"pres": F.col("pres") * 1.5, "temp": F.col("temp") + 1, "more": F.lit(1.0)}), "node_id"))


@query("SELECT 'diff' AS ds_id, node_id, round(-pres, 6) + 0.0 AS pres, 0.0::DOUBLE AS temp FROM lat_node", "lat_node")
def d4_difference_dataset(spark, sf):
    n = table(spark, sf, "lat_node")
    return rounded(compare.difference_dataset(n, n.withColumn("pres", F.col("pres") * 2), "node_id", ["pres", "temp"], "signed"))


# ---------------------------------------------------------------- modal analysis


def snapshots_of(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("cycle"), F.posexplode("embedding").alias("entity_id", "value")).select("cycle", F.col("entity_id").cast("long").alias("entity_id"), F.col("value").cast("double").alias("value"))


_SNAP = "s AS (SELECT vec_id AS cycle, unnest(range(64)) AS entity_id, unnest(embedding)::DOUBLE AS value FROM embeddings)"


@query("SELECT 64::BIGINT AS modes, round(sum((value - m) * (value - m)), 3) + 0.0 AS variance, 1.0::DOUBLE AS energy FROM s JOIN (SELECT entity_id, avg(value) AS m FROM s GROUP BY entity_id) USING (entity_id)", extra=_SNAP)
def m1_m2_pod(spark, sf):
    c, _ = modal.pod(snapshots_of(spark, sf), 64)
    return c.agg(F.countDistinct("mode").alias("modes"), (F.round(F.sum(F.col("t") * F.col("t")), 3) + 0.0).alias("variance"), (F.round(F.sum("energy") / F.countDistinct("cycle"), 6) + 0.0).alias("energy"))


_LLOYD = "c0 AS (SELECT cycle AS cluster, entity_id, value FROM s WHERE cycle < 3)"


def _lloyd(steps: int) -> str:
    out = _LLOYD
    for k in range(steps):
        out += f""", l{k} AS (SELECT cycle, arg_min(cluster, (round(d, 9), cluster)) AS cluster FROM (SELECT s.cycle, c.cluster, sum((s.value - c.value) * (s.value - c.value)) AS d FROM s JOIN c{k} c USING (entity_id) GROUP BY s.cycle, c.cluster) GROUP BY cycle),
c{k + 1} AS (SELECT cluster, entity_id, avg(value) AS value FROM s JOIN l{k} USING (cycle) GROUP BY cluster, entity_id)"""
    return out


@query("SELECT CAST(cycle AS INTEGER) AS cycle, CAST(cluster AS INTEGER) AS cluster FROM l3", extra=f"{_SNAP}, {_lloyd(4)}")
def m4_m5_kmeans(spark, sf):
    labels, _ = modal.kmeans(snapshots_of(spark, sf), 3, [0, 1, 2], steps=4, tolerance=0.0)
    return labels.select("cycle", "cluster")


@query()
def m3_m6_mode_and_cluster_fields(spark, sf):
    s = snapshots_of(spark, sf)
    _, fields = modal.pod(s, 2)
    _, centroids = modal.kmeans(s, 2, [0, 1], steps=3)
    nodes = spark.range(64).withColumnRenamed("id", "entity_id")
    return modal.cluster_fields(modal.mode_fields(nodes, s, fields, 2), centroids, 2)


# ---------------------------------------------------------------- tracing



def rk4_sql(seeds: str, step: float, steps: int, signs: str = "(1)", method: str = "rk4", more: str = "true") -> str:
    """Recursive rows l (point_id, sg, place, x, y, z, arc) of lines in the lattice's velocity (6.75 - y, x - 4.5, 1), which is linear, so
    that cells give it exactly."""
    h = f"(sg * {step}::DOUBLE)"
    u, v = "(6.75 - {y})", "({x} - 4.5)"
    k = [(u.format(y="y"), v.format(x="x"))]
    for part in {"rk4": (0.5, 0.5, 1.0), "rk2": (0.5,), "euler": ()}[method]:
        a, b = k[-1]
        k.append((u.format(y=f"(y + {part} * {h} * {b})"), v.format(x=f"(x + {part} * {h} * {a})")))
    du, dv = (f"({k[0][c]} + 2 * {k[1][c]} + 2 * {k[2][c]} + {k[3][c]}) / 6" if method == "rk4" else k[-1][c] for c in range(2))
    return f"""l AS (SELECT point_id, sg, 0 AS place, x, y, z, 0.0::DOUBLE AS arc FROM ({seeds}), (SELECT unnest([{signs.strip("()")}]) AS sg)
UNION ALL SELECT point_id, sg, place + 1, x + {h} * {du}, y + {h} * {dv}, z + {h}, arc + {step}::DOUBLE * sqrt(pow({du}, 2) + pow({dv}, 2) + 1) FROM l WHERE place < {steps} AND {more})"""


_SEEDS = "SELECT s_suppkey AS point_id, (3 + s_suppkey % 4 + 0.25)::DOUBLE AS x, (5 + s_suppkey % 5 * 0.7)::DOUBLE AS y, (0.25 + s_suppkey % 3 * 0.01)::DOUBLE AS z FROM supplier"


def line_seeds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.cast("long").alias("point_id"), (3 + k % 4 + F.lit(0.25)).cast("double").alias("x"), (5 + k % 5 * F.lit(0.7)).cast("double").alias("y"), (F.lit(0.25) + k % 3 * F.lit(0.01)).cast("double").alias("z"))


_VELOCITY = ("velx", "vely", "velz")
_LINE = "point_id, place, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z"


@query(f"SELECT {_LINE}, CASE WHEN sg = 1 THEN 'forward' ELSE 'backward' END AS direction, round(arc, 6) + 0.0 AS arc, round(x, 6) + 0.0 AS xs FROM l", extra=rk4_sql(_SEEDS, 0.001, 200, "(1, -1)"), recursive=True)
def r1_r2_streamlines(spark, sf):
    n = table(spark, sf, "lat_node").withColumn("xs", F.col("x"))
    return rounded(trace.streamlines(line_seeds(spark, sf), table(spark, sf, "lat_cell"), n, _VELOCITY, 0.001, 200, "both", scalar="xs"))


@query(f"SELECT {_LINE}, round(arc, 6) + 0.0 AS arc FROM l", extra=rk4_sql(_SEEDS, 0.002, 100, method="euler", more="arc < 0.3"), recursive=True)
def r2_euler_to_a_length(spark, sf):
    return rounded(trace.streamlines(line_seeds(spark, sf), table(spark, sf, "lat_cell"), table(spark, sf, "lat_node"), _VELOCITY, 0.002, 100, method="euler", length=0.3).drop("direction"))


# above the lattice the nearest node's velocity, upward, goes on to half the box beyond it
@query("""SELECT p.s_suppkey AS point_id, place::INT AS place, round(4.5 + 0.01::DOUBLE, 6) AS x, round(0.1 * 0.5 + (SELECT max(z) FROM lat_node) + place * (SELECT max(z) FROM lat_node) * 0.125, 6) + 0.0 AS z
FROM supplier p, (SELECT unnest(range(4)) AS place)""", "lat_node")
def r2_leaves_the_box(spark, sf):
    n = table(spark, sf, "lat_node").withColumns({"velx": F.lit(0.0), "vely": F.lit(0.0)})
    top = n.agg(F.max("z")).first()[0]
    seeds = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("point_id"), F.lit(4.51).alias("x"), F.lit(6.7).alias("y"), F.lit(top + 0.05).alias("z"))
    got = trace.streamlines(seeds, table(spark, sf, "lat_cell"), n, _VELOCITY, top / 8, 200)
    return rounded(got.where("place < 4").select("point_id", "place", "x", "z"))


@query(f"SELECT 0 AS cycle_place, {_LINE} FROM l UNION ALL SELECT 1, {_LINE} FROM l2", extra=rk4_sql(_SEEDS, 0.001, 50) + ", " + rk4_sql("SELECT point_id, x, y, z FROM l WHERE place = 50", 0.001, 50, "(-1)").replace("l AS (", "l2 AS (", 1).replace("FROM l WHERE place <", "FROM l2 WHERE place <"), recursive=True)
def r3_pathlines(spark, sf):
    n = table(spark, sf, "lat_node")
    back = n.withColumns({v: -F.col(v) for v in _VELOCITY})
    return rounded(trace.pathlines(line_seeds(spark, sf), table(spark, sf, "lat_cell"), [n, back], _VELOCITY, 0.001, 50))


@query(f"SELECT {_LINE} FROM l", "lat_node", "lat_face", extra=rk4_sql("SELECT face_id AS point_id, n.x, (n.y + 0.75)::DOUBLE AS y, (n.z + 0.25)::DOUBLE AS z FROM lat_face f JOIN lat_node n ON f.n0 = n.node_id WHERE region IS NULL AND face_id < 10000000 AND i BETWEEN 3 AND 6 AND n.y BETWEEN 5 AND 8", 0.01, 5, method="rk2"), recursive=True)
def r4_surface_lines(spark, sf):
    n = table(spark, sf, "lat_node")
    f = table(spark, sf, "lat_face").where("region is null and face_id < 10000000").join(dealt(n.where("i between 3 and 6 and y between 5 and 8").select(F.col("node_id").alias("face_id"))), "face_id", "left_semi")
    return rounded(trace.surface_lines(f, n, table(spark, sf, "lat_cell"), _VELOCITY, 0.01, 5, "midpoint").select("point_id", "place", "x", "y", "z"))


@query("""SELECT i * 37 + j AS point_id, round(4.5 + (i - 39 / 2.0) * 0.3375 + 0.0, 6) + 0.0 AS x, round(6 + (j - 18.0) * 0.3375 * 0.9, 6) + 0.0 AS y, 1.0::DOUBLE AS z
FROM (SELECT unnest(range(40)) AS i), (SELECT unnest(range(37)) AS j), (SELECT max(x) FROM lat_node)""".replace("range(40)", "range(26)").replace("39 / 2.0", "25 / 2.0").replace("range(37)", "range(44)").replace("i * 37", "i * 44").replace("18.0", "43 / 2.0"), "lat_node")
def r1_spacing_grid(spark, sf):
    return rounded(trace.spacing_grid(table(spark, sf, "lat_node"), (4.5, 6, 1), (0, 0, 2), 1.0, 0.9))


# ---------------------------------------------------------------- text ingest: rendered from the views and read back


def filed(text: DataFrame) -> DataFrame:
    """Lines (line_no, text) written as text files in their order and read back by splits."""
    at = scratch.path(text.sparkSession, "text")
    text.select("line_no", "text").repartitionByRange("line_no").sortWithinPartitions("line_no").select("text").write.text(at)
    return ingest.lines(text.sparkSession, at, joined=True)


def body(df: DataFrame, order: str, text: Column, head: list[str] = (), tail: list[str] = ()) -> DataFrame:
    """Lines (line_no, text): head, a line for each row, tail."""
    out = df.select((F.col(order).cast("long") + len(head)).alias("line_no"), text.alias("text"))
    more = [(k, t) for k, t in enumerate(head)] + [(2**40 + k, t) for k, t in enumerate(tail)]
    return out.unionByName(df.sparkSession.createDataFrame(more, "line_no long, text string")) if more else out


def rendered(df: DataFrame, order: str, text: Column, head: list[str] = (), tail: list[str] = ()) -> DataFrame:
    """Lines (file, line_no, text) of one text, written and read back."""
    return filed(body(df, order, text, head, tail))


@query("SELECT node_id AS raw, x, y, z FROM lat_node", "lat_node")
def s12_bulk_data_nodes(spark, sf):
    n, c = table(spark, sf, "lat_node"), table(spark, sf, "lat_cell")
    grid = body(n, "node_id", F.concat_ws(",", F.lit("GRID"), "node_id", F.lit(""), "x", "y", "z"), ["$ nodes", "GRID,bad,,1,2"])
    hexa = c.select((F.col("cell_id") + 10**8).alias("line_no"), F.concat_ws(",", F.lit("CHEXA"), "cell_id", F.lit("1"), F.concat_ws(",", F.transform("nodes", lambda x: x.cast("string")))).alias("text"))
    nodes, _ = ingest.bulk_data(filed(grid.unionByName(hexa)))
    return nodes.select("raw", "x", "y", "z")


@query("SELECT node_id, x, y, z FROM lat_node", "lat_node")
def s13_obj_nodes(spark, sf):
    nodes, _ = ingest.obj(rendered(table(spark, sf, "lat_node"), "node_id", F.concat_ws(" ", F.lit("v"), "x", "y", "z"), ["# an object"], ["f 1/1/1 2/2/2 3/3/3"]))
    return nodes.select("node_id", "x", "y", "z")


@query("SELECT 3 * node_id + m AS node_id, x + m AS x, y, z - m AS z FROM lat_node, (SELECT unnest(range(3)) AS m)", "lat_node")
def s14_stl_nodes(spark, sf):
    n = table(spark, sf, "lat_node").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    corner = F.concat_ws(" ", F.lit("  vertex"), F.col("x") + F.col("k") - 1, "y", F.col("z") - F.col("k") + 1)
    text = F.when(F.col("k") == 0, "facet normal 0 0 1").when(F.col("k") == 4, "endfacet").otherwise(corner)
    nodes, _ = ingest.stl(rendered(n.withColumn("at", F.col("node_id") * 5 + F.col("k")), "at", text, ["solid s"], ["endsolid s"]))
    return nodes.select("node_id", "x", "y", "z")


@query("SELECT node_id AS face_id, 3 * node_id AS a, 3 * node_id + 2 AS c FROM lat_node", "lat_node")
def s14_stl_faces(spark, sf):
    n = table(spark, sf, "lat_node").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    _, faces = ingest.stl(rendered(n.withColumn("at", F.col("node_id") * 3 + F.col("k")), "at", F.concat_ws(" ", F.lit("vertex"), "x", "y", "z")))
    return faces.select(F.col("face_id").cast("long").alias("face_id"), F.get("nodes", F.lit(0)).alias("a"), F.get("nodes", F.lit(2)).alias("c"))


def temporal_collection(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of inline data: a frame for each cycle with its values; the first has the lattice's nodes as its mesh."""
    tags = lambda at, *rows: F.explode(F.array(*(F.struct((F.col("cycle").cast("long") * 10**9 + k).alias("line_no"), F.concat_ws("", *t).alias("text")) for k, t in zip(at, rows, strict=True))))
    f = table(spark, sf, "cyc_field").withColumn("value", F.round("value", 6))
    times = f.groupBy("cycle").agg(F.max("time").alias("time"))
    open_, close = "<Attribute Name='P' Center='Node'><DataItem>", "</DataItem></Attribute>"
    frames = times.select(tags([0, 10**8, 10**8 + 100], [F.lit("<Grid Name='f'><Time Value='"), "time", F.lit("'/>")], [F.lit(open_)], [F.lit(close + "</Grid>")]).alias("r")).select("r.*")
    values = f.select((F.col("cycle").cast("long") * 10**9 + 10**8 + 1 + F.col("entity_id")).alias("line_no"), F.concat_ws(" ", "value").alias("text"))
    low = times.agg(F.min("cycle").alias("cycle"))
    mesh = low.select(tags([1, 10**8 - 1], [F.lit("<Geometry GeometryType='XYZ'> <DataItem Format='XML'>")], [F.lit("</DataItem></Geometry>")]).alias("r")).select("r.*")
    nodes = table(spark, sf, "lat_node").join(F.broadcast(low)).select((F.col("cycle").cast("long") * 10**9 + 2 + F.col("node_id")).alias("line_no"), F.concat_ws(" ", "x", "y", "z").alias("text"))
    head = spark.createDataFrame([(0, "<Xdmf><Domain>"), (1, "<Grid GridType='Collection' CollectionType='Temporal'>"), (2**60, "</Grid></Domain></Xdmf>")], "line_no long, text string")
    return frames.unionByName(values).unionByName(mesh).unionByName(nodes).unionByName(head)


@query("""SELECT c.cycle - 1 AS frame, time, 'Attribute' AS item, 'P' AS name, entity_id AS place, round(value, 6) AS value FROM cyc_field c
UNION ALL SELECT 0, 0.1, 'Geometry', NULL, 3 * node_id + m, CASE m WHEN 0 THEN x WHEN 1 THEN y ELSE z END FROM lat_node, (SELECT unnest(range(3)) AS m)""", "cyc_field", "lat_node")
def s23_xdmf_values(spark, sf):
    v = ingest.xdmf_values(filed(temporal_collection(spark, sf)))
    return v.select(F.col("frame").cast("long").alias("frame"), "time", "item", "name", "place", "value")


@query("SELECT DISTINCT CAST(cycle - 1 AS BIGINT) AS frame, 0::BIGINT AS mesh_frame FROM cyc_field", "cyc_field")
def s23_mesh_frames(spark, sf):
    return ingest.xdmf_mesh_frames(ingest.xdmf_values(filed(temporal_collection(spark, sf)))).select("frame", "mesh_frame")


@query("SELECT node_id, x, y, z, pres FROM lat_node", "lat_node")
def s15_ply_nodes(spark, sf):
    n = table(spark, sf, "lat_node")
    head = ["ply", "format ascii 1.0", f"element vertex {n.count()}", "property float x", "property float y", "property float z", "property float pres", "element face 1", "property list uchar int vertex_indices", "end_header"]
    nodes, _ = ingest.ply(rendered(n, "node_id", F.concat_ws(" ", "x", "y", "z", "pres"), head, ["3 0 1 2"]))
    return nodes.select("node_id", "x", "y", "z", F.col("vars")["pres"].alias("pres"))


@query("SELECT cell_id, 12 AS cell_type, n0, n7 FROM lat_cell", "lat_cell")
def s16_comma_deck(spark, sf):
    c = table(spark, sf, "lat_cell")
    text = F.concat_ws(",", F.col("cell_id").cast("string"), F.lit("7"), F.concat_ws(",", F.transform("nodes", lambda x: x.cast("string"))))
    _, cells = ingest.comma_deck(rendered(c, "cell_id", text, ["5,1.0,2.0,3.0"]))
    return cells.select("cell_id", "cell_type", F.get("nodes", F.lit(0)).alias("n0"), F.get("nodes", F.lit(7)).alias("n7"))


@query("SELECT node_id, x, y, z * 10 AS z FROM lat_node", "lat_node")
def s17_w8_sectioned_deck(spark, sf):
    n = table(spark, sf, "lat_node")
    nodes, _ = ingest.sectioned_deck(rendered(n, "node_id", F.concat_ws(" ", "node_id", "x", "y", F.concat(F.col("z").cast("string"), F.lit("+1"))), ["title", "coordinates"], ["end"]))
    return nodes.select("node_id", "x", "y", "z")


@query("SELECT node_id, CASE WHEN i < 5 THEN pres ELSE 'NaN'::DOUBLE END AS RES1, CASE WHEN i < 5 THEN temp ELSE 'NaN'::DOUBLE END AS RES2 FROM lat_node", "lat_node")
def s18_node_results(spark, sf):
    n = table(spark, sf, "lat_node")
    return ingest.node_results(rendered(n.where("i < 5"), "node_id", F.concat_ws(" ", "node_id", "pres", "temp"), ["99999999 1 2"]), n.select("node_id"), 2)


_WIDE = "w AS (SELECT cycle, any_value(time) AS time, max(CASE WHEN entity_id = 0 THEN value END) AS a, max(CASE WHEN entity_id = 1 THEN value END) AS b FROM cyc_field GROUP BY cycle)"


def wide(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda k: F.max(F.when(F.col("entity_id") == k, F.round("value", 6)))
    return table(spark, sf, "cyc_field").groupBy("cycle").agg(F.max("time").alias("time"), pick(0).alias("a"), pick(1).alias("b"))


@query("SELECT cycle, 'PRES' AS var, 'p1' AS probe, round(a, 6) AS value FROM w UNION ALL SELECT cycle, 'PRES', 'p2', round(b, 6) FROM w UNION ALL SELECT cycle, 'TEMP', 'p1', 'NaN'::DOUBLE FROM w", "cyc_field", extra=_WIDE)
def s19_probe_table(spark, sf):
    text = rendered(wide(spark, sf), "cycle", F.concat_ws(",", "cycle", "time", "a", "b"), ["cycle,time,PRES@p1,PRES@p2,TEMP@p1"])
    return ingest.probe_table(text).select("cycle", "var", "probe", "value")


@query("SELECT cycle, 'A' AS var, round(a, 6) AS value FROM w UNION ALL SELECT cycle, 'B', 'NaN'::DOUBLE FROM w", "cyc_field", extra=_WIDE)
def s20_j26_time_series(spark, sf):
    text = rendered(wide(spark, sf), "cycle", F.concat_ws(",", "cycle", "time", "a", F.lit("oops")), ["cycle,time,A,B", "x,1,2,3"])
    return ingest.time_series(text).select("cycle", "var", "value")


@query("SELECT cycle AS block, 'PRES' AS name, round(least(a, b), 6) AS lo, round(greatest(a, b), 6) AS hi, cycle = (SELECT max(cycle) FROM w) AS current FROM w", "cyc_field", extra=_WIDE)
def s21_minmax_blocks(spark, sf):
    w = wide(spark, sf)
    text = w.select((F.col("cycle") * 10).cast("long").alias("line_no"), F.concat_ws(" ", F.lit("PRES"), "a", "b").alias("text")).unionByName(w.select((F.col("cycle") * 10 + 1).cast("long"), F.lit("/")).toDF("line_no", "text"))
    return ingest.minmax_blocks(filed(text)).drop("file")


@query("SELECT event_type AS name, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM events GROUP BY event_type")
def s22_minmax_csv(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"))
    text = rendered(e.withColumn("n", F.row_number().over(cycles.Window.orderBy("event_type"))), "n", F.concat_ws(",", "event_type", "lo", "hi"), ["var,min,max"])
    return ingest.minmax_csv(text).drop("file")


@query("SELECT CAST(cycle - 1 AS BIGINT) AS frame, CAST(entity_id AS BIGINT) AS particle_id, round(value, 6) AS x, round(value, 6) + 1 AS y, CAST(cycle AS DOUBLE) AS z FROM cyc_field", "cyc_field")
def s24_particle_frames(spark, sf):
    f = table(spark, sf, "cyc_field").withColumn("value", F.round("value", 6))
    v = F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "value"))), lambda e: e["value"])
    rows = f.groupBy("cycle").agg(v.alias("v"))
    axes = F.array(F.col("v"), F.transform("v", lambda x: x + 1), F.transform("v", lambda x: F.col("cycle").cast("double")))
    blocks = rows.select("cycle", F.posexplode(axes).alias("axis", "values")).select((F.col("cycle") * 3 + F.col("axis")).cast("long").alias("block_no"), "values")
    return ingest.particle_frames(blocks).select(F.col("frame").cast("long").alias("frame"), "particle_id", "x", "y", "z")


@query("SELECT node_id + CASE WHEN i >= 5 THEN (SELECT count(*) FROM lat_node) ELSE 0 END AS node_id, x, y, CASE WHEN i >= 5 THEN temp ELSE 'NaN'::DOUBLE END AS temp FROM lat_node", "lat_node")
def s26_merged_zones(spark, sf):
    n, c = table(spark, sf, "lat_node"), table(spark, sf, "lat_cell")
    top = n.agg(F.max("node_id")).first()[0]
    one = n.select(F.lit("a").alias("zone"), "node_id", "x", "y", "i").where(f"i < 5 or node_id = {top}")
    two = n.where("i >= 5").select(F.lit("b").alias("zone"), "node_id", "x", "y", "i", "temp")
    cells = c.where("i < 4").select(F.lit("a").alias("zone"), "cell_id", "nodes")
    nodes, _ = ingest.merge_zones(ingest.merge_fields([one, two]), cells)
    return nodes.where("zone = 'b' or i < 5").select("node_id", "x", "y", "temp")


# ---------------------------------------------------------------- monitoring


@query("SELECT cycle, var, count(*) AS n, round(min(value), 6) + 0.0 AS lo, round(max(value), 6) + 0.0 AS hi, round(avg(value), 6) + 0.0 AS mean FROM cyc_field GROUP BY cycle, var", "cyc_field")
def z1_cycle_ranges(spark, sf):
    return rounded(monitor.cycle_ranges(table(spark, sf, "cyc_field")))


@query('SELECT entity_id, var, count(*) AS n, round(sum(value), 6) + 0.0 AS "sum", round(avg(value), 6) + 0.0 AS average, round(sum(value * value), 4) + 0.0 AS square_sum FROM cyc_field GROUP BY entity_id, var', "cyc_field")
def z2_running_sums(spark, sf):
    got = monitor.running_sums(table(spark, sf, "cyc_field"))
    return got.select("entity_id", "var", "n", r6("sum"), r6("average"), (F.round("square_sum", 4) + 0.0).alias("square_sum"))


def streamed(spark: SparkSession, sf: str, how, keys: list[str]) -> DataFrame:
    """Cycles that arrive as files, three batches of them, folded by a stream into a table."""
    field = table(spark, sf, "cyc_field")
    source, target, at = (scratch.path(spark, n) for n in ("arriving", "folded", "stream"))
    field.repartitionByRange(3, "cycle").write.parquet(source)
    monitor.fold(how(monitor.arriving(spark, source, field.schema, 1)), target, at)
    return monitor.folded(spark, target, keys)


@query("SELECT cycle, var, count(*) AS n, round(min(value), 6) + 0.0 AS lo, round(max(value), 6) + 0.0 AS hi, round(avg(value), 6) + 0.0 AS mean FROM cyc_field GROUP BY cycle, var", "cyc_field")
def z1_streamed_ranges(spark, sf):
    return rounded(streamed(spark, sf, monitor.cycle_ranges, ["cycle", "var"]))


@query('SELECT entity_id, var, count(*) AS n, round(sum(value), 6) + 0.0 AS "sum", round(avg(value), 6) + 0.0 AS average, round(sum(value * value), 4) + 0.0 AS square_sum FROM cyc_field GROUP BY entity_id, var', "cyc_field")
def z2_streamed_sums(spark, sf):
    got = streamed(spark, sf, monitor.running_sums, ["entity_id", "var"])
    return got.select("entity_id", "var", "n", r6("sum"), r6("average"), (F.round("square_sum", 4) + 0.0).alias("square_sum"))


# ---------------------------------------------------------------- further look-ups and tables


@query("SELECT point_id, node_id, pres, temp FROM (SELECT s_suppkey AS point_id, s_suppkey * 3 AS node_id FROM supplier) LEFT JOIN lat_node USING (node_id)", "lat_node")
def j1_values_at(spark, sf):
    q = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") * 3).alias("node_id"))
    return topology.values_at(q, table(spark, sf, "lat_node"), "node_id", ["pres", "temp"]).select("point_id", "node_id", "pres", "temp")


@query("SELECT region AS name, array_to_string(list(face_id ORDER BY face_id), ',') AS ids FROM lat_face WHERE region IS NOT NULL GROUP BY region", "lat_face")
def j18_region_table(spark, sf):
    return topology.region_table(regions_of(spark, sf), "face_id").select("name", F.array_join("ids", ",").alias("ids"))


@query("SELECT node_id, x, y, z, pres FROM lat_node", "lat_node")
def j29_scattered(spark, sf):
    n = table(spark, sf, "lat_node")
    return topology.scattered(n, n, "node_id", "pres")


@query("SELECT cell_id, CASE WHEN i < 3 THEN 12 WHEN i < 6 THEN 13 ELSE 10 END AS cell_type, CASE WHEN i < 3 THEN 8 WHEN i < 6 THEN 6 ELSE 4 END AS n FROM lat_cell", "lat_cell")
def s31_classified(spark, sf):
    c = table(spark, sf, "lat_cell").withColumns({"family": F.when((F.col("i") >= 3) & (F.col("i") < 6), "wedge"), "dimension": F.lit(3)})
    c = c.withColumn("nodes", F.when(F.col("i") >= 6, F.slice("nodes", 1, 4)).otherwise(F.col("nodes"))).drop("cell_type")
    return topology.classify(c).select("cell_id", "cell_type", F.size("nodes").alias("n"))


@query("SELECT cell_id, least(n6, 150) AS last FROM lat_cell", "lat_cell")
def h4_clamped(spark, sf):
    return topology.clamp_nodes(table(spark, sf, "lat_cell"), 151).select("cell_id", F.get("nodes", F.lit(6)).alias("last"))


@query("SELECT node_id AS point_id FROM lat_node WHERE x > 0", "lat_node")
def f12_beside_surface(spark, sf):
    n, f = table(spark, sf, "lat_node"), filters.on_surfaces(table(spark, sf, "lat_face"), regions_of(spark, sf), ["Xmin"])
    g = topology.face_geometry(f, n)
    at = g.select("face_id", *(F.col("c" + c).alias(c) for c in "xyz"), F.abs("nx").alias("nx"), "ny", "nz")
    return filters.beside_surface(n.select(F.col("node_id").alias("point_id"), "x", "y", "z"), at).select("point_id")


@query("SELECT 0 AS slice, unnest(['area', 'flux']) AS quantity, unnest([121.5::DOUBLE, 121.5::DOUBLE]) AS value FROM (SELECT max(k) FROM lat_node)", "lat_node")
def s29_integration_table(spark, sf):
    p = slices.cut(table(spark, sf, "lat_cell"), table(spark, sf, "lat_node"), (0, 0, 0.2), (0, 0, 1), ["velx", "vely", "velz"])
    return rounded(datasets.integration_table(slices.integrate(slices.slice_triangles(p), (0, 0, 1), vector=("velx", "vely", "velz")), ["area", "flux"]))


@query("SELECT point_id, pres, node_id AS elem FROM d WHERE rank = 1", "lat_node", extra=_QUERY)
def s30_probe_output(spark, sf):
    got = nearest.nearest(query_points(spark, sf), node_sources(spark, sf), ["pres"]).withColumnRenamed("source_id", "elem")
    return datasets.probe_output(got, {"title": ["point_id"], "coords": ["x", "y", "z"], "scalar": ["pres"], "elem": ["elem"]}, ["title", "scalar", "elem"])


@query("SELECT face_id AS id, CAST(place AS INTEGER) AS place, [n0, n1, n2, n3][place + 1] AS node_id FROM lat_face, (SELECT unnest(range(4)) AS place)", "lat_face")
def j8_h1_face_nodes(spark, sf):
    return topology.face_nodes(table(spark, sf, "lat_face")).select(F.col("face_id").alias("id"), "place", "node_id")


@query("SELECT face_id, region AS name FROM lat_face WHERE region IS NOT NULL", "lat_face")
def j17_regions_of_face(spark, sf):
    return topology.regions_of_face(regions_of(spark, sf)).select("face_id", F.get("names", F.lit(0)).alias("name"))


@query("SELECT s_suppkey AS point_id, s_suppkey % 5 AS material, CASE WHEN s_suppkey % 5 IN (1, 2, 3) THEN s_suppkey % 5 - 1 ELSE -1 END AS place FROM supplier")
def j20_material_place(spark, sf):
    q = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") % 5).alias("material"))
    return topology.material_place(table(spark, sf, "lat_cell"), q).select("point_id", "material", F.col("place").cast("long").alias("place"))
