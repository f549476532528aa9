"""Tables of the mesh's size aren't broadcast, and aggregates don't gather them before they are dealt out."""

import pytest
from pyspark.sql import functions as F

from tessella import catalog
from tessella.operators import cycles, topology

#: Two hexahedra, a wedge and a tetrahedron on a face; cells 1 and 2 share a face, and cell 7 has that face too.
NODES = [(k, float(k % 2), float(k // 2 % 2), float(k // 4)) for k in range(12)]
HEXES = [(1, 12, [0, 1, 3, 2, 4, 5, 7, 6]), (2, 12, [4, 5, 7, 6, 8, 9, 11, 10]), (7, 12, [4, 5, 7, 6, 20, 21, 23, 22]), (8, 10, [0, 1, 3, 8])]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a11_cell_volumes", "a11_polyhedron_volumes", "j2_j3_counts_of_cells", "j3_j6_across_cell_face", "s29_integration_table", "u5_g2_exterior_faces", "g6_boundary_line", "j6_across_local_face", "a10_a12_face_geometry", "a9_cell_centres"])
def test_no_broadcast(spark, sf_dir, name):
    assert "BroadcastHashJoin" not in plan(catalog.QUERIES[name](spark, sf_dir))


def cells(spark):
    return spark.createDataFrame(HEXES, "cell_id long, cell_type int, nodes array<long>")


def test_cells_across_a_face_of_three_cells(spark):
    c = cells(spark)
    q = c.select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("local"))
    faces = {}
    for cell, kind, nodes in HEXES:
        for k, f in enumerate(topology.FACES[kind]):
            faces[cell, k] = frozenset(nodes[i] for i in f)
    want = {(cell, k): min((o for (o, _), f in faces.items() if o != cell and f == faces.get((cell, k))), default=-1) for cell, _, _ in HEXES for k in range(7)}
    assert {(r["cell_id"], r["local"]): r["other"] for r in topology.across_cell_faces(q, c).collect()} == want
    exterior = {(r["cell_id"], r["local"]): r["nodes"] for r in topology.exterior_faces(c).collect()}
    one = {k for k, f in faces.items() if sum(f == g for g in faces.values()) == 1}
    corners = {cell: (kind, nodes) for cell, kind, nodes in HEXES}
    assert exterior == {(c, k): [corners[c][1][i] for i in topology.FACES[corners[c][0]][k]] for c, k in one}


def test_volumes_without_some_nodes(spark):
    nodes = spark.createDataFrame(NODES, "node_id long, x double, y double, z double")
    got = {r["cell_id"]: round(r["volume"], 9) for r in topology.cell_volumes(cells(spark), nodes).collect()}
    # of cell 7 four corners are known, whose mean lies in their face; the pyramids over the others aren't
    assert got == {1: 1.0, 2: 1.0, 7: 0.0, 8: round(1 / 3, 9)}
    faces = topology.cell_faces(cells(spark)).where("cell_id < 7").select((F.col("cell_id") * 10 + F.col("local")).alias("face_id"), F.col("cell_id").alias("owner"), F.lit(None).cast("long").alias("neighbour"), "nodes")
    assert {r["cell_id"]: round(r["volume"], 9) for r in topology.cell_volumes(cells(spark), nodes, faces).collect()} == {1: 1.0, 2: 1.0}
    assert {tuple(r) for r in topology.polyhedron_nodes(faces).collect()} == {(c, n) for c, _, ns in HEXES[:2] for n in ns}


def test_counts_come_after_the_exchange(spark):
    """Before the exchange an aggregate would hold all rows of an input split, whatever that has."""
    for df, keys in ((topology.exterior_faces(cells(spark)), "key"), (topology.polyhedron_nodes(topology.cell_faces(cells(spark)).select(F.col("local").cast("long").alias("face_id"), F.col("cell_id").alias("owner"), F.lit(None).cast("long").alias("neighbour"), "nodes")), "cell_id")):
        p = plan(df)
        assert p.count("Exchange") == 1 and "SortAggregate" not in p and p.rindex("Aggregate") < p.index("Exchange"), keys


def test_one_expression_on_every_cycle_after_the_exchange(spark):
    field = spark.createDataFrame([("s", c, e, v, float(c + e)) for c in (1, 2) for e in range(3) for v in ("a", "b", f"only{c}")], "series_id string, cycle int, entity_id long, var string, value double")
    out = cycles.on_every_cycle(field, "sum", ["a", "b"], F.col("a") + F.col("b"))
    p = plan(out)
    assert p.count("Exchange") == 1 and p.rindex("Aggregate") < p.index("Exchange")
    assert {(r["cycle"], r["entity_id"]): r["value"] for r in out.collect()} == {(c, e): 2.0 * (c + e) for c in (1, 2) for e in range(3)}


def test_local_faces_join_once(spark, sf_dir):
    assert plan(catalog.QUERIES["j6_across_local_face"](spark, sf_dir)).count("Join") == 1
