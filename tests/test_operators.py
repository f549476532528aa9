"""Operators on small synthetic inputs."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import expr
from tessella.operators import bins, blades, calculus, cycles, filters, modal, nearest, slices, topology
from tessella.sources import datasets, ingest
from tessella.streaming import monitor


def text(spark, *lines):
    return spark.createDataFrame([("f", k, t) for k, t in enumerate(lines)], "file string, line_no long, text string")


def hexes(spark):
    nodes = spark.createDataFrame([(k, float(k % 3), float(k // 3 % 2), float(k // 6)) for k in range(12)], "node_id long, x double, y double, z double")
    cells = spark.createDataFrame([(c, 12, [c, c + 1, c + 4, c + 3, c + 6, c + 7, c + 10, c + 9]) for c in (0, 1)], "cell_id long, cell_type int, nodes array<long>")
    return nodes, cells


def test_gradient_of_x_is_one_on_the_middle_plane(spark):
    nodes, cells = hexes(spark)
    g = calculus.node_gradient(cells, nodes.withColumn("f", F.col("x")), ["f"])
    assert {r["node_id"]: r["df_dx"] for r in g.collect()} == {k: 1.0 if k % 3 == 1 else 0.0 for k in range(12)}


def test_bad_meshes_are_errors(spark):
    nodes, cells = hexes(spark)
    topology.check_mesh(nodes, cells)
    for bad in (cells.limit(0), cells.withColumn("cell_type", F.lit(3)), cells.withColumn("nodes", F.slice("nodes", 1, 7)), cells.withColumn("nodes", F.transform("nodes", lambda n: n + 99))):
        with pytest.raises(ValueError):
            topology.check_mesh(nodes, bad)


def test_new_variables_need_new_identifiers(spark):
    df = spark.range(1).withColumn("a", F.lit(1.0))
    for name in ("a", "1x", "x y"):
        with pytest.raises(ValueError):
            expr.add_variable(df, name, F.lit(1.0))
    v = expr.add_variable(df, "v", F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z")))
    assert expr.delete_variable(v, "v").columns == df.columns


def test_division_and_logarithm_by_ieee_rules(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0)], "a double, b double")
    got = [r[0] for r in rows.select(expr.div("a", "b")).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3] == 2.0
    assert math.isnan(rows.select(expr.log(F.lit(-1.0))).first()[0])


def test_idw_midpoint_and_exact_hit(spark):
    src = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0, 10.0)], "source_id long, x double, y double, z double, v double")
    q = spark.createDataFrame([(1, 0.5, 0.0, 0.0), (2, 1.0, 0.0, 0.0)], "point_id long, x double, y double, z double")
    assert {r["point_id"]: r["v"] for r in nearest.idw(q, src, "v").collect()} == {1: 5.0, 2: 10.0}
    assert nearest.knn(q, src.limit(0), 1).count() == 0


def test_pitch_of_four_blades(spark):
    t = spark.range(1200).select((F.pmod(F.col("id"), F.lit(4)) * math.pi / 2 + 0.3 + F.randn(3) * 0.02).alias("t"))
    assert abs(blades.pitch(t, F.col("t")).first()[0] - math.pi / 2) < 0.05


def test_pod_reconstructs_and_clusters_split(spark):
    rows = [(c, e, math.sin(c) * e + math.cos(2 * c) * (e % 3)) for c in range(6) for e in range(20)]
    s = spark.createDataFrame(rows, "cycle int, entity_id long, value double")
    coefficients, fields = modal.pod(s, 6)
    mean = s.groupBy("entity_id").agg(F.avg("value").alias("m"))
    back = coefficients.join(fields, "mode").groupBy("cycle", "entity_id").agg(F.sum(F.col("t") * F.col("value")).alias("v")).join(mean, "entity_id").join(s, ["cycle", "entity_id"])
    assert back.agg(F.max(F.abs(F.col("v") + F.col("m") - F.col("value")))).first()[0] < 1e-9
    points = [(0, 0.0, 0.0), (1, 0.1, 0.0), (2, 0.0, 0.1), (3, 9.0, 9.0), (4, 9.1, 9.0), (5, 9.0, 9.1)]
    s = spark.createDataFrame([(c, k, v) for c, *p in points for k, v in enumerate(p)], "cycle int, entity_id long, value double")
    labels, _ = modal.kmeans(s, 2, [0, 3])
    assert sorted(r["size"] for r in modal.cluster_sizes(labels).collect()) == [3, 3]


def test_cycles_as_of_and_ordinal(spark):
    c = spark.createDataFrame([("a", k, float(k)) for k in (1, 2, 3)] + [("b", k, float(k)) for k in (10, 100, 200)], "series_id string, cycle int, time double")
    q = spark.createDataFrame([(2,)], "asked int")
    assert {(r["series_id"], r["cycle"]) for r in cycles.as_of(c, q).collect()} == {("a", 2), ("b", 10)}
    assert {(r["series_id"], r["cycle"]) for r in cycles.by_ordinal(c, q).collect()} == {("a", 3), ("b", 200)}


def test_decks(spark):
    nodes, cells = ingest.bulk_data(text(spark, "$ c", "GRID,7,,0,0,0", "GRID,8,,1,0,0", "GRID,9,,0,1,0", "GRID,10,,0,0,1", "GRID,11,,5,5,5", "GRID,bad", "CTETRA,1,1,10,7,8,9", "CTETRA,2,1,7,8,9,99"))
    assert {(r["raw"], r["node_id"]) for r in nodes.collect()} == {(10, 0), (7, 1), (8, 2), (9, 3)}
    assert [(r["cell_type"], r["nodes"]) for r in cells.collect()] == [(10, [0, 1, 2, 3])]
    n, f = ingest.obj(text(spark, "v 0 0 0", "v 1 0 0", "v 0 1 0", "f 1/2/3 2 3"))
    assert n.count() == 3 and f.first()["nodes"] == [0, 1, 2]
    n, f = ingest.stl(text(spark, "solid", "facet", "vertex 0 0 0", "vertex 1 0 0", "vertex 0 1 0", "endfacet"))
    assert f.first()["nodes"] == [0, 1, 2]
    assert [r[0] for r in spark.createDataFrame([("2.5+1",), ("1.0D-3",), ("x",)], "s string").select(ingest.marc_float(F.col("s"))).collect()] == [25.0, 0.001, None]


def test_particle_frames(spark):
    blocks = spark.createDataFrame([(k, [float(k), float(k)]) for k in range(5)], "block_no long, values array<double>")
    assert ingest.particle_frames(blocks).select("frame").distinct().count() == 1


def test_xdmf(spark, tmp_path):
    grid = "<Grid Name='{}'>{}<Attribute Name='P' Center='Node'><DataItem>1 2 3</DataItem></Attribute></Grid>"
    mesh = "<Topology TopologyType='Triangle'><DataItem>0 1 2</DataItem></Topology><Geometry><DataItem>0 0 0 1 0 0 0 1 0</DataItem></Geometry>"
    (tmp_path / "a.xdmf").write_text(f"<Xdmf><Domain><Grid GridType='Collection'>{grid.format('a', mesh)}{grid.format('b', '')}</Grid></Domain></Xdmf>")
    rows = ingest.xdmf(spark, str(tmp_path)).orderBy("frame").collect()
    assert [(r["frame"], r["time"], r["mesh_frame"], r["values"]) for r in rows] == [(0, 0.0, 0, [1.0, 2.0, 3.0]), (1, 1.0, 0, [1.0, 2.0, 3.0])]


def test_streams_give_what_batches_give(spark, sf_dir, tmp_path):
    from tessella.plans.views import table

    field = table(spark, sf_dir, "cyc_field")
    field.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = monitor.cycle_ranges(monitor.arriving(spark, str(tmp_path / "in"), field.schema))
    got = monitor.run_available(stream, "ranges", str(tmp_path / "cp"))
    key = lambda df: sorted((r["cycle"], r["var"], r["n"], round(r["mean"], 9)) for r in df.collect())
    assert key(got) == key(monitor.cycle_ranges(field))


def test_slices_of_nothing_and_of_a_diagonal(spark):
    nodes, cells = hexes(spark)
    cut = lambda o, n: slices.integrate(slices.slice_triangles(slices.cut(cells, nodes, o, n, []))).collect()
    assert cut((0, 0, 9), (0, 0, 1)) == []
    assert abs(cut((1, 0, 0.5), (1, 0, 1))[0]["area"] - math.sqrt(2)) < 1e-9


def test_series_and_bins_of_equal_values(spark):
    files = spark.createDataFrame([("r/a_2.x",), ("r/a_10.x",), ("r/b_1.x",)], "path string")
    assert [r["cycle"] for r in datasets.scan_series(files, "r/a_1.x").orderBy("ord").collect()] == [2, 10]
    one = spark.createDataFrame([(1.0, 5.0), (1.0, 7.0)], "x double, v double")
    assert [r["value"] for r in bins.profile(one, "x", "v", 3).orderBy("bin").collect()][2] == 6.0
    assert filters.id_ranges("1-5,9;11,x") == [(1, 5), (9, 9), (11, 11)]
