"""Families of cuts, medians, CSR structures, cycle expressions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import blades, cycles, quantiles, slices, topology


def test_medians_by_closing_in(spark):
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 1)) for _ in range(501)] + [("b", float(rng.choice([1, 2, 2, 3]))) for _ in range(400)] + [("c", 10.0 ** rng.uniform(-300, 300)) for _ in range(200)]
    rows += [("d", 7.0), ("e", 1.0), ("e", 2.0), ("f", None), ("g", float("nan")), ("g", -1e308), ("g", 1e308), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    want = {r["g"]: r["m"] for r in df.where("v is not null and not isnan(v)").groupBy("g").agg(F.median("v").alias("m")).collect() if r["g"] is not None}
    for few in (20,):
        got = {r["g"]: r["median"] for r in quantiles.medians(df, ["g"], "v", edges=8, few=few).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[g], want[g], rel_tol=1e-15, abs_tol=1e-300) for g in want), few
    plan = quantiles.medians(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower() and "collect" not in plan.lower()


def test_slices_of_an_array(spark, monkeypatch):
    monkeypatch.setattr(topology.prefix, "CHUNK", 4)
    values = spark.createDataFrame([(p, p * p) for p in range(40)], "position long, value long").repartition(3)
    cuts = [("a", 0, 3), ("b", 3, 3), ("c", 3, 30), ("d", 33, 40)]
    got = topology.slices(values, spark.createDataFrame(cuts, "id string, start long, stop long"))
    assert sorted(map(tuple, got.collect())) == [(i, p - a, p * p) for i, a, b in cuts for p in range(a, b)]
    assert "Broadcast" not in got._jdf.queryExecution().optimizedPlan().toString()
    for bad in ([("a", 0, 9), ("b", 5, 7)], [("a", 0, 9), ("b", 0, 9)], [("a", 0, 30), ("b", 29, 31)]):
        with pytest.raises(ValueError):
            topology.slices(values, spark.createDataFrame(bad, "id string, start long, stop long"))


def test_faces_grouped_by_cell(spark):
    pairs = spark.createDataFrame([(c, f, k) for k, (c, f) in enumerate([(2, 5), (0, 9), (2, 1), (-1, 3), (7, 4), (0, 9)])], "cell_id long, face_id long, place long")
    values, offsets = topology.grouped_faces(pairs, 5)
    assert [r["face_id"] for r in values.orderBy("position").collect()] == [9, 9, 5, 1]
    assert sorted(map(tuple, offsets.collect())) == [(0, 0, 2), (2, 2, 4)]


def lattice(spark, n=4):
    nodes = spark.createDataFrame([((k * n + j) * n + i, i + 0.2 * j, j + 0.1 * k, float(k)) for k in range(n) for j in range(n) for i in range(n)], "node_id long, x double, y double, z double")
    return nodes, topology.structured_cells(spark, n, n, n)


def test_many_planes_are_each_plane(spark):
    nodes, cells = lattice(spark)
    rows = [(k, 0.37 * k, 0.2, 0.11 * k, *((0.0, 0.0, 1.0) if k % 2 else (math.sqrt(0.5), math.sqrt(0.5), 0.0))) for k in range(14)]
    planes = spark.createDataFrame(rows, "slice int, ox double, oy double, oz double, nx double, ny double, nz double")
    moved = slices.moving_cut(cells, nodes, planes, [])
    assert moved._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = {r["slice"]: r["area"] for r in slices.integrate(slices.slice_triangles(moved)).collect()}
    for k, *p in rows[2:9:3]:
        one = slices.integrate(slices.slice_triangles(slices.cut(cells, nodes, p[:3], p[3:], []))).collect()
        assert math.isclose(got.get(k, 0.0), one[0]["area"] if one else 0.0, abs_tol=1e-12), k


def test_levels_by_bisection(spark):
    nodes, cells = lattice(spark)
    nodes = nodes.withColumn("f", F.col("x") + F.col("z"))
    at = [2.5, 99.0, 0.1, 2.5]
    polys = slices.isosurfaces(cells, nodes, "f", at, [])
    assert polys._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = {r["slice"]: (r["n"], round(r["area"], 9)) for r in slices.integrate(slices.slice_triangles(polys)).join(polys.groupBy("slice").agg(F.count("*").alias("n")), "slice").collect()}
    for k, v in enumerate(at):
        one = slices.cut_where(cells, nodes, F.col("f") - v, [])
        area = slices.integrate(slices.slice_triangles(one)).collect()
        assert got.get(k) == ((one.count(), round(area[0]["area"], 9)) if area else None), k


def test_a_disk_is_round(spark):
    nodes, cells = lattice(spark, 12)
    p = slices.disk(cells, nodes, (6.0, 5.0, 4.5), (0, 0, 1), 3.0, [])
    area = slices.integrate(slices.slice_triangles(p)).first()["area"]
    assert 0.9 * math.pi * 9 < area < math.pi * 9


def test_expressions_on_every_cycle_or_none(spark):
    rows = [("s", c, e, v, float(c + e)) for c in (1, 2) for e in (0, 1) for v in ("a", "b")] + [("s", 2, 0, "c", 1.0)]
    kind = "series_id string, cycle int, entity_id long, var string, value double"
    df = spark.createDataFrame(rows, kind)
    got = cycles.on_every_cycle(df, "sum", ["a", "b"], F.col("a") + F.col("b"))
    assert sorted((r["cycle"], r["entity_id"], r["value"]) for r in got.collect()) == [(c, e, 2.0 * (c + e)) for c in (1, 2) for e in (0, 1)]
    for more, needed, name in (([("s", 3, 0, "a", 1.0)], ["a", "b"], "sum"), ([("t", 1, 0, "c", 1.0)], ["a", "b"], "sum"), ([], ["a", "c"], "sum"), ([], ["a", "b"], "c"), ([("s", 2, 5, "a", 1.0)], ["a", "b"], "sum")):
        with pytest.raises(ValueError):
            cycles.on_every_cycle(spark.createDataFrame(rows + more, kind), name, needed, F.col(needed[0]) + F.col(needed[1]))
    one, two = spark.range(3).withColumn("a", F.lit(1.0)), spark.range(2).withColumns({"a": F.lit(2.0), "z": F.lit(0.0)})
    made = cycles.on_every_member([(1, one), (2, two)], "twice", F.col("a") * 2)
    assert [df.agg(F.sum("twice")).first()[0] for _, df in made] == [6.0, 8.0]
    for value, name in ((F.col("z") * 2, "q"), (F.col("a"), "z"), (F.when(F.col("id") < 2, F.col("a")), "q")):
        with pytest.raises(ValueError):
            cycles.on_every_member([(1, one), (2, two)], name, value)


def test_pitch_isn_t_circular(spark):
    t = spark.range(4000).select((F.col("id") % 2 * 3.0 + 0.1).alias("t"))
    lag = round(3.0 * 720 / (2 * math.pi))
    assert abs(blades.pitch(t, F.col("t")).first()[0] - lag * 2 * math.pi / 720) < 0.02
    assert blades.pitch(t.limit(3), F.col("t")).first()[0] == 2 * math.pi
