"""Gradient, divergence and rotation over mesh adjacency: one pass over neighbours for all axes and variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.joins import dealt

AXES = "xyz"


def _differences(pairs: DataFrame, key: str, names: list[str], lateral: bool) -> DataFrame:
    """(key, d<name>_d<axis>): of the neighbours, the closest on each side of an axis; their difference quotient, 0 where a
    side is missing or they are within 1e-12. Ties go to the lowest id. lateral: only neighbours nearer across than along."""
    found = {}
    for a in AXES:
        step = F.col("o" + a) - F.col(a)
        near = F.lit(True)
        if lateral:
            across = sum(((F.col("o" + b) - F.col(b)) * (F.col("o" + b) - F.col(b)) for b in AXES if b != a), F.lit(0.0))
            near = F.sqrt(across) < F.abs(step)
        value = F.struct(F.col("o" + a).alias("at"), *(F.col("o_" + n).alias(n) for n in names))
        found[a + "1"] = F.min_by(value, F.when((step > 0) & near, F.struct(step.alias("d"), F.col("other")))).alias(a + "1")
        found[a + "0"] = F.min_by(value, F.when((step < 0) & near, F.struct((-step).alias("d"), F.col("other")))).alias(a + "0")
    g = pairs.groupBy(key).agg(*found.values())
    out = []
    for n in names:
        for a in AXES:
            gap = F.col(f"{a}1.at") - F.col(f"{a}0.at")
            out.append(F.when(gap.isNull() | (F.abs(gap) <= 1e-12), F.lit(0.0)).otherwise((F.col(f"{a}1.{n}") - F.col(f"{a}0.{n}")) / F.when(F.abs(gap) <= 1e-12, F.lit(1.0)).otherwise(gap)).alias(f"d{n}_d{a}"))
    return g.select(key, *out)


def node_gradient(cells: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """(node_id, d<name>_dx, ...): gradients of node fields by edge neighbours (C1, C3); nodes without neighbours have 0."""
    from tessella.operators.topology import node_neighbours

    other = nodes.select(F.col("node_id").alias("other"), *(F.col(a).alias("o" + a) for a in AXES), *(F.col(n).alias("o_" + n) for n in names))
    pairs = node_neighbours(cells).join(dealt(nodes.select("node_id", *AXES)), "node_id").join(dealt(other), "other")
    return dealt(nodes.select("node_id")).join(_differences(pairs, "node_id", names, False), "node_id", "left").na.fill(0.0)


def cell_gradient(faces: DataFrame, centres: DataFrame, names: list[str]) -> DataFrame:
    """(cell_id, d<name>_dx, ...): gradients of cell fields by face neighbours (C2); centres: (cell_id, x, y, z, names...)."""
    from tessella.operators.topology import adjacent_cells

    other = centres.select(F.col("cell_id").alias("other"), *(F.col(a).alias("o" + a) for a in AXES), *(F.col(n).alias("o_" + n) for n in names))
    pairs = adjacent_cells(faces).join(dealt(centres.select("cell_id", *AXES)), "cell_id").join(dealt(other), "other")
    return dealt(centres.select("cell_id")).join(_differences(pairs, "cell_id", names, True), "cell_id", "left").na.fill(0.0)


def divergence(u: str, v: str, w: str) -> Column:
    """Divergence from the columns of a gradient (C4)."""
    return F.col(f"d{u}_dx") + F.col(f"d{v}_dy") + F.col(f"d{w}_dz")


def rotation(u: str, v: str, w: str, reference_sign: bool = False) -> tuple[Column, Column, Column]:
    """The curl from the columns of a gradient (C5); reference_sign gives its negative, as one form of the operator does."""
    d = lambda n, a: F.col(f"d{n}_d{a}")
    parts = (d(w, "y") - d(v, "z"), d(u, "z") - d(w, "x"), d(v, "x") - d(u, "y"))
    return tuple(-p for p in parts) if reference_sign else parts
