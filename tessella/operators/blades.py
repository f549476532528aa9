"""Blade surfaces: wall faces, pressure and suction sides, loading, pitch, unwrapping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.expr import NAN, cylindrical, num
from tessella.operators.bins import _bounds, bin_of
from tessella.operators.quantiles import medians

#: Words of blade region names, of regions that aren't blades, and of rotating parts.
BLADE_WORDS = ("blade", "impeller", "rotor", "vane", "foil", "wing", "翼", "叶", "blade ")
OTHER_WORDS = ("plane", "cylinder", "hub", "shroud", "casing", "frozen", "static")
ROTATING_WORDS = ("rotat", "impeller", "fan", "rotor", "turbin", "wheel", "prop")


def rotating_cells(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """Cells of the parts (part_name, cvol_id) whose name holds a rotating word (B1)."""
    word = F.lit(False)
    for w in ROTATING_WORDS:
        word = word | F.lower("part_name").contains(w)
    return cells.join(parts.where(word).select("cvol_id").distinct(), "cvol_id", "left_semi")


def wall_faces(faces: DataFrame, regions: DataFrame, cells: DataFrame, names: list[str] | None = None, parts: DataFrame | None = None) -> DataFrame:
    """Blade faces: those of the named regions; without any, of regions whose name holds a blade word and no other; without
    any, the faces between the rotating parts' cells and others (B1, U4)."""
    from tessella.operators.filters import keywords
    from tessella.operators.topology import blade_boundary

    rules = [regions.where(F.col("name").isin(names))] if names else []
    rules.append(keywords(regions, list(BLADE_WORDS), list(OTHER_WORDS)))
    if parts is not None:
        rules.append(blade_boundary(faces, rotating_cells(cells, parts)))
    table = None
    for k, r in enumerate(rules):
        one = r.select("face_id").distinct().withColumn("rule", F.lit(k))
        table = one if table is None else table.unionByName(one)
    best = table.agg(F.min("rule").alias("rule"))
    return faces.join(table.join(F.broadcast(best), "rule").select("face_id"), "face_id", "left_semi")


def circumferential_normal(x, y, nx, ny) -> Column:
    """The normal's part along the direction of growing angle about z (B2); 0 on the axis."""
    x, y = num(x), num(y)
    r = F.sqrt(x * x + y * y)
    return F.when(r < 1e-12, F.lit(0.0)).otherwise((num(ny) * x - num(nx) * y) / F.when(r < 1e-12, F.lit(1.0)).otherwise(r))


def _grid(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("span"))


def loading(surface: DataFrame, value: str, n: int, along: str = "z") -> DataFrame:
    """(span, ps, ss) of faces (x, y, z, nx, ny, nz, value): means where the circumferential normal is above and below 0, by
    bins along the span; NaN where a bin is empty, 0 belongs to neither (B3)."""
    b = _bounds(surface, _s=num(along), _n=circumferential_normal("x", "y", "nx", "ny"))
    b = b.withColumn("span", bin_of(F.col("_s"), F.col("_s_lo"), F.col("_s_hi"), n))
    g = b.groupBy("span").agg(F.avg(F.when(F.col("_n") > 0, F.col(value))).alias("ps"), F.avg(F.when(F.col("_n") < 0, F.col(value))).alias("ss"))
    return _grid(surface, n).join(g, "span", "left").na.fill(NAN, ["ps", "ss"])


def loading_of_volume(points: DataFrame, value: str, n: int, along: str = "z") -> DataFrame:
    """(span, ps, ss) of points without a wall: each bin is split at its median angle."""
    _, theta, _ = cylindrical("x", "y", "z", "z")
    b = _bounds(points.withColumn("_t", theta), _s=num(along))
    b = b.withColumn("span", bin_of(F.col("_s"), F.col("_s_lo"), F.col("_s_hi"), n))
    m = medians(b, ["span"], "_t", "m")  # n rows
    g = b.join(F.broadcast(m), "span").groupBy("span").agg(F.avg(F.when(F.col("_t") >= F.col("m"), F.col(value))).alias("ps"), F.avg(F.when(F.col("_t") < F.col("m"), F.col(value))).alias("ss"))
    return _grid(points, n).join(g, "span", "left").na.fill(NAN, ["ps", "ss"])


def loading_curve(sides: DataFrame) -> DataFrame:
    """sides with dp = ps - ss, 0 where a side is missing."""
    return sides.withColumn("dp", F.when(F.isnan("ps") | F.isnan("ss"), F.lit(0.0)).otherwise(F.col("ps") - F.col("ss")))


def pitch(points: DataFrame, theta: Column, bins: int = 720, least: int | None = None, correlation: float = 0.35) -> DataFrame:
    """(pitch): the lag of the greatest autocorrelation of the histogram of angles in 0 .. 2 pi, from least bins on (a thirty-second
    of them, four at least), if it is over a bound, else 2 pi (B6).

    The correlation isn't circular: what a lag moves beyond the last bin meets nothing. Angles out of range don't count; under
    four angles and equal counts have no pitch; of equal lags the least is taken."""
    turn, least = 2 * math.pi, max(4, bins // 32) if least is None else least
    t = points.select(theta.alias("t"))
    every = t.agg(F.count("t").alias("all"))
    h = t.where((F.col("t") >= 0) & (F.col("t") <= turn)).groupBy(F.least(F.lit(bins - 1), F.floor(F.col("t") / F.lit(turn) * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    one = h.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m")).join(every)  # bins, not points
    row = one.select("all", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)).cast("double")).alias("h"))
    row = row.withColumn("mean", F.aggregate("h", F.lit(0.0), lambda s, x: s + x) / bins).select("all", F.transform("h", lambda x: x - F.col("mean")).alias("h"))
    power = F.aggregate("h", F.lit(0.0), lambda s, x: s + x * x)
    lag = row.withColumn("p", power).withColumn("lag", F.explode(F.sequence(F.lit(least), F.lit(bins - 1))))
    moved = F.zip_with(F.slice("h", F.lit(1), F.lit(bins) - F.col("lag")), F.slice("h", F.col("lag") + 1, F.lit(bins) - F.col("lag")), lambda a, b: a * b)
    c = lag.select("all", "p", "lag", (F.aggregate(moved, F.lit(0.0), lambda s, x: s + x) / F.when(F.col("p") > 0, F.col("p"))).alias("r"))
    best = c.agg(F.max_by("lag", F.struct(F.round("r", 12), -F.col("lag"))).alias("lag"), F.max("r").alias("r"), F.first("all").alias("all"), F.first("p").alias("p"))
    ok = (F.col("all") >= 4) & (F.sqrt("p") >= 1e-12) & (F.col("r") > correlation)
    return best.select(F.when(ok, F.col("lag") * F.lit(turn / bins)).otherwise(F.lit(turn)).alias("pitch"))


def unwrapped(points: DataFrame, pitch_: float, copies: int) -> DataFrame:
    """points with arc (radius times the angle within one pitch, a copy for each) and height."""
    r, theta, h = cylindrical("x", "y", "z", "z")
    out = points.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return out.withColumns({"arc": r * (F.pmod(theta, F.lit(float(pitch_))) + F.col("copy") * F.lit(float(pitch_))), "height": h})
