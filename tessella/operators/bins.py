"""Binned profiles and maps, weighted means: circumferential, polar, blade-to-blade, along an axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.expr import NAN, cylindrical, magnitude, num


def bin_of(value: Column, lo: Column, hi: Column, n: int) -> Column:
    """0-based bin of equal width; the greatest value is in the last one, as is all if lo = hi."""
    width = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    return F.when(hi > lo, F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((value - lo) / width * n)))).otherwise(F.lit(n - 1)).cast("int")


def _bounds(df: DataFrame, **columns: Column) -> DataFrame:
    """df joined with one row of the least and greatest of some columns."""
    named = df.withColumns(columns)
    ends = named.agg(*(f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))))
    return named.join(F.broadcast(ends))  # one row


def profile(df: DataFrame, along: Column | str, value: Column | str, n: int) -> DataFrame:
    """(bin, centre, value): the plain mean in n bins along a coordinate, NaN where a bin is empty."""
    b = _bounds(df, _c=num(along), _v=num(value))
    got = b.withColumn("bin", bin_of(F.col("_c"), F.col("_c_lo"), F.col("_c_hi"), n)).groupBy("bin").agg(F.avg("_v").alias("value"))
    ends = df.agg(F.min(num(along)).alias("lo"), F.max(num(along)).alias("hi"))
    grid = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(ends))
    return grid.join(got, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / n).alias("centre"), F.coalesce("value", F.lit(NAN)).alias("value"))


def binned(df: DataFrame, x: Column | str, y: Column | str, value: Column | str, nx: int, ny: int, weight: Column | None = None) -> DataFrame:
    """(xbin, ybin, n, value): the (weighted) mean in nx x ny bins, every bin given, empty ones NaN."""
    b = _bounds(df.withColumns({"_v": num(value), "_w": num(weight) if weight is not None else F.lit(1.0)}), _x=num(x), _y=num(y))
    b = b.withColumns({"xbin": bin_of(F.col("_x"), F.col("_x_lo"), F.col("_x_hi"), nx), "ybin": bin_of(F.col("_y"), F.col("_y_lo"), F.col("_y_hi"), ny)})
    got = b.groupBy("xbin", "ybin").agg(F.count("*").alias("n"), F.sum(F.col("_v") * F.col("_w")).alias("s"), F.sum("_w").alias("w"), F.avg("_v").alias("m"))
    grid = df.sparkSession.range(nx * ny).select((F.col("id") % nx).cast("int").alias("xbin"), F.floor(F.col("id") / nx).cast("int").alias("ybin"))
    mean = F.when(F.abs("w") < 1e-12, F.col("m")).otherwise(F.col("s") / F.when(F.abs("w") < 1e-12, F.lit(1.0)).otherwise(F.col("w")))
    return grid.join(got, ["xbin", "ybin"], "left").select("xbin", "ybin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(mean, F.lit(NAN)).alias("value"))


def circumferential_average(df: DataFrame, value: str, nr: int, nz: int, axis: str = "z", weight: Column | None = None) -> DataFrame:
    """Mean over the angle onto bins of radius (xbin) and height (ybin) (A17); weighted by density times speed."""
    r, _, h = cylindrical("x", "y", "z", axis)
    return binned(df, r, h, value, nr, nz, weight)


def mass_weight(density: str, vector=("velx", "vely", "velz")) -> Column:
    """density |V|."""
    return num(density) * magnitude(*vector)


def mass_flow_average(df: DataFrame, value: str, density: str, axial: str) -> DataFrame:
    """(average): sum of density |V axial| value over that of density |V axial|; the plain mean if that is under 1e-12."""
    w = num(density) * F.abs(num(axial))
    t = df.agg(F.sum(w * num(value)).alias("s"), F.sum(w).alias("w"), F.avg(num(value)).alias("m"))
    return t.select(F.when(F.abs("w") < 1e-12, F.col("m")).otherwise(F.col("s") / F.when(F.abs("w") < 1e-12, F.lit(1.0)).otherwise(F.col("w"))).alias("average"))


def polar_map(df: DataFrame, value: str, nr: int, nt: int, axis: str = "z") -> DataFrame:
    """Mean in bins of radius and angle."""
    r, theta, _ = cylindrical("x", "y", "z", axis)
    return binned(df, r, theta, value, nr, nt)


def blade_to_blade_map(df: DataFrame, value: str, radius: float, tolerance: float, nx: int, ny: int, axis: str = "z") -> DataFrame:
    """Mean in bins of arc and height near a radius."""
    from tessella.operators.filters import near_radius

    return binned(near_radius(df, radius, tolerance, axis), "arc", "height", value, nx, ny)
