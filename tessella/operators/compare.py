"""Comparison of two datasets: differences on one mesh or after remapping, statistics, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import nearest


def combine(a: Column, b: Column, how: str = "abs") -> Column:
    """abs: |a - b|; signed: a - b; relative: (a - b) / (|a| + 1e-30)."""
    d = a - b
    return {"abs": F.abs(d), "signed": d, "relative": d / (F.abs(a) + F.lit(1e-30))}[how]


def common_variables(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name): variables of both catalogs (name), once each."""
    return a.select("name").intersect(b.select("name"))


def difference(a: DataFrame, b: DataFrame, key: str, var: str, how: str = "abs") -> DataFrame:
    """(key, value) of two datasets on one mesh."""
    return a.select(key, F.col(var).alias("a")).join(b.select(key, F.col(var).alias("b")), key).select(key, combine(F.col("a"), F.col("b"), how).alias("value"))


def difference_remapped(a: DataFrame, b: DataFrame, var: str, how: str = "abs", method: str = "nearest") -> DataFrame:
    """(point_id, value) at a's points (point_id, x, y, z, var); b (source_id, x, y, z, var) is remapped first."""
    if method == "nearest":
        got = nearest.knn(a, b, 1).select("point_id", "source_id").join(b.select("source_id", F.col(var).alias("b")), "source_id").select("point_id", "b")
    else:
        got = nearest.idw(a, b, var).withColumnRenamed(var, "b")
    return a.select("point_id", F.col(var).alias("a")).join(got, "point_id").select("point_id", combine(F.col("a"), F.col("b"), how).alias("value"))


def statistics(df: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """(n, lo, hi, mean, rms): n counts all rows, the others finite values, 0 if there are none."""
    v = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), zero(F.min(v)).alias("lo"), zero(F.max(v)).alias("hi"), zero(F.avg(v)).alias("mean"), zero(F.sqrt(F.avg(v * v))).alias("rms"))


def summary(a: DataFrame, b: DataFrame, key: str, how: str = "abs") -> DataFrame:
    """Statistics of every variable that both wide tables have (D3)."""
    shared = sorted(set(a.columns) & set(b.columns) - {key, "ds_id", "x", "y", "z"})
    number = {f.name for f in a.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long")}
    shared = [c for c in shared if c in number]
    long_ = lambda df, n: df.select(key, *(F.col(c).cast("double").alias(c) for c in shared)).unpivot([key], shared, "var", n)
    j = long_(a, "a").join(long_(b, "b"), [key, "var"]).withColumn("value", combine(F.col("a"), F.col("b"), how))
    return statistics(j, "value", ["var"])


def difference_dataset(a: DataFrame, b: DataFrame, key: str, names: list[str], how: str = "abs", ds_id: str = "diff") -> DataFrame:
    """A new dataset of the differences of several variables."""
    j = a.select(key, *(F.col(n).alias("a_" + n) for n in names)).join(b.select(key, *(F.col(n).alias("b_" + n) for n in names)), key)
    return j.select(F.lit(ds_id).alias("ds_id"), key, *(combine(F.col("a_" + n), F.col("b_" + n), how).alias(n) for n in names))
