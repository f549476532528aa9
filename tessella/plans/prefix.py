"""Values carried forward and running sums in an order, in two steps: within chunks of a place, then over the chunks.

Rows have a number, place, in groups named by columns; a window sorts one chunk's rows, another one row a chunk, so a group of
any size is many tasks' work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a chunk.
CHUNK = 1 << 16


def _chunked(df: DataFrame, place: str, chunk: int | None) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(place) / (chunk or CHUNK)))


def _windows(by: list[str], place: str) -> tuple:
    upto = Window.partitionBy(*by, "_chunk").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return upto, Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def carried(df: DataFrame, value: str, name: str, by: list[str], place: str, chunk: int | None = None) -> DataFrame:
    """df with the last value that isn't NULL up to each place of its group."""
    upto, before = _windows(by, place)
    df = _chunked(df, place, chunk)
    last = df.groupBy(*by, "_chunk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(place))).alias("_v"))
    into = last.select(*by, "_chunk", F.last("_v", ignorenulls=True).over(before).alias("_into"))
    out = df.withColumn(name, F.last(value, ignorenulls=True).over(upto)).join(into, [*by, "_chunk"])
    return out.withColumn(name, F.coalesce(name, "_into")).drop("_chunk", "_into")


def counted(df: DataFrame, many: Column, name: str, by: list[str], place: str, chunk: int | None = None) -> DataFrame:
    """df with the sum of a number up to each place of its group, itself included."""
    upto, before = _windows(by, place)
    df = _chunked(df, place, chunk).withColumn("_many", many.cast("long"))
    sums = df.groupBy(*by, "_chunk").agg(F.sum("_many").alias("_v"))
    into = sums.select(*by, "_chunk", F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_into"))
    out = df.withColumn(name, F.sum("_many").over(upto)).join(into, [*by, "_chunk"])
    return out.withColumn(name, F.col(name) + F.col("_into")).drop("_chunk", "_many", "_into")
