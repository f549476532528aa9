"""Exact medians of groups of any size, by histograms that close in on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.scratch import keep

#: Edges of a pass, and values of the last bin that are sorted.
EDGES, SORTED = 64, 100_000


def medians(df: DataFrame, by: list[str], value: str, name: str = "median", edges: int = EDGES, few: int = SORTED) -> DataFrame:
    """(by, name): the exact median of a number in each group, as ``median`` gives it; NULL and NaN, and rows without a
    group, are left out.

    A pass takes edges from an approximate sketch of each group, counts the values between them and at them exactly, and goes
    on with the bin that holds the middle one (or the two bins that hold the middle two). Edges are values of the group, so a bin
    is smaller by about their number in each pass, whatever the values' scale. Counts are summed in tasks first; no group's
    values meet until a bin has few enough to sort or all of one value."""
    v = keep(df.select(*(F.col(c) for c in by), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)").dropna(subset=by), "median-values")
    g = v.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    ranks = F.explode(F.array(*(F.struct(F.lit(k).alias("which"), F.floor((F.col("n") - 1 + k) / 2).alias("rank")) for k in (0, 1))))
    # rank: 0-based among the n values from lo to hi
    now = keep(g.select(*by, "n", "lo", "hi", ranks.alias("r")).select(*by, "n", "lo", "hi", "r.which", "r.rank"), "median-bounds")
    done = None
    while True:
        open_ = now.where((F.col("n") > few) & (F.col("lo") < F.col("hi")))
        ready = now.where((F.col("n") <= few) | (F.col("lo") >= F.col("hi")))
        done = ready if done is None else done.unionByName(ready)
        if open_.isEmpty():
            break
        met = v.join(open_, by).where("_v between lo and hi").select(*by, "which", "rank", "_v")
        parts = F.array(*(F.lit(k / (edges + 1)) for k in range(1, edges + 1)))
        cuts = met.groupBy(*by, "which", "rank").agg(F.percentile_approx("_v", parts, F.lit(16 * edges)).alias("_e"))
        # bins between edges are even, those of an edge's own value odd
        bin_ = 2 * F.size(F.filter("_e", lambda e: e < F.col("_v"))) + F.array_contains("_e", F.col("_v")).cast("int")
        h = met.join(cuts, [*by, "which", "rank"]).groupBy(*by, "which", "rank", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "which").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        h = h.withColumn("rank", F.col("rank") - below)
        now = keep(h.where("rank >= 0 and rank < n").select(*now.columns), "median-bounds")
    same = done.where(F.col("lo") >= F.col("hi")).select(*by, "which", F.col("lo").alias("_v"))
    some = v.join(done.where(F.col("lo") < F.col("hi")), by).where("_v between lo and hi")
    place = F.row_number().over(Window.partitionBy(*by, "which").orderBy("_v")) - 1
    picked = some.withColumn("_place", place).where("_place = rank").select(*by, "which", "_v")
    return same.unionByName(picked).groupBy(*by).agg((0.5 * F.min("_v") + 0.5 * F.max("_v")).alias(name))
