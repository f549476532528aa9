"""Series of cycles: look-up as of a cycle, interpolation between members, lock-step of series, statistics over cycles.

cycle table: (series_id, ord, cycle, time). field table: (series_id, cycle, entity_id, var, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def members(cycles: DataFrame) -> DataFrame:
    """cycles with ord, the 0-based place by cycle in its series, next_cycle and next_time."""
    w = Window.partitionBy("series_id").orderBy("cycle")
    return cycles.withColumns({"ord": (F.row_number().over(w) - 1).cast("long"), "next_cycle": F.lead("cycle").over(w), "next_time": F.lead("time").over(w)})


def add_cycle(cycles: DataFrame, series: str, path: str, cycle: int | None = None, time: float | None = None) -> DataFrame:
    """cycles and one more; without a number, the digits that end the path's stem, else how many there are and one."""
    import re

    if cycle is None:
        stem = re.search(r"(\d+)(?:\.[^./]*)?$", path)
        cycle = int(stem[1]) if stem else cycles.where(F.col("series_id") == series).count() + 1
    row = cycles.sparkSession.createDataFrame([(series, cycle, time, path)], "series_id string, cycle int, time double, path string")
    return cycles.unionByName(row, allowMissingColumns=True)


def drop_cycle(cycles: DataFrame, series: str, cycle: int) -> DataFrame:
    """cycles without one."""
    return cycles.where(~((F.col("series_id") == series) & (F.col("cycle") == cycle)))


def as_of(cycles: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (asked) with series_id and the first cycle at or after it, else the last (J23), in every series."""
    c = F.broadcast(cycles.groupBy("series_id").agg(F.array_sort(F.collect_set("cycle")).alias("all")))  # cycles, not data
    later = lambda q: F.array_min(F.filter("all", lambda x: x >= q))
    return requests.join(c).select("asked", "series_id", F.coalesce(later(F.col("asked")), F.array_max("all")).alias("cycle"))


def exactly(cycles: DataFrame, requests: DataFrame) -> DataFrame:
    """Members of the asked cycles."""
    return requests.select(F.col("asked").alias("cycle")).join(cycles, "cycle")


def by_ordinal(cycles: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (asked: a 0-based place) with each series' member there; none past its end."""
    return requests.select(F.col("asked").cast("long").alias("ord")).join(members(cycles), "ord").select("ord", "series_id", "cycle", "time")


def nearest_time(cycles: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (asked: a time) with each series' cycle of nearest time, the earlier on ties."""
    j = requests.join(F.broadcast(cycles.where("time is not null")))  # a parameter table and cycles
    return j.groupBy("asked", "series_id").agg(F.min_by("cycle", F.struct(F.abs(F.col("time") - F.col("asked")), "cycle")).alias("cycle"))


def ranges(cycles: DataFrame) -> DataFrame:
    """One row over all series: least and greatest cycle, and the greatest 0-based place."""
    return members(cycles).agg(F.min("cycle").alias("min_cycle"), F.max("cycle").alias("max_cycle"), F.max("ord").alias("max_index"), F.count("*").alias("members"))


def _blend(field: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """field values of brackets (..., series_id, c0, c1, f): (1 - f) of cycle c0 and f of c1."""
    b = F.broadcast(brackets)
    v = field.select("series_id", F.col("cycle").alias("_c"), "entity_id", "var", "value")
    w = F.when(F.col("_c") == F.col("c0"), 1 - F.col("f")).otherwise(F.lit(0.0)) + F.when((F.col("_c") == F.col("c1")) & (F.col("c1") != F.col("c0")), F.col("f")).otherwise(F.lit(0.0))
    j = v.join(b, "series_id").where((F.col("_c") == F.col("c0")) | (F.col("_c") == F.col("c1"))).withColumn("w", w)
    g = j.groupBy(*keys, "series_id", "entity_id", "var").agg(F.sum(F.when(F.col("w") != 0, F.col("w") * F.col("value")).otherwise(F.lit(0.0))).alias("value"), F.max((F.col("_c") == F.col("c0")).cast("int")).alias("first"))
    return g.where("first = 1").drop("first")


def at_index(field: DataFrame, cycles: DataFrame, requests: DataFrame, strict: bool = False) -> DataFrame:
    """(asked, series_id, entity_id, var, value) at fractional places i + f: (1 - f) of member i and f of i + 1.

    Past the last member a fraction counts as none; a place outside is left out. strict leaves out fractions at the last
    member too (W2). A variable that only the second member has is left out."""
    m = members(cycles).select("series_id", "ord", F.col("cycle").alias("c0"), F.col("next_cycle").alias("c1"))
    q = requests.select("asked", F.floor("asked").cast("long").alias("ord"), (F.col("asked") - F.floor("asked")).alias("f"))
    b = q.join(m, "ord")
    if strict:
        b = b.where("f = 0 or c1 is not null")
    b = b.select("asked", "series_id", "c0", F.coalesce("c1", "c0").alias("c1"), F.when(F.col("c1").isNull(), F.lit(0.0)).otherwise(F.col("f")).alias("f"))
    return _blend(field, b, ["asked"])


def at_time(field: DataFrame, cycles: DataFrame, requests: DataFrame) -> DataFrame:
    """The same at times: linear between the members around one, held at the ends."""
    m = members(cycles.withColumn("time", F.coalesce("time", F.lit(0.0))))
    ends = m.groupBy("series_id").agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    q = requests.select("asked").join(F.broadcast(ends)).withColumn("t", F.least(F.greatest("asked", "t0"), "t1"))
    b = q.join(F.broadcast(m.select("series_id", "cycle", "time", "next_cycle", "next_time")), "series_id")
    b = b.where((F.col("time") <= F.col("t")) & (F.col("next_time").isNull() | (F.col("t") < F.col("next_time"))))
    gap = F.col("next_time") - F.col("time")
    f = F.when(F.col("next_time").isNull() | (gap <= 0), F.lit(0.0)).otherwise((F.col("t") - F.col("time")) / F.when(gap > 0, gap).otherwise(F.lit(1.0)))
    return _blend(field, b.select("asked", "series_id", F.col("cycle").alias("c0"), F.coalesce("next_cycle", "cycle").alias("c1"), f.alias("f")), ["asked"])


def at_cycle(field: DataFrame, cycles: DataFrame, requests: DataFrame) -> DataFrame:
    """The same at fractional cycle numbers: what is over the member's cycle, divided by the gap to the next."""
    as_time = cycles.withColumn("time", F.col("cycle").cast("double"))
    return at_time(field, as_time, requests)


def series_means(field: DataFrame) -> DataFrame:
    """(series_id, cycle, var, value): means over entities, NaN left out."""
    return field.groupBy("series_id", "cycle", "var").agg(F.avg(F.when(~F.isnan("value"), F.col("value"))).alias("value"))


#: Cycle operations and the value they begin with.
OPERATIONS = {"sum": 0.0, "average": 0.0, "add": 0.0, "subtract": 0.0, "multiply": 1.0, "divide": 1.0, "square_sum": 0.0, "square_average": 0.0}


def accumulate(field: DataFrame, operation: str) -> DataFrame:
    """(series_id, entity_id, var, value): an operation over a series' cycles in order.

    sum and add: v1 + v2 + ...; average; subtract: 0 - v1 - v2 ...; multiply: v1 v2 ...; divide: 1 / v1 / v2 ... by IEEE rules;
    square_sum and square_average: of squares."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}")
    v = F.col("value")
    zeros = F.count_if(v == 0)
    sign = F.pmod(F.count_if(v < 0), F.lit(2))
    size = F.exp(F.sum(F.ln(F.when(v != 0, F.abs(v)))))
    signed = F.when(sign == 1, -F.coalesce(size, F.lit(1.0))).otherwise(F.coalesce(size, F.lit(1.0)))
    nan = F.count_if(F.isnan(v)) > 0
    total = {
        "sum": F.sum(v), "add": F.sum(v), "average": F.avg(v), "subtract": -F.sum(v), "square_sum": F.sum(v * v), "square_average": F.avg(v * v),
        "multiply": F.when(nan, F.lit(float("nan"))).when(zeros > 0, F.lit(0.0)).otherwise(signed),
        "divide": F.when(nan, F.lit(float("nan"))).when(zeros > 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / signed),
    }[operation]
    return field.groupBy("series_id", "entity_id", "var").agg(total.alias("value"))


def with_mesh(datasets: DataFrame) -> DataFrame:
    """datasets (path, stem, ds_id, has_mesh) with mesh_id: its own, or that of its first sibling by path that has one."""
    w = Window.partitionBy("stem")
    first = F.min_by(F.when(F.col("has_mesh"), F.col("ds_id")), F.when(F.col("has_mesh"), F.col("path"))).over(w)
    return datasets.withColumn("mesh_id", F.when(F.col("has_mesh"), F.col("ds_id")).otherwise(first))


def on_every_cycle(field: DataFrame, name: str, needed: list[str], value) -> DataFrame:
    """(series_id, cycle, entity_id, var, value): one expression on every cycle of a series, under a new name; all or nothing.

    field is long (series_id, cycle, entity_id, var, value), so cycles can have unlike variables; value is a Column over the needed
    ones. An error, before any row is given, if a cycle has the new variable already, or has entities that lack a needed one
    or give NULL; a cycle counts for each series by itself."""
    from tessella.functions.expr import add_variable

    key = ["series_id", "cycle", "entity_id"]
    own = field.where(F.col("var").isin(needed))
    # entities of a cycle: those that have any of the needed variables
    wide = own.repartition(*key).groupBy(*key).agg(*(F.first(F.when(F.col("var") == v, F.col("value")), ignorenulls=True).alias(v) for v in needed))
    out = add_variable(wide, name, value)
    faults = out.groupBy("series_id", "cycle").agg(F.count_if(F.coalesce(F.col(name).isNull(), F.lit(True)) | F.exists(F.array(*(F.col(f"`{v}`").isNull() for v in needed)), lambda x: x)).alias("bad"))
    taken = field.groupBy("series_id", "cycle").agg(F.count_if(F.col("var") == name).alias("there"))
    wrong = taken.join(faults, ["series_id", "cycle"], "left").where("there > 0 or bad is null or bad > 0").orderBy("series_id", "cycle").limit(5).collect()
    if wrong:
        raise ValueError(f"{name!r} can't be made on every cycle: " + ", ".join(f"{r['series_id']} {r['cycle']}" for r in wrong))
    return out.select(*key, F.lit(name).alias("var"), F.col(name).cast("double").alias("value"))


def on_every_member(members_: list[tuple[int, DataFrame]], name: str, value) -> list[tuple[int, DataFrame]]:
    """The tables (cycle, table) of a series with unlike schemas, each with a new variable; an error if any can't have it: its table
    lacks a variable, has the name, or gives NULL for a row (E15)."""
    from pyspark.errors import AnalysisException

    from tessella.functions.expr import add_variable

    out, checks = [], None
    for cycle, df in members_:
        try:
            made = add_variable(df, name, value)
        except (AnalysisException, ValueError) as e:
            raise ValueError(f"cycle {cycle}: {str(e).splitlines()[0]}") from e
        out.append((cycle, made))
        one = made.agg(F.count_if(F.col(name).isNull()).alias("bad")).withColumn("cycle", F.lit(cycle)) if name in made.columns else None
        checks = one if checks is None else checks.unionByName(one) if one is not None else checks
    wrong = [r["cycle"] for r in checks.where("bad > 0").collect()] if checks is not None else []  # a row a cycle
    if wrong:
        raise ValueError(f"no value on cycles {sorted(wrong)}")
    return out
