"""Proper orthogonal decomposition and k-means over the cycles of a series.

Snapshots are long: (cycle, entity_id, value). Modes come from the products of cycles, or of entities if there are fewer of
these, while one of both is at most MOST; beyond it, from a subspace that products with the table itself turn towards the
leading modes. Lloyd's steps are joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.scratch import keep

#: Rows up to which a matrix of products is decomposed on the driver: 32 MB of it.
MOST = 2_000
#: Turns of the subspace at most, directions beyond the wanted modes, and change of the values at which it ends.
TURNS, SPARE, CLOSE = 300, 8, 1e-13


def snapshots(field: DataFrame, var: str) -> DataFrame:
    """(cycle, entity_id, value) of a variable; an error if it is absent or cycles have different entities (M1)."""
    s = field.where(F.col("var") == var).select("cycle", "entity_id", "value")
    n = s.groupBy("cycle").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("d")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("d").alias("d")).first()
    if n["lo"] is None:
        raise ValueError(f"no variable {var!r}")
    if n["lo"] != n["hi"] or n["d"] != n["lo"]:
        raise ValueError("cycles of unequal length")
    return s


def _centred(s: DataFrame) -> DataFrame:
    mean = s.groupBy("entity_id").agg(F.avg("value").alias("m"))
    return s.join(mean, "entity_id").select("cycle", "entity_id", (F.col("value") - F.col("m")).alias("v"))


def _gram(s: DataFrame, of: str, over: str, ids: list) -> np.ndarray:
    """Products of the rows `of`, summed over `over`: the values of one of these meet as one row, pairs are summed in tasks."""
    place = {c: k for k, c in enumerate(ids)}
    rows = s.groupBy(over).agg(F.collect_list(F.struct(of, "v")).alias("r")).select(F.transform("r", lambda e: e[of]).alias("i"), F.transform("r", lambda e: e["v"]).alias("v"))

    def products(parts):
        import pandas as pd

        total = np.zeros((len(place), len(place)))
        order = np.array(list(place))
        for part in parts:
            m = np.zeros((len(part), len(place)))
            for k, (i, v) in enumerate(zip(part["i"], part["v"], strict=True)):
                m[k, np.searchsorted(order, i)] = v
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(len(place)), "g": list(total)})

    got = rows.mapInPandas(products, "i int, g array<double>").select("i", F.posexplode("g")).groupBy("i", "pos").agg(F.sum("col").alias("g")).toArrow()
    out = np.zeros((len(ids), len(ids)))
    out[got.column("i").to_numpy(), got.column("pos").to_numpy()] = got.column("g").to_numpy()
    return out


def _leading(c: DataFrame, modes: int) -> tuple[DataFrame, list[float]]:
    """(entity_id, mode, f): the leading directions of a table too large for its products, and the squared singular values: a
    subspace of random directions multiplied by the table and its transpose until the values stand still."""
    m = modes + SPARE
    v = c.select("entity_id").distinct().withColumn("mode", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("f", (F.xxhash64("entity_id", "mode") % 1_000_003) / 1_000_003.0)
    last = None
    for _ in range(TURNS):
        v = keep(v, "modes")
        w = c.join(v, "entity_id").groupBy("cycle", "mode").agg(F.sum(F.col("v") * F.col("f")).alias("f"))
        y = keep(c.join(w, "cycle").groupBy("entity_id", "mode").agg(F.sum(F.col("v") * F.col("f")).alias("f")), "modes")
        g = _gram(y.select(F.col("mode").alias("i_"), "entity_id", F.col("f").alias("v")).withColumnRenamed("i_", "mode"), "mode", "entity_id", list(range(m)))
        both = y.join(v.withColumnRenamed("f", "e"), ["entity_id", "mode"])
        value, turn = np.linalg.eigh(g)
        ok = value > value.max() * 1e-28 if value.max() > 0 else value > 0
        scale = (turn[:, ok] / np.sqrt(value[ok]))[:, ::-1]
        pairs = [(i, k, float(scale[i, k])) for i in range(m) for k in range(scale.shape[1])]
        table = c.sparkSession.createDataFrame(pairs, "mode int, to int, s double")
        v = both.join(F.broadcast(table), "mode").groupBy("entity_id", F.col("to").alias("mode")).agg(F.sum(F.col("f") * F.col("s")).alias("f"))
        now = np.sqrt(value[::-1][:modes])
        if last is not None and len(last) == len(now) and np.abs(now - last).max() <= CLOSE * max(float(now[0]), 1e-300):
            break
        last, m = now, scale.shape[1]
    v = keep(v.where(F.col("mode") < modes), "modes")
    size = c.join(v, "entity_id").groupBy("cycle", "mode").agg(F.sum(F.col("v") * F.col("f")).alias("t")).groupBy("mode").agg(F.sum(F.col("t") * F.col("t")).alias("w")).collect()
    found = {r["mode"]: r["w"] for r in size}
    return v, [found.get(k, 0.0) for k in range(max(found, default=-1) + 1)]


def pod(s: DataFrame, modes: int) -> tuple[DataFrame, DataFrame]:
    """Coefficients (cycle, mode, t, energy) and modes (mode, entity_id, value) (M2): the mean over cycles is taken off. Energies are
    shares of the squared singular values, 0 if nothing varies. Signs are free; there are at most as many modes as cycles or
    entities, and with more than MOST of both, those that a subspace closes in on."""
    c = keep(_centred(s), "centred")
    spark = s.sparkSession
    n = {k: c.select(k).distinct().count() for k in ("cycle", "entity_id")}
    total = c.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
    modes = min(modes, *n.values())
    if min(n.values()) > MOST:
        f, w = _leading(c, modes)
    else:
        of, over = ("cycle", "entity_id") if n["cycle"] <= n["entity_id"] else ("entity_id", "cycle")
        ids = sorted(r[0] for r in c.select(of).distinct().collect())  # MOST at most
        value, u = np.linalg.eigh(_gram(c, of, over, ids))
        order = np.argsort(-value)[:modes]
        w, u = np.maximum(value[order], 0), u[:, order]
        if of == "cycle":  # a mode is the table times a vector of cycles, at length 1
            size = np.sqrt(w)
            rows = [(int(i), k, float(u[j, k] / size[k]) if size[k] > 1e-12 * (size[0] or 1) else 0.0) for k in range(len(w)) for j, i in enumerate(ids)]
            scale = spark.createDataFrame(rows, "cycle long, mode int, s double")
            f = keep(c.join(F.broadcast(scale), "cycle").groupBy("entity_id", "mode").agg(F.sum(F.col("v") * F.col("s")).alias("f")), "modes")
        else:
            f = spark.createDataFrame([(int(i), k, float(u[j, k])) for k in range(len(w)) for j, i in enumerate(ids)], "entity_id long, mode int, f double")
    shares = spark.createDataFrame([(k, float(x) / total if total > 0 else 0.0) for k, x in enumerate(w)], "mode int, energy double")
    t = c.join(f, "entity_id").groupBy("cycle", "mode").agg(F.sum(F.col("v") * F.col("f")).alias("t"))
    return t.join(F.broadcast(shares), "mode").select(F.col("cycle").cast("int").alias("cycle"), "mode", "t", "energy"), f.select("mode", "entity_id", F.col("f").alias("value"))


def mode_fields(nodes: DataFrame, s: DataFrame, fields: DataFrame, modes: int, key: str = "entity_id") -> DataFrame:
    """nodes with POD_MEAN and POD_MODE_1 .. as columns (M3)."""
    mean = s.groupBy("entity_id").agg(F.avg("value").alias("POD_MEAN"))
    wide = fields.groupBy("entity_id").agg(*(F.sum(F.when(F.col("mode") == k, F.col("value"))).alias(f"POD_MODE_{k + 1}") for k in range(modes)))
    return nodes.join(mean.join(wide, "entity_id").withColumnRenamed("entity_id", key), key, "left")


def kmeans(s: DataFrame, k: int, first: list[int] | None = None, steps: int = 200, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """Labels (cycle, cluster, d2) and centroids (cluster, entity_id, value) by Lloyd's method (M4, M5).

    k is at most the number of cycles; first: the cycles to start from, else the first k. A step assigns the cycles to their
    nearest centroids and takes these anew; it ends when the inertia changes by tolerance times one more than itself, or less. An
    empty cluster keeps its centroid. d2 is the distance to the centroids that a cycle was assigned by."""
    s = keep(s.select("cycle", "entity_id", F.col("value").cast("double").alias("value")), "snapshots")
    start = (first or [r[0] for r in s.select("cycle").distinct().orderBy("cycle").limit(k).collect()])[:k]
    own = s.sparkSession.createDataFrame([(int(c), i) for i, c in enumerate(start)], "cycle int, cluster int")
    centroids, labels, last = s.join(F.broadcast(own), "cycle").select("cluster", "entity_id", "value"), None, None
    for _ in range(steps):
        d = s.join(centroids.select("cluster", "entity_id", F.col("value").alias("c")), "entity_id").groupBy("cycle", "cluster").agg(F.sum((F.col("value") - F.col("c")) * (F.col("value") - F.col("c"))).alias("d2"))
        best = F.min(F.struct(F.round("d2", 9).alias("r"), "cluster", "d2")).alias("b")
        labels = keep(d.groupBy("cycle").agg(best).select("cycle", "b.cluster", "b.d2"), "labels")
        new = s.join(labels.select("cycle", "cluster"), "cycle").groupBy("cluster", "entity_id").agg(F.avg("value").alias("value"))
        empty = centroids.join(F.broadcast(labels.select("cluster").distinct()), "cluster", "left_anti")  # k rows
        centroids = keep(new.unionByName(empty), "centroids")
        now = labels.agg(F.sum("d2")).first()[0] or 0.0
        if last is not None and abs(last - now) <= tolerance * (1.0 + abs(last)):
            break
        last = now
    return labels, centroids


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """(cluster, size, inertia) (M5)."""
    return labels.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("d2").alias("inertia"))


def cluster_fields(nodes: DataFrame, centroids: DataFrame, k: int, key: str = "entity_id") -> DataFrame:
    """nodes with CLUSTER_1 .. as columns (M6)."""
    wide = centroids.groupBy("entity_id").agg(*(F.sum(F.when(F.col("cluster") == c, F.col("value"))).alias(f"CLUSTER_{c + 1}") for c in range(k)))
    return nodes.join(wide.withColumnRenamed("entity_id", key), key, "left")
