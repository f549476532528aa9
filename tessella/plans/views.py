"""Views over the given tables in the shape of simulation results, each written once in SQL that Spark and DuckDB accept.

lat_node, lat_cell, lat_face: a lattice of hexahedra made of ``part``. cloud: scattered points of ``lineitem``. cyc_field: a
field over cycles of ``events``. ptcl: particles of ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "lat_node": ((), """
SELECT 'lat' AS ds_id, CAST(p_partkey AS BIGINT) AS node_id, CAST(p_partkey % 10 AS BIGINT) AS i,
       CAST(floor(p_partkey / 10.0) AS BIGINT) % 10 AS j, CAST(floor(p_partkey / 100.0) AS BIGINT) AS k,
       CAST(p_partkey % 10 AS DOUBLE) AS x, CAST(CAST(floor(p_partkey / 10.0) AS BIGINT) % 10 AS DOUBLE) * CAST(1.5 AS DOUBLE) AS y,
       CAST(floor(p_partkey / 100.0) AS DOUBLE) * CAST(0.5 AS DOUBLE) AS z,
       CAST(p_retailprice AS DOUBLE) AS pres, CAST(p_size AS DOUBLE) AS temp,
       CAST(6.75 AS DOUBLE) - CAST(CAST(floor(p_partkey / 10.0) AS BIGINT) % 10 AS DOUBLE) * CAST(1.5 AS DOUBLE) AS velx,
       CAST(p_partkey % 10 AS DOUBLE) - CAST(4.5 AS DOUBLE) AS vely, CAST(1 AS DOUBLE) AS velz,
       CAST(p_size % 3 + 1 AS BIGINT) AS material, p_type AS part_name
FROM part"""),
    "lat_cell": (("lat_node",), """
SELECT 'lat' AS ds_id, (k * 9 + j) * 9 + i AS cell_id, node_id AS n0, node_id + 1 AS n1, node_id + 11 AS n2, node_id + 10 AS n3,
       node_id + 100 AS n4, node_id + 101 AS n5, node_id + 111 AS n6, node_id + 110 AS n7, 12 AS cell_type, material, part_name,
       (k * 9 + j) * 9 + i AS cvol_id, i, j, k, temp AS ctemp
FROM lat_node WHERE i < 9 AND j < 9 AND k < (SELECT max(k) FROM lat_node)"""),
    "lat_face": (("lat_node",), """
SELECT face_id, f.n0, f.n1, f.n2, f.n3, CASE WHEN low >= 0 THEN low ELSE high END AS owner,
       CASE WHEN low >= 0 AND high >= 0 THEN high END AS neighbour,
       CASE WHEN low < 0 THEN concat(axis, 'min') WHEN high < 0 THEN concat(axis, 'max') END AS region
FROM (
  SELECT node_id AS face_id, 'X' AS axis, node_id AS n0, node_id + 10 AS n1, node_id + 110 AS n2, node_id + 100 AS n3,
         CASE WHEN i > 0 THEN (k * 9 + j) * 9 + i - 1 ELSE -1 END AS low, CASE WHEN i < 9 THEN (k * 9 + j) * 9 + i ELSE -1 END AS high
  FROM lat_node WHERE j < 9 AND k < (SELECT max(k) FROM lat_node)
  UNION ALL
  SELECT 10000000 + node_id, 'Y', node_id, node_id + 1, node_id + 101, node_id + 100,
         CASE WHEN j > 0 THEN (k * 9 + j - 1) * 9 + i ELSE -1 END, CASE WHEN j < 9 THEN (k * 9 + j) * 9 + i ELSE -1 END
  FROM lat_node WHERE i < 9 AND k < (SELECT max(k) FROM lat_node)
  UNION ALL
  SELECT 20000000 + node_id, 'Z', node_id, node_id + 1, node_id + 11, node_id + 10,
         CASE WHEN k > 0 THEN ((k - 1) * 9 + j) * 9 + i ELSE -1 END,
         CASE WHEN k < (SELECT max(k) FROM lat_node) THEN (k * 9 + j) * 9 + i ELSE -1 END
  FROM lat_node WHERE i < 9 AND j < 9
) f"""),
    "cloud": ((), """
SELECT CAST(l_quantity AS DOUBLE) - CAST(25 AS DOUBLE) AS x, CAST(100 AS DOUBLE) * CAST(l_discount AS DOUBLE) - CAST(5 AS DOUBLE) AS y,
       CAST(100 AS DOUBLE) * CAST(l_tax AS DOUBLE) AS z, CAST(l_extendedprice AS DOUBLE) AS pres,
       CAST(1 AS DOUBLE) + CAST(l_discount AS DOUBLE) AS density, CAST(l_quantity AS DOUBLE) - CAST(25 AS DOUBLE) AS velx,
       CAST(100 AS DOUBLE) * CAST(l_discount AS DOUBLE) - CAST(5 AS DOUBLE) AS vely, CAST(1 AS DOUBLE) + CAST(l_tax AS DOUBLE) AS velz,
       CAST(l_linenumber AS BIGINT) AS line
FROM lineitem"""),
    "cyc_field": ((), """
SELECT 'run' AS series_id, CAST(day(ts) AS INT) AS cycle, CAST(0.1 AS DOUBLE) * CAST(day(ts) AS DOUBLE) AS time,
       CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS entity_id, event_type AS var, avg(CAST(value AS DOUBLE)) AS value
FROM events GROUP BY day(ts), event_type"""),
    "ptcl": ((), """
SELECT CAST(day(ts) AS INT) AS frame, CAST(event_id AS BIGINT) AS particle_id, CAST(hour(ts) AS DOUBLE) AS x, CAST(value AS DOUBLE) AS y,
       CAST(user_id AS DOUBLE) AS z, CAST(value AS DOUBLE) AS vx, CAST(0 AS DOUBLE) AS vy, CAST(1 AS DOUBLE) AS vz
FROM events"""),
}


def needed(names: tuple[str, ...]) -> list[str]:
    """The views and those under them, lowest first."""
    out: list[str] = []
    for name in names:
        for x in (*needed(VIEWS[name][0]), name):
            if x not in out:
                out.append(x)
    return out


def sql(text: str, *names: str, extra: str = "", recursive: bool = False) -> str:
    """text with the views it names before it; extra: further common table expressions."""
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in needed(names)]
    if extra:
        parts.append(extra)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + f"\n{text}" if parts else text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over them; the lattice's corner columns n0.. come as one array, nodes."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for t in ("part", "lineitem", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    df = spark.sql(sql(f"SELECT * FROM {name}", name))
    corners = [c for c in df.columns if len(c) == 2 and c[0] == "n" and c[1].isdigit()]
    if corners:
        from pyspark.sql import functions as F

        df = df.withColumn("nodes", F.array(*corners)).drop(*corners)
    return df
