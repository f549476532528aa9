"""Datasets in Parquet, series of files, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Candidates of a series, in order of path (a limit that the feature has).
SERIES_LIMIT = 500


def open_dataset(spark: SparkSession, path: str, table: str, ds_id: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A canonical table of one dataset, with only the columns asked for read."""
    df = spark.read.parquet(f"{path}/{table}")
    df = df.where(F.col("ds_id") == ds_id) if ds_id is not None else df
    return df.select(*columns) if columns else df


def cycle_of(path: Column) -> Column:
    """The digits at the end of a file's stem, NULL without."""
    return F.regexp_extract(path, r"(\d+)(?:\.[^./]*)?$", 1).try_cast("int")


def scan_series(files: DataFrame, first: str, limit: int = SERIES_LIMIT) -> DataFrame:
    """(path, stem, cycle, ord) of the files (path) whose name is first's but for its trailing digits, sorted by cycle (S3)."""
    parts = lambda c: F.regexp_extract(c, r"^(.*?)(\d+)(\.[^./]*)?$", 1)
    end = lambda c: F.regexp_extract(c, r"^(.*?)(\d+)(\.[^./]*)?$", 3)
    f = files.select("path", parts(F.col("path")).alias("stem"), end(F.col("path")).alias("suffix"), cycle_of(F.col("path")).alias("cycle")).where("cycle is not null")
    f = f.where((F.col("stem") == parts(F.lit(first))) & (F.col("suffix") == end(F.lit(first)))).orderBy("path").limit(limit)
    return f.select("path", "stem", "cycle", (F.row_number().over(Window.orderBy("cycle", "path")) - 1).alias("ord"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) without reading the files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))


def summary(field: DataFrame, by: str = "ds_id") -> DataFrame:
    """(ds_id, rows, entities, cycles, names) of a long field, from its key columns only."""
    return field.groupBy(by).agg(F.count("*").alias("rows"), F.countDistinct("entity_id").alias("entities"), F.countDistinct("cycle").alias("cycles"), F.array_sort(F.collect_set("var")).alias("names"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)


def pod_table(coefficients: DataFrame, modes: int) -> DataFrame:
    """(cycle, t_1.., energy_1..) with nine significant digits."""
    text = lambda c: F.format_string("%.9g", c)
    pick = lambda k, c: F.max(F.when(F.col("mode") == k, F.col(c)))
    return coefficients.groupBy("cycle").agg(*(text(pick(k, "t")).alias(f"t_{k + 1}") for k in range(modes)), *(text(pick(k, "energy")).alias(f"energy_{k + 1}") for k in range(modes))).orderBy("cycle")


def cluster_table(labels: DataFrame) -> DataFrame:
    """(cycle, cluster)."""
    return labels.select("cycle", "cluster").orderBy("cycle")


def integration_table(integrals: DataFrame, names: list[str]) -> DataFrame:
    """(slice, quantity, value) of a slice integration."""
    return integrals.unpivot(["slice"], names, "quantity", "value")


def probe_output(probed: DataFrame, groups: dict[str, list[str]], chosen: list[str]) -> DataFrame:
    """The columns of the chosen groups (title, coords, normal, scalar, vector, elem, node, rank), in order."""
    unknown = set(chosen) - set(groups)
    if unknown:
        raise ValueError(f"unknown groups {sorted(unknown)}")
    return probed.select(*(c for g in chosen for c in groups[g]))
