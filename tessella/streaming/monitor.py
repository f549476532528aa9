"""Monitoring a series whose cycles arrive, and running sums over them; the same functions take batch tables.

Keys are cycle numbers, variables and entities, so no watermark is needed: state is bounded by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files that come to a folder; files: how many a batch takes at most."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def cycle_ranges(field: DataFrame) -> DataFrame:
    """(cycle, var, n, lo, hi, mean)."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return field.groupBy("cycle", "var").agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"))


def running_sums(field: DataFrame) -> DataFrame:
    """(entity_id, var, n, sum, average, square_sum) over the cycles so far."""
    return field.groupBy("entity_id", "var").agg(F.count("*").alias("n"), F.sum("value").alias("sum"), (F.sum("value") / F.count("*")).alias("average"), F.sum(F.col("value") * F.col("value")).alias("square_sum"))


def fold(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Folds everything that has arrived into a table at path and stops; called again it goes on from the checkpoint.

    The running groups live in the stream's state. Each batch writes the groups it has changed under its own number, over what an
    earlier try of the same batch left, so a stop between any two steps counts nothing twice and loses nothing."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def folded(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table that fold() keeps: each group's row of the last batch that changed it."""
    df = spark.read.parquet(path)
    values = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def run_available(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Everything that has arrived, folded into a table in memory under name (complete mode); stops by itself."""
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
