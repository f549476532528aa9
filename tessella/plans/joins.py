"""Joins of tables that grow with the mesh.

A file's size, which is what Spark goes by before it has run anything, is that of compressed columns: a table of a million nodes
looks small enough to be sent to every task, by way of the driver, and takes hundreds of megabytes there. So joins of nodes,
cells and faces say that both sides are dealt out by the key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join by key that is sorted and merged and never sent whole to the driver or a task."""
    return df.hint("merge")
