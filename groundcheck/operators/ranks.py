"""Ranks over a whole table without a task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from groundcheck.session import cut


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None, name: str = "k") -> DataFrame:
    """``rows`` with their place (from 0) in ``order``, within ``by`` if given; the order must tell rows apart.

    Rows are dealt out by ranges of the order, which are sampled and so kept; a
    row's place is that in its range and the rows of the ranges before.
    """
    by = by or []
    placed = cut(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy("_part", *by).orderBy(*order)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a line for each range
    sizes = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(inner) - 1 + F.col("_before")
    return placed.join(F.broadcast(offsets), ["_part", *by]).withColumn(name, place).drop("_part", "_before")
