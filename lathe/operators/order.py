"""Rows with their place in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.shared import durable


def with_place(df: DataFrame, *order: Column, place: str = "place") -> DataFrame:
    """Adds the row's place, from 1, in ``order``, which must be total for a defined result.

    Spark range-partitions the rows; a place is the row's number in its range plus the rows of
    the ranges before it. Only one count for each range meets in one task.
    """
    ranges = durable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = ranges.groupBy("_range").agg(F.count("*").alias("_c")).select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(F.broadcast(before), "_range").select(*df.columns, (number + F.col("_before")).alias(place))


def bytes_order(column: str) -> Column:
    """Byte order of UTF-8, the order of the C locale."""
    return F.asc(F.encode(F.coalesce(column, F.lit("")), "UTF-8"))


def missing_first(*columns: str) -> list[Column]:
    """Composite order in which a missing value counts as the empty text."""
    return [F.asc(F.coalesce(c, F.lit(""))) for c in columns]


def first_in_order(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group in input order, which ``order`` states."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
