"""Bill of materials: scale, share of reference, totals on two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled(per_hundred: Column, amount: Column) -> Column:
    return per_hundred / 100 * amount


def share(amount: Column, reference: Column) -> Column:
    """Null where the reference is 0."""
    return F.try_divide(amount, reference)


def with_totals(df: DataFrame, outer: str, inner: str, value: Column) -> DataFrame:
    """Rows by (outer, inner), a total of each outer, and a grand total; level is 0, 1 or 3."""
    return df.rollup(outer, inner).agg(F.round(F.sum(value), 4).alias("amount"), F.grouping_id().cast("int").alias("level"))
