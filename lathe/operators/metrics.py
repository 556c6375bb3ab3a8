"""Metric series: reducers, last-two-sample rates, ratios of means, top-k per instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_reduce(df: DataFrame, series: list[str], ts: str, tie: str, value: str) -> DataFrame:
    """Last, mean, max and count of each series; the last is the latest by (ts, tie)."""
    last = F.max(F.struct(ts, tie, value)).getField(value)
    return df.groupBy(*series).agg(last.alias("last"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.count("*").alias("n"))


def irate(df: DataFrame, series: list[str], ts: str, tie: str, value: str) -> DataFrame:
    """Rate from the last two samples; after a counter reset the newest value counts; one sample gives none.

    Spark stops after two rows of each series before it shuffles and again after it.
    """
    w = Window.partitionBy(*series).orderBy(F.desc(ts), F.desc(tie))
    last = df.select(*series, ts, value, F.row_number().over(w).alias("_n")).where("_n <= 2")
    at = lambda c, n: F.max(F.when(F.col("_n") == n, F.col(c)))
    two = last.groupBy(*series).agg(at(value, 1).alias("v"), at(value, 2).alias("v0"), at(ts, 1).alias("t"), at(ts, 2).alias("t0")).where("t0 IS NOT NULL")
    rise = F.when(F.col("v") >= F.col("v0"), F.col("v") - F.col("v0")).otherwise(F.col("v"))
    seconds = F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))
    return two.select(*series, (rise / F.nullif(seconds / 1e6, F.lit(0.0))).alias("rate"))


def group_rates(rates: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean and sum of the rates over a subset of the labels; a series without a rate isn't counted."""
    return rates.where("rate IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.avg("rate").alias("mean"), F.sum("rate").alias("sum"))


def count_groups(df: DataFrame, by: list[str], inner: list[str]) -> DataFrame:
    """(by, value): how many groups of the labels ``inner`` there are in each group of ``by``."""
    return df.select(*by, *inner).distinct().groupBy(*by).agg(F.count("*").cast("double").alias("value"))


def mean_of_sums(rates: DataFrame, by: list[str], inner: list[str]) -> DataFrame:
    """(by, value): the mean over the groups of ``inner`` of the sums of their rates; series without a rate are left out."""
    sums = rates.where("rate IS NOT NULL").groupBy(*by, *inner).agg(F.sum("rate").alias("s"))
    return sums.groupBy(*by).agg(F.avg("s").alias("value"))


def busy_share(samples: DataFrame, rates: DataFrame, host: str, cpu: str, mode: str, idle: str) -> DataFrame:
    """(host, value): (cpus - mean over modes of the summed idle rates) * 100 / cpus; cpus are counted from all samples."""
    cpus = count_groups(samples, [host], [cpu])
    rest = vector_op(cpus, mean_of_sums(rates.where(F.col(mode) == idle), [host], [mode]), [host], lambda n, s: (n - s) * 100)
    return vector_op(rest, cpus, [host], lambda a, n: F.try_divide(a, n))


def vector_op(left: DataFrame, right: DataFrame, labels: list[str], op) -> DataFrame:
    """op(left, right) of (labels, value) on identical label sets; one without a partner is dropped, two alike on a side are an error."""
    once = lambda df, name: df.groupBy(*labels).agg(F.when(F.count("*") > 1, F.raise_error(F.lit("several series have these labels")).cast("double")).otherwise(F.first("value")).alias(name))
    return once(left, "_l").join(once(right, "_r"), labels).select(*labels, op(F.col("_l"), F.col("_r")).alias("value"))


def last_range(df: DataFrame, ts: str, window: str, step: str) -> DataFrame:
    """Samples of the last ``window`` before the newest one, with the ``step`` they fall into."""
    newest = df.agg(F.max(ts).alias("_newest"))
    rows = df.join(F.broadcast(newest), F.lit(True)).where(F.col(ts) >= F.col("_newest") - F.expr(f"INTERVAL {window}")).drop("_newest")
    return rows.withColumn("at", F.window(ts, step).getField("start"))


def top_k(df: DataFrame, by: list[str], k: int, order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def matches(label: Column, pattern: str) -> Column:
    """A label matcher: the pattern must fit the whole label."""
    return label.rlike(f"^(?:{pattern})$")
