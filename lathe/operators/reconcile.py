"""Two-sided comparison with verdicts, multiset difference, expectation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_verdicts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, n) against (key, n): LOST, SHRANK, grew, same or new; an unknown count is an error."""
    b, a = before.select(key, F.col("n").alias("n_before"), F.lit(True).alias("_b")), after.select(key, F.col("n").alias("n_after"), F.lit(True).alias("_a"))
    unknown = F.raise_error(F.lit("a count is unknown")).cast("string")
    verdict = (
        F.when(F.col("_a").isNull(), "LOST").when(F.col("_b").isNull(), "new")
        .when(F.col("n_before").isNull() | F.col("n_after").isNull(), unknown)
        .when(F.col("n_after") < F.col("n_before"), "SHRANK").when(F.col("n_after") > F.col("n_before"), "grew").otherwise("same")
    )
    return b.join(a, key, "full").select(key, "n_before", "n_after", verdict.alias("verdict"))


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with the side; repeats count."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def size_tally(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row of counts and surplus of (key, size) against (key, size); a missing size is 0."""
    s, t = F.coalesce("s", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    both = left.select(key, F.col("size").alias("s")).join(right.select(key, F.col("size").alias("t")), key, "left").select(s.alias("s"), t.alias("t"))
    return both.agg(
        F.count_if(F.col("s") > F.col("t")).alias("n_larger"), F.count_if(F.col("s") < F.col("t")).alias("n_smaller"), F.count_if(F.col("s") == F.col("t")).alias("n_equal"),
        F.round(F.sum(F.when(F.col("s") > F.col("t"), F.col("s") - F.col("t"))), 2).alias("surplus"),
    )


def hash_verdicts(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, hash) against (key, hash): ok, mismatch or missing; the hash of nothing counts as missing."""
    empty = F.sha2(F.lit("").cast("binary"), 256)
    other = found.select(key, F.nullif(F.col("hash"), empty).alias("_h"))
    verdict = F.when(F.col("_h").isNull(), "missing").when(F.col("_h") == F.col("hash"), "ok").otherwise("mismatch")
    return expected.join(other, key, "left").select(key, verdict.alias("verdict"))


def tallies(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row: how often each value occurs, and all rows; a value that isn't listed is an error."""
    known = df.select(F.when(F.col(column).isin(values), F.col(column)).otherwise(F.raise_error(F.lit("a value is not listed"))).alias("_v"))
    return known.agg(*(F.count_if(F.col("_v") == v).alias(f"n_{v.lower()}") for v in values), F.count("_v").alias("n_total"))


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows that an inner join on the key would lose."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def first_match(names: DataFrame, paths: DataFrame, name: str, path: str, order: str) -> DataFrame:
    """For each name the first path, by ``order``, whose last part it is; null if there is none."""
    by = paths.groupBy(F.substring_index(path, "/", -1).alias(name)).agg(F.min(F.struct(order, path)).alias("_first"))
    return names.join(by, name, "left").select(*names.columns, F.col(f"_first.{order}").alias(order), F.col(f"_first.{path}").alias(path))


def with_markers(df: DataFrame, marks: DataFrame, key: str, mark: str) -> DataFrame:
    """Adds the distinct marks of each row's key, in order and joined by commas; without marks, empty."""
    # The marks of one key are a property of the mark set, not of how often they are repeated.
    by = marks.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(mark)), ",").alias("markers"))
    return df.join(by, key, "left").withColumn("markers", F.coalesce("markers", F.lit("")))


def first_two_alike(df: DataFrame, group: list[str], order: list, value: str) -> DataFrame:
    """Groups of two or more rows: whether the first two have equal values."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    two = df.select(*group, F.col(value).alias("_v"), n.alias("_n")).where("_n <= 2")
    return two.groupBy(*group).agg((F.min("_v") == F.max("_v")).alias("alike"), F.count("*").alias("_c")).where("_c = 2").drop("_c")


def strict_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails where a row of ``left`` finds no partner, instead of losing it."""
    found = left.join(right.withColumn("_found", F.lit(True)), keys, "left")
    lost = F.raise_error(F.concat_ws(" ", F.lit("no partner for"), *keys)).cast("boolean")
    return found.where(F.when(F.col("_found").isNull(), lost).otherwise(True)).drop("_found")


def any_failed(df: DataFrame, failed: Column) -> DataFrame:
    """One row: whether any row failed, how many did, and of how many; of no rows, none did."""
    bad = F.coalesce(failed, F.lit(True))  # an unknown outcome is a failure
    return df.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("failed"), F.count_if(bad).alias("n_failed"), F.count("*").alias("n"))


def reconciled(df: DataFrame, column: str, parts: list[str], listing: DataFrame) -> DataFrame:
    """One row: how many rows each decision has, the rows of the listing they were made for, and whether the decisions make those up."""
    counts = df.agg(*(F.count_if(F.col(column) == p).alias(f"n_{p}") for p in parts))
    counts = counts.join(F.broadcast(listing.agg(F.count("*").alias("n_all"))), F.lit(True))
    return counts.withColumn("ok", sum((F.col(f"n_{p}") for p in parts), F.lit(0)) == F.col("n_all"))


def tree_verdicts(local: DataFrame, remote: DataFrame, by_content: bool = False) -> DataFrame:
    """(path, size, hash) against the same: matching, differ or missing on the other side; by size, or by content."""
    what = "hash" if by_content else "size"
    other = remote.select("path", F.col(what).alias("_other"), F.lit(True).alias("_there"))
    verdict = F.when(F.col("_there").isNull(), "missing").when(F.col(what).eqNullSafe(F.col("_other")), "matching").otherwise("differ")
    return local.join(other, "path", "left").select("path", verdict.alias("verdict"))
