"""Keep-first dedup, survivors, duplicate groups, anti-join merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.functions.text import site, strip


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key in ``order``, which must be total for a defined result."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedup_counters(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: rows in, kept, exact repeats, kept rows whose key has been seen with another value, and kept rows without a value.

    Keys and values are stripped of all white space first. The counts don't depend on the order of rows.
    Counted from the distinct (key, value), so a hot key is no hot task.
    """
    clean = df.select(*(strip(F.col(k).cast("string")).alias(k) for k in [*keys, value]))
    kept = clean.groupBy(*keys, value).agg(F.count("*").alias("n"))
    by_key = kept.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("kept"), F.count_if(F.col(value) == "").alias("blank"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = by_key.agg(zero(F.sum("n")).alias("n_in"), zero(F.sum("kept")).alias("n_kept"), zero(F.sum(F.col("kept") - 1)).alias("n_conflicts"), zero(F.sum("blank")).alias("n_blank"))
    return out.select("n_in", "n_kept", (F.col("n_in") - F.col("n_kept")).alias("n_exact"), "n_conflicts", "n_blank")


def duplicate_groups(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def survivor(df: DataFrame, group: list[str], best: list[tuple[str, bool]], spread: str, limit: float, order: list[str | Column] | None = None) -> DataFrame:
    """Each row's decision: ambiguous if the group's spread passes the limit, else keep the best, drop the rest.

    ``best`` are numeric columns with whether the highest wins, nulls last; of rows alike in them the first in
    ``order`` is kept, one of them in any case. A null group is a group. Aggregated and joined back, so
    a hot group leaves one row in each task; only rows alike in group and ``best`` are numbered together.
    """
    part = lambda c, high: [F.col(c).isNull(), -F.col(c) if high else F.col(c)]
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(k for b in best for k in part(*b))))
    by = df.groupBy(*group).agg((F.max(spread) - F.min(spread)).alias("_spread"), F.min(key).alias("_best"))
    by = by.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(group)})
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    first = F.row_number().over(Window.partitionBy(*group, key).orderBy(*(order or [F.lit(1)]))) == 1
    decision = F.when(F.col("_spread") > limit, "ambiguous").when(key.eqNullSafe(F.col("_best")) & F.col("_first"), "keep").otherwise("quarantine")
    return df.withColumn("_first", first).join(by, same).withColumn("decision", decision).select(*df.columns, "decision")


def anti_merge(new: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(present.select(*keys).distinct(), keys, "left_anti")


def merge_logins(present: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` (seq, url, username, password, ...) that bring a login, with ``skipped`` for the rest.

    ``present`` has items (uris, username): each of an item's addresses makes a pair of site and lower-cased
    name; an empty address has the empty site, an item without addresses makes none. A new row is skipped if its pair is present, or if
    an earlier row, by ``seq``, has its pair and password. Names and passwords are stripped.
    """
    name = lambda c: F.lower(strip(F.col(c)))
    have = present.select(F.explode("uris").alias("uri"), name("username").alias("_user")).select(site(F.col("uri")).alias("_site"), "_user").distinct()
    rows = new.select("*", site(F.col("url")).alias("_site"), name("username").alias("_user"), strip(F.col("password")).alias("_password"))
    rows = rows.join(have.withColumn("_present", F.lit(True)), ["_site", "_user"], "left")
    first = rows.where("_present IS NULL").groupBy("_site", "_user", "_password").agg(F.min("seq").alias("_first"))
    out = rows.join(first, ["_site", "_user", "_password"], "left")
    return out.select(*(f"`{c}`" for c in new.columns), (F.col("_present").isNotNull() | (F.col("seq") != F.col("_first"))).alias("skipped"))
