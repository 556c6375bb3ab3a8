"""Paths: ancestors, one spelling for directories that differ in case only, and a plan of moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.shared import durable


def ancestors(path: Column) -> Column:
    """All proper directory prefixes of a/b/c: a and a/b; none for a bare name."""
    parts = F.split(path, "/")
    n = F.size(parts)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(n > 1, every).otherwise(F.array().cast("array<string>"))


def dir_counts(df: DataFrame, path: str) -> DataFrame:
    """(dir, n): files below every directory."""
    return df.select(F.explode(ancestors(F.col(path))).alias("dir")).groupBy("dir").agg(F.count("*").alias("n"))


def dirname(path: Column) -> Column:
    """What stands before the last slash; of a bare name, nothing."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def joined(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat(directory, F.lit("/"), name))


def relative(path: Column, start: Column) -> Column:
    """The way from a folder to a path, both seen from one root: up as often as needed, then down; ``.`` for the folder itself.

    Empty parts and ``.`` don't count; ``..`` in the input isn't resolved.
    A null side gives null.
    """
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: (x != "") & (x != "."))
    a, b = parts(path), parts(start)
    shorter = F.least(F.size(a), F.size(b))
    alike = F.when(shorter > 0, F.transform(F.sequence(F.lit(0), shorter - 1), lambda i: F.get(a, i) == F.get(b, i))).otherwise(F.array().cast("array<boolean>"))
    unlike = F.array_position(alike, False).cast("int")
    common = F.when(unlike > 0, unlike - 1).otherwise(shorter)
    way = F.concat(F.array_repeat(F.lit(".."), F.size(b) - common), F.slice(a, common + 1, F.greatest(F.size(a), F.lit(1))))
    return F.when(path.isNotNull() & start.isNotNull(), F.when(F.size(way) > 0, F.array_join(way, "/")).otherwise(F.lit(".")))


def stem(path: Column) -> Column:
    """The name without an extension of three characters and its point."""
    return F.regexp_replace(basename(path), r"\.[^./]{3}$", "")


def canonical_dirs(df: DataFrame, path: str) -> DataFrame:
    """(dir, canonical): level by level, among directories of one canonical parent whose names differ in case only,
    the name of the one with most files below wins; ties go to the first in byte order.

    A level is written and meets only the one above, so a tree of any depth plans alike.
    """
    counts = durable(dir_counts(df, path).withColumn("depth", F.size(F.split("dir", "/"))), "dirs")
    deepest = counts.agg(F.max("depth")).first()[0] or 0
    done = above = df.sparkSession.createDataFrame([("", "")], "dir string, canonical string")
    done = done.where("false")
    for depth in range(1, deepest + 1):
        level = counts.where(F.col("depth") == depth).select("dir", "n", basename(F.col("dir")).alias("name"), dirname(F.col("dir")).alias("up"))
        level = level.join(above.select(F.col("dir").alias("up"), F.col("canonical").alias("parent")), "up")
        best = level.groupBy("parent", F.lower("name").alias("key")).agg(F.min(F.struct((-F.col("n")).alias("few"), "dir", "name")).getField("name").alias("best"))
        level = level.withColumn("key", F.lower("name")).join(best, ["parent", "key"]).select("dir", joined(F.col("parent"), F.col("best")).alias("canonical"))
        above = durable(level, "level")
        done = done.unionByName(above)
    return done


def plan_moves(files: DataFrame, limit: float = 10.0) -> DataFrame:
    """path, target, decision of files (path, duration, bitrate, size), by canonical directory and name in any case.

    A name of its own is kept or moved to its canonical directory. Of several, all are ambiguous
    if their durations differ by more than ``limit``; else the one of highest bitrate, then size
    (the first path of equal ones) is kept or moved, and the others are quarantined. A null path is ambiguous.
    """
    unnamed = files.where("path IS NULL").select("path", F.lit(None).cast("string").alias("target"), F.lit("ambiguous").alias("decision"))
    files = files.where("path IS NOT NULL")
    dirs = canonical_dirs(files, "path")
    rows = files.select("path", "duration", "bitrate", "size", dirname(F.col("path")).alias("dir"), basename(F.col("path")).alias("name"))
    rows = rows.join(dirs, "dir", "left").withColumn("canonical", F.coalesce("canonical", F.lit(""))).withColumn("key", F.lower("name"))
    # Aggregated, not windowed: a group of any size leaves one row in each task.
    best = F.min(F.struct((-F.col("bitrate")).alias("b"), (-F.col("size")).alias("s"), "path", "name"))
    group = rows.groupBy("canonical", "key").agg((F.max("duration") - F.min("duration")).alias("spread"), best.alias("best"))
    rows = rows.join(group, ["canonical", "key"]).withColumn("target", joined(F.col("canonical"), F.col("best.name")))
    stays = F.when(F.col("path") == F.col("target"), "keep").otherwise("move")
    decision = F.when(F.col("spread") > limit, "ambiguous").when(F.col("path") == F.col("best.path"), stays).otherwise("quarantine")
    return rows.select("path", F.when(F.col("spread") > limit, F.col("path")).otherwise(F.col("target")).alias("target"), decision.alias("decision")).unionByName(unnamed)
