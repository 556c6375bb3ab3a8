"""The plan that makes one tree of files like another, with renames instead of copies, and a cap on deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.operators.order import with_place
from lathe.shared import durable


def _ranked(files: DataFrame, name: str) -> DataFrame:
    """(size, stamp, rank, name): files of equal size and time, numbered by path.

    The number is a place in the order of all files less the first of the group, so no task holds a group.
    """
    placed = durable(with_place(files, F.asc("size"), F.asc("stamp"), F.asc("path")), "placed")
    first = placed.groupBy("size", "stamp").agg(F.min("place").alias("_first"))
    return placed.join(first, ["size", "stamp"]).select("size", "stamp", (F.col("place") - F.col("_first")).alias("rank"), F.col("path").alias(name))


def sync_plan(source: DataFrame, target: DataFrame, most_deletes: int = 100) -> DataFrame:
    """(action, path, was, refused) of listings (path, size, stamp), paths being distinct in each.

    ``copy``: the path is new or differs in size or time; ``rename``: a path only the target has (``was``) becomes
    one that only the source has, of equal size and time, one for one in order of paths; ``delete``: a path
    only the target has is left over; ``same``: nothing to do. More than ``most_deletes`` deletions refuse the
    whole plan, which every row says. Files of unknown size or time are never renamed.
    """
    s, t = (d.select("path", F.struct("size", "stamp").alias(n), F.lit(True).alias(f"_{n}")) for d, n in ((source, "s"), (target, "t")))
    both = durable(s.join(t, "path", "full"), "both")
    known = both.where("_s AND _t").select(F.when(F.col("s") == F.col("t"), "same").otherwise("copy").alias("action"), "path", F.lit(None).cast("string").alias("was"))
    new, gone = both.where("_t IS NULL").select("path", "s.*"), both.where("_s IS NULL").select("path", "t.*")
    whole = "size IS NOT NULL AND stamp IS NOT NULL"
    pairs = durable(_ranked(new.where(whole), "path").join(_ranked(gone.where(whole), "was"), ["size", "stamp", "rank"]).select("path", "was"), "renames")
    copies = new.join(pairs.select("path"), "path", "left_anti").select(F.lit("copy"), "path", F.lit(None).cast("string"))
    deletes = durable(gone.join(pairs.select(F.col("was").alias("path")), "path", "left_anti").select(F.lit("delete"), "path", F.lit(None).cast("string")), "deletes")
    plan = known.union(copies).union(pairs.select(F.lit("rename"), "path", "was")).union(deletes)
    refused = deletes.agg((F.count("*") > most_deletes).alias("refused"))
    return plan.join(F.broadcast(refused), F.lit(True))
