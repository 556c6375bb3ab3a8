"""State along the lines of files, without a task that holds a file: blocks are summarised, and summaries combined.

Lines are (file, line_no, ...), numbers growing within a file, gaps allowed. A block is the lines of ``size`` numbers;
results don't depend on it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.shared import durable

BLOCK = 10_000


def _block(size: int) -> Column:
    return F.floor(F.col("line_no") / size)


def carried(lines: DataFrame, mark: Column, name: str, size: int = BLOCK) -> DataFrame:
    """Adds the last mark that isn't null at or before each line of its file."""
    rows = lines.withColumn("_mark", mark).withColumn("_block", _block(size))
    ends = rows.where("_mark IS NOT NULL").groupBy("file", "_block").agg(F.max_by("_mark", "line_no").alias("_end"))
    # A block without marks has no row among the ends, so the blocks there are come along.
    every = rows.select("file", "_block").distinct().join(ends, ["file", "_block"], "left")
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    here = F.last("_mark", ignorenulls=True).over(Window.partitionBy("file", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_here", here).join(every.select("file", "_block", before.alias("_before")), ["file", "_block"])
    return out.select(*lines.columns, F.coalesce("_here", "_before").alias(name))


def last_marked(lines: DataFrame, mark: Column) -> DataFrame:
    """(file, line_no): the last line of each file that is marked; the last separator wins."""
    return lines.where(mark).groupBy("file").agg(F.max("line_no").alias("line_no"))


def first_after(lines: DataFrame, opener: Column, target: Column) -> DataFrame:
    """(file, line_no): the first target line that an opener stands before; null where a file has none."""
    opened = lines.groupBy("file").agg(F.min(F.when(opener, F.col("line_no"))).alias("_open"))
    return lines.join(opened, "file").groupBy("file").agg(F.min(F.when(target & (F.col("line_no") > F.col("_open")), F.col("line_no"))).alias("line_no"))


def _stack(rows: pd.DataFrame) -> tuple[list[int | None], list[tuple[int, int]]]:
    """Of each line the nearest earlier one with a smaller indent, if it is here; and the (indent, line) open at the end."""
    parents, stack = [], []
    for indent, line in zip(rows["indent"].tolist(), rows["line_no"].tolist(), strict=True):
        while stack and stack[-1][0] >= indent:
            stack.pop()
        parents.append(stack[-1][1] if stack else None)
        stack.append((indent, line))
    return parents, stack


def _resolved(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("line_no")
    return pd.DataFrame({"file": rows["file"], "line_no": rows["line_no"], "indent": rows["indent"], "block": rows["block"], "parent": pd.array(_stack(rows)[0], dtype="Int64")})


def scoped(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """(file, line_no, indent, parent): the nearest earlier line of the file with a smaller indent, null at the top.

    Blocks resolve what they can. What is open at a block's end is a row for each of its indents; the lines that look
    further back meet those by file and indent, and a running maximum over the blocks before says which is nearest. A
    null indent (a blank line) is no line.
    """
    rows = lines.where("indent IS NOT NULL").select("file", F.col("line_no").cast("long").alias("line_no"), F.col("indent").cast("long").alias("indent"), _block(size).cast("long").alias("block"))
    inside = durable(rows.groupBy("file", "block").applyInPandas(_resolved, "file " + lines.schema["file"].dataType.simpleString() + ", line_no long, indent long, block long, parent long"), "inside")
    # Open at a block's end: lines after which no line of the block has an indent as small; the last one of each indent, less those hidden.
    last = inside.groupBy("file", "block", "indent").agg(F.max("line_no").alias("line_no"))
    hidden = F.max("line_no").over(Window.partitionBy("file", "block").orderBy("indent").rowsBetween(Window.unboundedPreceding, -1))
    open_ = last.withColumn("_later", hidden).where("_later IS NULL OR _later < line_no").select("file", "block", F.col("indent").alias("_indent"), F.col("line_no").alias("_line"))
    looking = inside.where("parent IS NULL").select("file", "indent").distinct()
    nearest = looking.join(open_, "file").where("_indent < indent").groupBy("file", "indent", "block").agg(F.max("_line").alias("_line"))
    asked = inside.where("parent IS NULL").select("file", "indent", "block").distinct().join(nearest, ["file", "indent", "block"], "full")
    before = F.max("_line").over(Window.partitionBy("file", "indent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    found = asked.select("file", "indent", "block", before.alias("_before"))
    out = inside.join(found, ["file", "indent", "block"], "left")
    return out.select("file", "line_no", "indent", F.coalesce("parent", "_before").alias("parent"))


def indent_of(raw: Column) -> Column:
    """Leading spaces; null for a blank line."""
    return F.when(raw.rlike(r"\S"), F.length(F.regexp_extract(raw, "^ *", 0)))
