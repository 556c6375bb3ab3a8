"""vCards: folded lines joined and records cut in files of any size, and the way back.

A line that begins with a space or a tab goes on with the one before it. Both that and the record a line
belongs to are marks carried along numbered lines (``operators.lines.carried``), so a file is never one row
and a task never holds more than a block of it or a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.operators.lines import BLOCK, carried
from lathe.sources.files import numbered_lines

#: Octets of a line, at most, by the format; texts beyond ASCII are folded at a quarter of that in characters.
WIDTH = 72

_ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), (",", "\\,"), (";", "\\;"))


def escaped(text: Column) -> Column:
    for plain, mark in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescaped(text: Column) -> Column:
    """Marks are read from the left, so that an escaped backslash before an n stays one."""
    hold = "\x00"
    text = F.replace(text, F.lit("\\\\"), F.lit(hold))
    for plain, mark in (("\n", "\\n"), ("\n", "\\N"), (",", "\\,"), (";", "\\;")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return F.replace(text, F.lit(hold), F.lit("\\"))


def logical_lines(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """(file, line_no, raw) of physical lines -> the same of unfolded ones, each with its first line's number."""
    goes_on = F.col("raw").rlike("^[ \t]")
    begun = carried(lines.select("file", "line_no", "raw"), F.when(~goes_on, F.col("line_no")), "_start", size).where("_start IS NOT NULL")
    piece = F.when(F.col("line_no") == F.col("_start"), F.col("raw")).otherwise(F.substring("raw", 2, 1 << 30))
    by = begun.groupBy("file", "_start").agg(F.sort_array(F.collect_list(F.struct("line_no", piece.alias("p")))).alias("pieces"))
    return by.select("file", F.col("_start").alias("line_no"), F.concat_ws("", "pieces.p").alias("raw"))


def read_vcards(spark: SparkSession, root: str, glob: str = "*.vcf", size: int = BLOCK) -> DataFrame:
    """(file, card, fields): of each record BEGIN:VCARD to END:VCARD its first line's number and its properties in order.

    A property is (name, params, value): name in capitals, parameters as a map of capital names to text, the value with
    its escapes, which ``unescaped`` reads (a structured value is split before). Lines outside of records are dropped.
    """
    lines = logical_lines(numbered_lines(spark, root, glob).withColumn("raw", F.rtrim(F.col("raw"), F.lit("\r"))), size)
    mark = F.upper(F.trim("raw"))
    state = F.when(mark == "BEGIN:VCARD", F.col("line_no")).when(mark == "END:VCARD", F.lit(-1)).cast("long")
    inside = carried(lines, state, "card", size).where((F.col("card") >= 0) & (F.col("card") != F.col("line_no")))
    head, value = F.regexp_extract("raw", '^((?:[^":]|"[^"]*")*):', 1), F.regexp_extract("raw", '(?s)^(?:[^":]|"[^"]*")*:(.*)$', 1)
    pieces = F.split(head, ';(?=(?:[^"]*"[^"]*")*[^"]*$)')
    pair = lambda p: F.struct(F.upper(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), F.replace(F.regexp_replace(p, "^[^=]*=", ""), F.lit('"'), F.lit(""))).otherwise(F.lit("")).alias("v"))
    params = F.map_from_entries(F.array_distinct(F.transform(F.slice(pieces, 2, 1000), pair)))
    prop = F.struct("line_no", F.upper(pieces[0]).alias("name"), params.alias("params"), value.alias("value"))
    rows = inside.select("file", "card", prop.alias("p")).where("p.name <> ''")
    by = rows.groupBy("file", "card").agg(F.collect_list("p").alias("ps"))
    in_order = F.array_sort("ps", lambda a, b: F.when(a["line_no"] < b["line_no"], -1).when(a["line_no"] > b["line_no"], 1).otherwise(0))
    return by.select("file", "card", F.transform(in_order, lambda p: F.struct(p["name"].alias("name"), p["params"].alias("params"), p["value"].alias("value"))).alias("fields"))


def property_of(fields: Column, name: str) -> Column:
    """The unescaped value of the first property of a name, or null."""
    return unescaped(F.get(F.filter(fields, lambda p: p["name"] == name), 0)["value"])


def folded(line: Column) -> Column:
    """A line cut into pieces of at most the width; every piece but the first begins with a space."""
    ascii_ = F.octet_length(line) == F.char_length(line)
    cut = lambda n: F.regexp_replace(line, f"(?s)(.{{{n}}})(?=.)", "$1\r\n ")
    return F.when(ascii_, cut(WIDTH)).otherwise(cut(WIDTH // 4))


def write_vcards(df: DataFrame, properties: dict[str, Column], path: str) -> None:
    """A card for each row: version, then the properties (``name;params`` to value) that aren't null, escaped and folded."""
    lines = [F.when(v.isNotNull(), folded(F.concat(F.lit(k + ":"), escaped(v.cast("string"))))) for k, v in properties.items()]
    card = F.concat_ws("\r\n", F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), *lines, F.lit("END:VCARD"))
    df.select(card.alias("value")).write.text(path)
