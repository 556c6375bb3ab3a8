"""Optional values, lists and records inside a column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def non_empty(items: Column) -> Column:
    """The list, or null if it is empty."""
    return F.when(F.size(items) > 0, items)


def head(items: Column) -> Column:
    """The first item, or null."""
    return F.get(items, 0)


def only(items: Column) -> Column:
    """The item of a list of one, else null."""
    return F.when(F.size(items) == 1, F.get(items, 0))


def present(flag: Column) -> Column:
    """True stays, false and null are absent."""
    return F.when(flag, F.lit(True))


def first_filled(*values: Column, default: str) -> Column:
    """The first value that is neither null nor the empty text."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(default))


def key_values(text: Column) -> Column:
    """Map of the ``key=value`` lines of a text; keys upper-cased, of repeated keys the last line stays."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.contains(line, F.lit("=")))
    keys = F.transform(lines, lambda line: F.upper(F.substring_index(line, "=", 1)))
    values = F.transform(lines, lambda line: F.regexp_replace(line, r"^[^=]*=", ""))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["k"]))
    return F.map_from_entries(last)


def sorted_fields(value: Column, kind: DataType) -> Column:
    """A record with its fields in name order, on every level."""
    if isinstance(kind, StructType):
        return F.struct(*(sorted_fields(value[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        return F.transform(value, lambda x: sorted_fields(x, kind.elementType))
    return value


def canonical_json(value: Column, kind: DataType) -> Column:
    """JSON of a record with sorted keys; null fields are left out."""
    return F.to_json(sorted_fields(value, kind))


def concat_map(items: Column, f) -> Column:
    """The lists that ``f`` gives for each item, one after the other."""
    return F.flatten(F.transform(items, f))


def append(*lists: Column) -> Column:
    """One list of all, in order; a null list is empty."""
    return F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))


def join_with(items: Column, mark: str) -> Column:
    """Texts joined by the mark; of an empty or null list, the empty text."""
    return F.coalesce(F.array_join(items, mark), F.lit(""))


def project(record: Column, *names: str) -> Column:
    """The record with these fields only."""
    return F.struct(*(record[n].alias(n) for n in names))


def override(record: Column, **fields: Column) -> Column:
    """The record with these fields instead of, or after, its own."""
    for name, value in fields.items():
        record = record.withField(name, value)
    return record


def to_map(record: Column, names: list[str]) -> Column:
    """List of (mapKey, mapValue) of the fields, in the order given, values as text."""
    return F.array(*(F.struct(F.lit(n).alias("mapKey"), record[n].cast("string").alias("mapValue")) for n in names))


def any_of(items: Column, value: str) -> Column:
    """The value if any item is it, else null: a default that renders as absent."""
    return F.when(F.exists(items, lambda x: x == value), F.lit(value))


def has_word(words: Column, word: Column) -> Column:
    """Whether a list of words, separated by spaces, has the whole word."""
    return F.array_contains(F.split(words, " "), word)


def pruned(value: Column, kind: DataType) -> Column:
    """The value without what is empty, on every level: null elements, empty lists and maps, and records of nothing but those become null."""
    if isinstance(kind, StructType):
        fields = [pruned(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        some = reduce(lambda a, b: a | b, (f.isNotNull() for f in fields), F.lit(False))
        return F.when(some, F.struct(*fields))
    if isinstance(kind, ArrayType):
        kept = F.filter(F.transform(value, lambda x: pruned(x, kind.elementType)), lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, MapType):
        kept = F.map_filter(F.transform_values(value, lambda k, v: pruned(v, kind.valueType)), lambda k, v: v.isNotNull())
        return F.when(F.cardinality(kept) > 0, kept)
    return value


def member_facts(df: DataFrame, context: list[str], members: str, facts: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(context, place, fact, detail): for each nested member what is true of it, with its parent's columns; ``detail`` is what a fact's
    function gives, and null is no fact. Places count from 0."""
    each = df.select(*context, F.posexplode(members).alias("place", "_m"))
    said = F.array(*(F.struct(F.lit(name).alias("fact"), f(F.col("_m")).cast("string").alias("detail")) for name, f in facts.items()))
    return each.select(*context, "place", F.explode(F.filter(said, lambda x: x["detail"].isNotNull())).alias("_f")).select(*context, "place", "_f.*")
