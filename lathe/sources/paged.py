"""Tables and links behind a paged JSON interface, read by many tasks.

A page is ``{"list": [record, ...], "pageInfo": {"totalRows": n}}``. A URL may be http(s), or a path of any
file system that Arrow opens (pages that were stored). ``{page}``, ``{offset}``, ``{limit}``, ``{fields}`` and
``{where}`` in it are filled in. The schema asked for is the projection: only its fields are requested.
Comparisons with constants go into ``where`` and are tested on what comes back too, so a server that
ignores them does no harm; other filters stay with Spark.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").schema("id long, name string").option("url", "...?offset={offset}&limit={limit}").load()

The first page tells how many rows there are; where it doesn't, pages are tried at doubling distances
until one is empty. A partition is a range of pages, fetched one at a time, and the last partition
goes on until a page is empty, so rows added meanwhile are read too. A request is tried
again a few times; a task that dies fetches its pages again.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lathe.operators.order import with_place
from lathe.sources.files import write_named

_COMPARE = {EqualTo: ("eq", pc.equal), GreaterThan: ("gt", pc.greater), GreaterThanOrEqual: ("gte", pc.greater_equal), LessThan: ("lt", pc.less), LessThanOrEqual: ("lte", pc.less_equal)}
TRIES = 4


@dataclass
class Pages(InputPartition):
    first: int
    last: int
    open_end: bool


def fetch(url: str) -> dict:
    """The document at a URL; no file there is an empty page."""
    for tried in range(TRIES):
        try:
            if url.startswith(("http:", "https:")):
                with urllib.request.urlopen(url, timeout=60) as reply:
                    return json.load(reply)
            fs, path = pafs.FileSystem.from_uri(url)
            with fs.open_input_stream(path) as file:
                return json.loads(file.read())
        except FileNotFoundError:
            return {"list": []}
        except urllib.error.HTTPError as e:
            if e.code < 500 and e.code != 429 or tried == TRIES - 1:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if tried == TRIES - 1:
                raise
        time.sleep(0.2 * 4**tried)
    raise AssertionError("unreachable")


def _batch(records: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Records as columns; numbers, dates and times may come as text, and what a record lacks is null."""

    def column(f: pa.Field) -> pa.Array:
        values = [r.get(f.name) for r in records]
        plain = pa.types.is_string(f.type) or pa.types.is_nested(f.type) or not any(isinstance(v, str) for v in values)
        return pa.array(values, f.type) if plain else pa.array([None if v is None else str(v) for v in values], pa.string()).cast(f.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.url, self.limit, self.per_task = options["url"], int(options.get("limit", 1000)), int(options.get("pages", 50))
        self.schema, self.tests = to_arrow_schema(schema), []

    def pushFilters(self, filters):
        for f in filters:
            plain = type(f) in (IsNotNull, *_COMPARE) and len(f.attribute) == 1  # a column of its own, no field of a struct
            if plain and isinstance(f, IsNotNull):
                self.tests.append((f.attribute[0], "notnull", None))
            elif plain and type(f.value) in (int, float, str) and not set(",()~") & set(str(f.value)):
                self.tests.append((f.attribute[0], _COMPARE[type(f)][0], f.value))
            else:
                yield f

    def _page(self, n: int) -> tuple[list[dict], dict]:
        where = "~and".join(f"({name},{op}{'' if value is None else f',{value}'})" for name, op, value in self.tests)
        quote = urllib.parse.quote
        doc = fetch(self.url.format(page=n, offset=n * self.limit, limit=self.limit, fields=quote(",".join(self.schema.names)), where=quote(where)))
        return doc["list"], doc.get("pageInfo", {})

    def partitions(self) -> list[Pages]:
        records, info = self._page(0)
        if "totalRows" in info:
            count = -(-info["totalRows"] // self.limit)
        else:
            count = 1
            while records:
                records, _ = self._page(count)
                count *= 2
        starts = range(0, max(count, 1), self.per_task)
        return [Pages(s, min(s + self.per_task, count), s == starts[-1]) for s in starts]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        n = partition.first
        while n < partition.last or partition.open_end:
            records, _ = self._page(n)
            if not records:
                break
            batch = _batch(records, self.schema)
            for name, op, value in self.tests:
                column = batch.column(name)
                test = pc.is_valid(column) if op == "notnull" else next(c for o, c in _COMPARE.values() if o == op)(column, pa.scalar(value).cast(column.type))
                batch = batch.filter(test)
            yield batch
            n += 1


class PagedSource(DataSource):
    """Options: url, limit (records of a page), pages (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self):
        raise ValueError("a paged table is read with a schema: .schema(...)")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options, schema)


def table_records(spark: SparkSession, url: str, schema: StructType | str, limit: int = 1000, pages: int = 50) -> DataFrame:
    """All records of a paged table."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged").schema(schema).option("url", url).option("limit", limit).option("pages", pages).load()


def linked_records(parents: DataFrame, key: str, url: str, schema: str, size: int = 1000) -> DataFrame:
    """(key, the fields of ``schema``): the records linked with each parent, one request for a batch of parents instead of one each.

    A batch is the parents of ``size`` neighbouring keys (whole numbers; a null one has no links). ``{batch}`` and
    ``{keys}`` of the URL are filled in; the page's records are ``{key: ..., "links": [record, ...]}``.
    """
    out = StructType([parents.schema[key], *StructType.fromDDL(schema).fields])
    child = to_arrow_schema(StructType.fromDDL(schema))
    kind = to_arrow_schema(StructType([parents.schema[key]])).field(0)
    batches = parents.select(F.col(key).alias("k")).where("k IS NOT NULL").groupBy(F.floor(F.col("k") / size).alias("batch")).agg(F.collect_set("k").alias("keys"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch, keys in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                wanted = set(keys)
                found = fetch(url.format(batch=batch, keys=urllib.parse.quote(",".join(map(str, sorted(keys))))))["list"]
                rows = [(r[key], link) for r in found if r[key] in wanted for link in r["links"]]
                links = _batch([link for _, link in rows], child)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], kind.type), *links.columns], schema=pa.schema([kind, *child]))

    return batches.mapInArrow(run, out)


def store_pages(df: DataFrame, folder: str, *order: Column, limit: int = 1000) -> str:
    """Keep a table as pages, in a total order; the URL to read them by."""
    total = df.count()
    rows = with_place(df, *order).select(F.floor((F.col("place") - 1) / limit).alias("page"), "place", F.struct(*df.columns).alias("row"))
    pages = rows.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("place", "row"))).alias("rows"))
    doc = F.to_json(F.struct(F.col("rows.row").alias("list"), F.struct(F.lit(total).alias("totalRows")).alias("pageInfo")))
    write_named(pages.select(F.format_string("%d.json", "page").alias("name"), doc.alias("doc")), folder)
    return folder + "/{page}.json"


def store_links(df: DataFrame, key: str, folder: str, size: int = 1000) -> str:
    """Keep the records of each key as one document a batch of keys; the URL to read them by."""
    rest = [c for c in df.columns if c != key]
    by = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.struct(*rest)).alias("links"))
    docs = by.groupBy(F.floor(F.col(key) / size).alias("batch")).agg(F.to_json(F.struct(F.collect_list(F.struct(key, "links")).alias("list"))).alias("doc"))
    write_named(docs.select(F.format_string("%d.json", "batch").alias("name"), "doc"), folder)
    return folder + "/{batch}.json"
