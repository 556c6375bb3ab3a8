"""SQL servers: parallel reads by ranges of a key, statements that the server runs, and the way back.

A table is read by as many connections as asked for, each with a range of a whole-number column
whose ends the server tells; filters, projections, aggregates and limits that Spark can push go into
the statements. Tables are named as the server stores their names. What a server must compute itself is given as a query. An embedded Derby database
(its driver comes with Spark) serves one JVM only, so on a cluster the URL must be a server's.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows fetched or sent at a time.
BATCH = 10_000


def _catalog(spark: SparkSession, url: str, options: dict) -> str:
    """A catalog of the session for a server; only tables read through one have aggregates pushed."""
    name = "sql_" + hashlib.md5(repr((url, sorted(options.items()))).encode()).hexdigest()[:12]
    conf = {"": "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog", ".url": url}
    conf |= {f".{k}": v for k, v in ({"pushDownAggregate": "true", "pushDownLimit": "true", "fetchsize": str(BATCH)} | options).items()}
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.catalog.{name}{k}", v)
    return name


def write_table(df: DataFrame, url: str, table: str, mode: str = "error", connections: int = 8, **options) -> None:
    """The rows as a table, by at most so many connections; a task that is run again may send its batches twice, so keep a key on the table."""
    df.coalesce(connections).write.format("jdbc").options(url=url, dbtable=table, batchsize=BATCH, **options).mode(mode).save()


def query(spark: SparkSession, url: str, statement: str, **options) -> DataFrame:
    """The rows of a statement that the server runs."""
    return spark.read.format("jdbc").options(url=url, query=statement, fetchsize=BATCH, **options).load()


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, connections: int = 8, **options) -> DataFrame:
    """A table; with ``key``, a whole-number column, in ranges, one connection each. Rows with a null key come with the first."""
    name = f"{_catalog(spark, url, options)}.`{table}`"
    if key is None:
        return spark.read.table(name)
    low, high = spark.read.table(name).agg(F.min(key), F.max(key)).head()
    ranges = {} if low is None or high == low else {"partitionColumn": key, "lowerBound": low, "upperBound": int(high) + 1, "numPartitions": connections}
    return spark.read.options(**ranges).table(name)


def count_ledger(spark: SparkSession, url: str, tables: list[str], **options) -> DataFrame:
    """(table, n): true counts, each made by the server; estimates aren't used."""
    counts = [query(spark, url, f"SELECT count(*) AS n FROM {t}", **options).select(F.lit(t).alias("table"), F.col("n").cast("long").alias("n")) for t in tables]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def tsv_lines(df: DataFrame) -> DataFrame:
    """(line): columns joined by tabs as a batch client prints them; NULL for a null, backslash escapes for tabs, line ends and backslashes."""
    def cell(c: str):
        text = F.col(f"`{c}`").cast("string")
        for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        return F.coalesce(text, F.lit("NULL"))

    return df.select(F.concat_ws("\t", *(cell(c) for c in df.columns)).alias("line"))
