"""An SQL server as source and sink; here the Derby database that comes with Spark, which serves one JVM.

On a session with executors of their own the tables can't be shared that way; there a server is named
by the setting ``spark.lathe.jdbc.url``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.plans.registry import query
from lathe.shared import shared_folder
from lathe.sources import sql
from lathe.tables import load


def _url(spark) -> str:
    given = spark.conf.get("spark.lathe.jdbc.url", "")
    return given or f"jdbc:derby:memory:{shared_folder(spark, 'sql').rsplit('/', 1)[-1]};create=true"


@query("SELECT c_mktsegment, count(*) AS n, max(c_custkey) AS last FROM customer WHERE c_nationkey = 3 GROUP BY 1")
def sql_pushed(spark, d):
    """A table written to a server, read in ranges; filter and aggregate are pushed where ranges allow."""
    url = _url(spark)
    sql.write_table(load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), url, "CUSTOMERS")
    rows = sql.read_table(spark, url, "CUSTOMERS", "c_custkey", 4).where("c_nationkey = 3")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.max("c_custkey").alias("last"))


@query("SELECT 'CUSTOMERS' AS \"table\", count(*) AS n FROM customer UNION ALL SELECT 'NATIONS', count(*) FROM nation")
def sql_ledger(spark, d):
    url = _url(spark)
    sql.write_table(load(spark, d, "customer").select("c_custkey"), url, "CUSTOMERS")
    sql.write_table(load(spark, d, "nation").select("n_nationkey"), url, "NATIONS")
    return sql.count_ledger(spark, url, ["CUSTOMERS", "NATIONS"])


@query("SELECT n_nationkey || chr(9) || 'a' || chr(92) || 't' || n_name || chr(9) || CASE WHEN n_regionkey = 1 THEN 'NULL' ELSE CAST(n_regionkey AS VARCHAR) END AS line FROM nation WHERE n_nationkey < 20")
def sql_lines(spark, d):
    """The result of a statement, as lines of tab-separated cells."""
    url = _url(spark)
    rows = load(spark, d, "nation").select("n_nationkey", F.concat(F.lit("a\t"), "n_name").alias("n_name"), F.when(F.col("n_regionkey") != 1, F.col("n_regionkey")).alias("region"))
    sql.write_table(rows, url, "NATIONS", createTableColumnTypes="n_name VARCHAR(99)")
    return sql.tsv_lines(sql.query(spark, url, 'SELECT * FROM NATIONS WHERE "n_nationkey" < 20'))
