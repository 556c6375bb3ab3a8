"""Reports: sorted, reconciled, over labels and ranges of time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lathe.functions import text as T
from lathe.operators import bom, metrics, order, reconcile
from lathe.plans.registry import query
from lathe.tables import load, timed_events


@query("""SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS place FROM part GROUP BY 1""")
def sort_by_count(spark, d):
    return order.with_place(load(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")), F.desc("n"), F.asc("p_brand"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS amount, row_number() OVER (ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS place FROM lineitem")
def sort_by_amount(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("amount"))
    return order.with_place(rows, F.desc("amount"), F.asc("l_orderkey"), F.asc("l_linenumber"))


@query("""WITH s AS (SELECT p_partkey, row_number() OVER (ORDER BY p_brand DESC, p_type DESC, p_partkey) AS ordinal FROM part) SELECT p_partkey, ordinal, row_number() OVER (ORDER BY ordinal DESC) AS place FROM s""")
def sort_by_reversed_ordinal(spark, d):
    """The place in one order, descending, is the order of the report."""
    first = order.with_place(load(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.desc("p_brand"), F.desc("p_type"), F.asc("p_partkey"), place="ordinal")
    return order.with_place(first.select("p_partkey", "ordinal"), F.desc("ordinal"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY encode(coalesce(source, '')), doc_id) AS place FROM documents""")
def sort_bytes_stable(spark, d):
    """Byte order of one key; equal keys stay in input order, which the id states."""
    return order.with_place(load(spark, d, "documents").select("doc_id", "source"), order.bytes_order("source"), F.asc("doc_id")).select("doc_id", "place")


_KIND = "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END"


@query(f"SELECT doc_id, row_number() OVER (ORDER BY coalesce({_KIND}, ''), coalesce(source, ''), coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents")
def sort_composite_missing(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.expr(_KIND).alias("kind"), "source", F.col("doc_id").cast("string").alias("name"))
    return order.with_place(rows, *order.missing_first("kind", "source", "name")).select("doc_id", "place")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 6")
def first_six(spark, d):
    return order.first_in_order(load(spark, d, "events").select("user_id", "event_id"), ["user_id"], 6, F.asc("event_id"))


@query("SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS n")
def scalar_sum(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("lathe_orders")
    load(spark, d, "lineitem").createOrReplaceTempView("lathe_lineitem")
    return spark.sql("SELECT (SELECT count(*) FROM lathe_orders) + (SELECT count(*) FROM lathe_lineitem) AS n")


@query("SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 2 ORDER BY n_name")
def catalogue_filter(spark, d):
    return load(spark, d, "nation").where("n_regionkey = 1 AND n_nationkey <> 2").orderBy("n_name").select("n_name")


@query("SELECT count(*) FILTER (l_quantity > 49) > 0 AS failed, count(*) FILTER (l_quantity > 49) AS n_failed, count(*) AS n FROM lineitem")
def any_failure(spark, d):
    return reconcile.any_failed(load(spark, d, "lineitem"), F.col("l_quantity") > 49)


@query("""SELECT l_orderkey, l_linenumber, round(p_retailprice / 100 * l_quantity, 4) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey""")
def strict_lookup(spark, d):
    """Every line's part must be known."""
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return reconcile.strict_join(load(spark, d, "lineitem"), part, ["l_partkey"]).select("l_orderkey", "l_linenumber", F.round(bom.scaled(F.col("p_retailprice"), F.col("l_quantity")), 4).alias("amount"))


_MEASURES = "UNPIVOT (SELECT p_brand, sum(p_size) AS size, sum(p_retailprice) AS price, count(*) AS pieces FROM part GROUP BY 1) ON size, price, pieces INTO NAME nutrient VALUE v"


@query(f"SELECT p_brand, nutrient, round(v / ref, 6) AS share FROM (SELECT p_brand, nutrient, CAST(v AS DOUBLE) AS v FROM ({_MEASURES})) JOIN (VALUES ('size', 50.0), ('price', 1000.0), ('none', 1.0)) r(nutrient, ref) USING (nutrient)")
def share_of_reference(spark, d):
    """Measures of wide rows against reference rows by name; a name on one side only is dropped."""
    wide = load(spark, d, "part").groupBy("p_brand").agg(F.sum("p_size").cast("double").alias("size"), F.sum("p_retailprice").cast("double").alias("price"), F.count("*").cast("double").alias("pieces"))
    ref = spark.createDataFrame([("size", 50.0), ("price", 1000.0), ("none", 1.0)], "nutrient string, ref double")
    long = wide.unpivot(["p_brand"], ["size", "price", "pieces"], "nutrient", "v")
    return long.join(ref, "nutrient").select("p_brand", "nutrient", F.round(bom.share(F.col("v"), F.col("ref")), 6).alias("share"))


_RATES = """c AS (SELECT user_id % 5 AS host, user_id, event_type, ts, event_id, sum(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM events),
w AS (SELECT *, row_number() OVER k AS n, lead(v) OVER k AS v0, lead(ts) OVER k AS t0 FROM c WINDOW k AS (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)),
r AS (SELECT host, user_id, event_type, (CASE WHEN v >= v0 THEN v - v0 ELSE v END) / nullif((epoch_us(ts) - epoch_us(t0)) / 1e6, 0) AS rate FROM w WHERE n = 1 AND t0 IS NOT NULL)"""


def _rates(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counter = timed_events(spark, d).withColumn("v", F.sum("value").over(w)).withColumn("host", F.col("user_id") % 5)
    return metrics.irate(counter, ["host", "user_id", "event_type"], "ts", "event_id", "v")


@query(f"WITH {_RATES} SELECT host, event_type, count(rate) AS n, round(avg(rate), 6) AS mean, round(sum(rate), 6) AS sum FROM r WHERE rate IS NOT NULL GROUP BY ALL")
def rates_by_group(spark, d):
    out = metrics.group_rates(_rates(spark, d), ["host", "event_type"])
    return out.select("host", "event_type", "n", F.round("mean", 6).alias("mean"), F.round("sum", 6).alias("sum"))


@query(f"""WITH {_RATES}, cpus AS (SELECT host, count(*) AS n FROM (SELECT user_id % 5 AS host, user_id FROM events GROUP BY ALL) GROUP BY 1),
idle AS (SELECT host, avg(s) AS s FROM (SELECT host, event_type, sum(rate) AS s FROM r WHERE event_type = 'click' AND rate IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT host, round((n - s) * 100 / n, 6) AS busy FROM cpus JOIN idle USING (host)""")
def busy_percent(spark, d):
    """Counted cpus less their summed idle rates, as a share of the cpus; users are cpus, clicks their idle mode."""
    samples = load(spark, d, "events").select((F.col("user_id") % 5).alias("host"), "user_id")
    return metrics.busy_share(samples, _rates(spark, d), "host", "user_id", "event_type", "click").select("host", F.round("value", 6).alias("busy"))


@query(f"WITH {_RATES} SELECT host, round(avg(s), 6) AS mean FROM (SELECT host, event_type, sum(rate) AS s FROM r WHERE rate IS NOT NULL GROUP BY ALL) GROUP BY 1")
def mean_of_sums(spark, d):
    """Rates added up by two labels, then averaged over one of them."""
    return metrics.mean_of_sums(_rates(spark, d), ["host"], ["event_type"]).select("host", F.round("value", 6).alias("mean"))


@query("""WITH m AS (SELECT max(ts) AS newest FROM events) SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS at, count(*) AS n, round(avg(value), 6) AS mean FROM events, m WHERE ts >= newest - INTERVAL 6 HOUR GROUP BY ALL""")
def last_hours(spark, d):
    recent = metrics.last_range(timed_events(spark, d), "ts", "6 HOURS", "5 minutes")
    return recent.groupBy("event_type", F.col("at").cast("timestamp_ntz").alias("at")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_TREE = "SELECT o_orderkey AS path, o_totalprice AS size, md5(o_orderstatus) AS hash FROM orders"


@query(f"""WITH a AS ({_TREE}), b AS (SELECT path, CASE WHEN path % 5 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN path % 3 = 0 THEN md5('x') ELSE hash END AS hash FROM a WHERE path % 7 <> 0)
SELECT a.path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.size = b.size THEN 'matching' ELSE 'differ' END AS by_size, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.hash = b.hash THEN 'matching' ELSE 'differ' END AS by_content FROM a LEFT JOIN b ON a.path = b.path""")
def tree_compare(spark, d):
    """A tree against its copy, by size and by content."""
    a = load(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size"), F.md5("o_orderstatus").alias("hash"))
    b = a.where("path % 7 <> 0").select("path", F.expr("CASE WHEN path % 5 = 0 THEN size + 1 ELSE size END").alias("size"), F.expr("CASE WHEN path % 3 = 0 THEN md5('x') ELSE hash END").alias("hash"))
    sizes, contents = reconcile.tree_verdicts(a, b).withColumnRenamed("verdict", "by_size"), reconcile.tree_verdicts(a, b, by_content=True).withColumnRenamed("verdict", "by_content")
    return sizes.join(contents, "path")


_CREDENTIAL = "CASE WHEN page_id % 4 = 0 THEN 'android://HASH' || page_id || '@com.Example.App' || page_id % 9 || '/' WHEN page_id % 4 = 1 THEN 'androidapp://org.Some.App' || page_id % 9 WHEN page_id % 4 = 2 THEN ' ' || url ELSE regexp_extract(url, '^[^:]+://(.*)', 1) END"


@query(f"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'app:com.example.app' || page_id % 9 WHEN page_id % 4 = 1 THEN 'app:org.some.app' || page_id % 9 ELSE regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\\.', '') END AS site FROM pages""")
def login_sites(spark, d):
    """Sites of credentials, those of apps and those without a scheme included."""
    return load(spark, d, "pages").select("page_id", T.site(F.expr(_CREDENTIAL)).alias("site"))
