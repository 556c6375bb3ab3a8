"""Events offered by a producer: tails of a ring, log lines that settle late."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.plans.registry import query
from lathe.shared import shared_folder
from lathe.sources import paged, ring
from lathe.streaming import settle
from lathe.tables import load


def _feed(spark, events):
    feed = shared_folder(spark, "feed")
    ring.publish(events, feed, "event_id")
    return feed


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500")
def ring_after(spark, d):
    """A stream from a cursor to the end of what the producer holds; the stored table is the batch's."""
    events = load(spark, d, "events").select("event_id", "user_id", "event_type")
    stored = shared_folder(spark, "stored")
    ring.take_new(ring.tail(spark, _feed(spark, events), events.schema, "event_id", after=500), ["event_id"], stored, shared_folder(spark, "state"))
    return ring.stored_rows(spark, stored, events.schema).drop("batch")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > (SELECT max(event_id) - 2000 FROM events)")
def ring_replay(spark, d):
    """A cursor ahead of the producer gets the whole ring, and no more than the ring."""
    events = load(spark, d, "events").select("event_id", "user_id", "event_type")
    stored = shared_folder(spark, "stored")
    ring.take_new(ring.tail(spark, _feed(spark, events), events.schema, "event_id", after=1 << 50, ring=2000), ["event_id"], stored, shared_folder(spark, "state"))
    return ring.stored_rows(spark, stored, events.schema).drop("batch")


@query("SELECT event_id, event_type, event_id % 4 = 0 AS early FROM events")
def ring_restart(spark, d):
    """The producer restarts and counts from its beginning: all it holds is offered again, and stored once."""
    events = load(spark, d, "events").select("event_id", "event_type")
    feed, stored, state = (shared_folder(spark, name) for name in ("feed", "stored", "state"))
    for epoch, rows in enumerate((events.where("event_id % 4 = 0"), events)):
        ring.publish(rows, feed, "event_id", epoch)
        ring.take_new(ring.tail(spark, feed, events.schema, "event_id"), ["event_id"], stored, state)
    return ring.stored_rows(spark, stored, events.schema).select("event_id", "event_type", (F.col("batch") == 0).alias("early"))


@query("SELECT event_type, count(*) AS n, sum(event_id) AS ids FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 4000 GROUP BY 1")
def ring_now(spark, d):
    """The same source as a batch: what the producer holds at this moment."""
    events = load(spark, d, "events").select("event_id", "event_type")
    held = ring.tail(spark, _feed(spark, events), events.schema, "event_id", ring=4000, stream=False)
    return held.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""WITH l AS (SELECT o_custkey, min(o_orderkey) FILTER (o_orderkey % 2 = 0) AS early, min(o_orderkey) AS any_ FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT c_custkey, c_mktsegment, coalesce(early, any_) AS line, any_ IS NOT NULL AS logged FROM customer LEFT JOIN l ON c_custkey = o_custkey""")
def settled_lines(spark, d):
    """Customers wait for their orders: some are there, some come a batch later, and the rest time out."""
    base, files = shared_folder(spark, "settle"), 4
    events = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    lines = load(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("line"))
    events.repartition(files).write.parquet(f"{base}/events")
    for late in (0, 1):  # the older files are the first batch
        lines.where(F.col("line") % 2 == late).repartition(files).write.mode("append").parquet(f"{base}/lines")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{base}/{name}")
    stream = settle.settled(read("events", events.schema), read("lines", lines.schema), ["c_custkey"], "line")
    settle.run_until_settled(stream, f"{base}/out", f"{base}/state", 120)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def paged_scan(spark, d):
    """A table behind pages: three of its fields, and the filter in the request."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")
    url = paged.store_pages(orders, shared_folder(spark, "pages"), F.asc("o_orderkey"), limit=200)
    rows = paged.table_records(spark, url, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double", limit=200, pages=20)
    return rows.where("o_orderstatus = 'F' AND o_totalprice > 100000").drop("o_orderstatus")


@query("""SELECT o_orderkey, count(l_orderkey) AS n, coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1""")
def linked_scan(spark, d):
    """The records linked with some parents, by one request for each batch of parents."""
    lines = load(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("quantity"))
    url = paged.store_links(lines.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", shared_folder(spark, "links"), 1000)
    urgent = load(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    found = paged.linked_records(urgent, "o_orderkey", url, "quantity long", 1000)
    return urgent.join(found, "o_orderkey", "left").groupBy("o_orderkey").agg(F.count("quantity").alias("n"), F.coalesce(F.sum("quantity"), F.lit(0)).cast("long").alias("quantity"))
