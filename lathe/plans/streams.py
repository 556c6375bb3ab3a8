"""Events: attribution, requests, batches, and imports of what has changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.plans.registry import query
from lathe.shared import shared_folder
from lathe.streaming import tail
from lathe.tables import load


@query("SELECT event_id, event_type = 'click' AS is_own, CASE WHEN event_type = 'click' THEN 'me' ELSE 'u' || user_id END AS nick FROM events")
def own_events(spark, d):
    e = load(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "own_public").otherwise(F.col("event_type")).alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sender"))
    return tail.own_events(e, "kind", "sender", F.lit("me")).select("event_id", "is_own", "nick")


@query("SELECT doc_id, CASE WHEN strlen(text) <= 2000 THEN split_part(text, chr(10), 1) END AS request FROM documents")
def first_requests(spark, d):
    return load(spark, d, "documents").select("doc_id", tail.first_request(F.col("text"), 2000).alias("request"))


_BATCH = "SELECT user_id, event_id, event_type, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS BIGINT) AS batch FROM events"


@query(f"SELECT user_id, batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM ({_BATCH}) GROUP BY ALL")
def batches_of_fifty(spark, d):
    """Batches as JSON arrays, read again."""
    e = load(spark, d, "events").select("user_id", "event_id", "event_type")
    back = tail.unbatched(tail.batches_of(e, ["user_id"], ["event_id"]), ["user_id"], "event_id: bigint, event_type: string")
    return back.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT page_id AS path FROM pages WHERE page_id % 10 = 3 OR page_id % 4 = 1")
def changed_import(spark, d):
    """Of a second listing, only files that are new or changed since the first are imported."""
    listing = load(spark, d, "pages").select(F.col("page_id").alias("path"), F.length("html").alias("size"), F.md5("html").alias("stamp"))
    state = shared_folder(spark, "state")
    tail.import_changed(listing.where("path % 4 <> 1"), state, lambda changed: None)
    again = listing.withColumn("stamp", F.when(F.col("path") % 10 == 3, F.lit("new")).otherwise(F.col("stamp")))
    out = shared_folder(spark, "imported")
    tail.import_changed(again, state, lambda changed: changed.select("path").write.parquet(out))
    return spark.read.schema("path long").parquet(out)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS run, CASE WHEN event_id % 3 = 0 THEN 30 WHEN event_id % 2 = 0 THEN 20 ELSE 10 END * event_id AS value FROM events")
def repeated_requery(spark, d):
    """Three runs that read overlapping rows again, as batches of a stream; the newest reading of each row stays."""
    base, files = shared_folder(spark, "requery"), 4
    events = load(spark, d, "events").select("event_id")
    for run, rows in enumerate((events, events.where("event_id % 2 = 0"), events.where("event_id % 3 = 0"))):
        rows.select("event_id", F.lit(run).alias("run"), (F.col("event_id") * (10 * run + 10)).alias("value")).repartition(files).write.mode("append").parquet(f"{base}/in")
    schema = "event_id long, run int, value long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    tail.upsert_stream(stream, ["event_id"], [F.desc("run")], f"{base}/table", f"{base}/state")
    return tail.upserted(spark, f"{base}/table", schema)
