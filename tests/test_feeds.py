"""Streaming sources and stateful streams: cursors, rings, restarts, settling."""

import time

import pytest
from pyspark.sql import functions as F

from lathe.sources import ring
from lathe.streaming import settle

SCHEMA = "seq long, text string, at timestamp"


def _events(spark, numbers, text="e"):
    return spark.range(numbers.start, numbers.stop).toDF("seq").select("seq", F.concat(F.lit(text), "seq").alias("text"), F.timestamp_seconds("seq").alias("at"))


def _run(spark, tmp_path, **options):
    stream = ring.tail(spark, f"file://{tmp_path}/feed", SCHEMA, **options)
    batches = ring.take_new(stream, ["seq", "text"], f"file://{tmp_path}/stored", f"file://{tmp_path}/state")
    return batches, sorted((r.seq, r.text) for r in spark.read.parquet(f"file://{tmp_path}/stored").collect()) if batches else []


def test_ring_follows_its_producer(spark, tmp_path):
    feed = f"file://{tmp_path}/feed"
    ring.publish(_events(spark, range(10)), feed, "seq")
    assert _run(spark, tmp_path, after=6, ring=100) == (1, [(i, f"e{i}") for i in (7, 8, 9)])
    assert _run(spark, tmp_path, after=6, ring=100)[0] == 0  # nothing new, and the cursor is remembered
    ring.publish(_events(spark, range(10, 13)), feed, "seq")
    assert _run(spark, tmp_path, after=0, ring=100) == (1, [(i, f"e{i}") for i in range(7, 13)])
    ring.publish(_events(spark, range(3), "new"), feed, "seq", epoch=1)  # a restart that counts from 0
    assert _run(spark, tmp_path, ring=100) == (1, [(0, "new0"), (1, "new1"), (2, "new2"), *((i, f"e{i}") for i in range(7, 13))])


def test_a_feed_without_a_ring_is_held_whole(spark, tmp_path):
    """However far its numbers reach: from a cursor, and after a restart."""
    feed, far = f"file://{tmp_path}/feed", lambda text: _events(spark, range(4), text).withColumn("seq", F.col("seq") * 1_000_000)
    ring.publish(far("e"), feed, "seq")
    assert sorted(r.text for r in ring.tail(spark, feed, SCHEMA, after=999_999, stream=False).collect()) == ["e1", "e2", "e3"]
    assert _run(spark, tmp_path) == (1, [(i * 1_000_000, f"e{i}") for i in range(4)])
    ring.publish(far("new"), feed, "seq", epoch=1)
    assert _run(spark, tmp_path) == (1, [(i * 1_000_000, f"{w}{i}") for i in range(4) for w in ("e", "new")])


def test_ring_is_bounded_and_replays_once(spark, tmp_path):
    feed = f"file://{tmp_path}/feed"
    ring.publish(_events(spark, range(50)), feed, "seq")
    assert _run(spark, tmp_path, after=999, ring=5) == (1, [(i, f"e{i}") for i in range(45, 50)])
    ring.publish(_events(spark, range(50, 60)), feed, "seq")
    assert _run(spark, tmp_path, ring=5)[1] == [(i, f"e{i}") for i in [*range(45, 50), *range(55, 60)]]  # 50 to 54 fell out of the ring
    held = ring.tail(spark, feed, SCHEMA, after=57, stream=False)
    assert [(r.seq, r.at.timestamp()) for r in held.orderBy("seq").collect()] == [(58, 58.0), (59, 59.0)]
    assert ring.tail(spark, feed, "text string", after=58, stream=False).collect()[0].text == "e59"  # the sequence needn't be read


def test_empty_feed(spark, tmp_path):
    assert ring.tail(spark, f"file://{tmp_path}/none", SCHEMA, stream=False).collect() == []
    assert _run(spark, tmp_path, after=3) == (1, [])


def test_batch_that_failed_is_read_again(spark, tmp_path, monkeypatch):
    """The offsets of a batch are logged before it runs; if it dies, the next run repeats exactly it."""
    feed = f"file://{tmp_path}/feed"
    ring.publish(_events(spark, range(20)), feed, "seq")
    stream = ring.tail(spark, feed, SCHEMA, after=4)
    query = stream.writeStream.foreachBatch(lambda rows, n: 1 / 0).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="division"):
        query.awaitTermination()
    ring.publish(_events(spark, range(20, 25)), feed, "seq")
    assert _run(spark, tmp_path, after=4) == (1, [(i, f"e{i}") for i in range(5, 20)])
    assert _run(spark, tmp_path, after=4) == (1, [(i, f"e{i}") for i in range(5, 25)])


def test_events_settle_or_time_out(spark, tmp_path):
    """A line before its event, with it, after it in time, after the deadline, and never; the least of several lines counts."""
    base, schemas = f"file://{tmp_path}", {"events": "key string, event long", "lines": "key string, line long"}

    def put(name, *rows):
        spark.createDataFrame(rows, schemas[name]).coalesce(1).write.mode("append").parquet(f"{base}/{name}")

    def stream():
        read = lambda name: spark.readStream.schema(schemas[name]).parquet(f"{base}/{name}")
        return settle.settled(read("events"), read("lines"), ["key"], "line", 6000)

    put("lines", ("first", 7), ("both", 9), ("both", 8), ("unread", None))
    put("events", ("both", 1), ("late", 2), ("late", 3), ("never", 4), (None, 5), ("unread", 6))
    with settle.rocksdb(spark):
        query = stream().writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(processingTime="100 milliseconds").start()
        idle = settle.wait_until_idle(query, 0, 60)
        put("lines", ("late", 30), ("late", 20))
        put("events", ("first", 7))
        settle.wait_until_idle(query, max(idle, time.time()), 60)
        query.stop()  # state and timers are in the checkpoint
    settle.run_until_settled(stream(), f"{base}/out", f"{base}/state", 6000)
    put("lines", ("never", 1))
    put("events", ("first", 8), ("never", 9))
    settle.run_until_settled(stream(), f"{base}/out", f"{base}/state", 0)
    got = {r.event: (r.key, r.line, r.logged) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {
        1: ("both", 8, True), 2: ("late", 20, True), 3: ("late", 20, True), 4: ("never", None, False), 5: (None, None, False), 6: ("unread", None, False),
        7: ("first", 7, True), 8: ("first", 7, True), 9: ("never", 1, True),
    }


def test_settled_state_is_kept_by_buckets(spark, tmp_path, monkeypatch):
    """Many keys, NaN, zeros and null among them, take no more state rows than two a bucket."""
    monkeypatch.setattr(settle, "BUCKETS", 4)
    base, odd = f"file://{tmp_path}", [float("nan"), 0.0, None]
    spark.createDataFrame([(float(i), i) for i in range(1, 60)] + [(k, 100 + i) for i, k in enumerate(odd)], "key double, event long").coalesce(1).write.parquet(f"{base}/events")
    spark.createDataFrame([(float(i), i * 10) for i in range(2, 60, 2)] + [(k, 7) for k in (float("nan"), -0.0, None)], "key double, line long").coalesce(1).write.parquet(f"{base}/lines")
    read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{base}/{name}")
    stream = settle.settled(read("events", "key double, event long"), read("lines", "key double, line long"), ["key"], "line", 500)
    most, wait = [], settle.wait_until_idle

    def watched(query, *args):
        began = wait(query, *args)
        most.extend(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
        return began

    monkeypatch.setattr(settle, "wait_until_idle", watched)
    settle.run_until_settled(stream, f"{base}/out", f"{base}/state", 500)
    got = {r.event: (r.line, r.logged) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {i: (None, False) if i % 2 else (i * 10, True) for i in range(1, 60)} | {100 + i: (7, True) for i in range(3)}
    assert 0 < max(most) <= 8
