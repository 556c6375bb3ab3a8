"""Events that wait for their log line, and go without it when a timer fires.

An event is often offered before the line it caused has reached the log. It is kept as state of its key
until a line of that key arrives, which sends it on with the line's number, or until it has waited
for the settle time, which sends it on with ``logged`` false. A line that comes first is remembered
for ``keep``, so an event after it waits for nothing. Within one batch lines are taken in first
and timers fire last: a line that comes in the first batch after the deadline is still in time.

State is one line number for each key, which expires, and the events that wait, which leave at their
deadline; so it is bounded by the rate of events and the two times. It is kept in RocksDB on the executors
and restored from the checkpoint when one is lost. Keys are hashed into BUCKETS, and a bucket's state is read and
written once a batch, as each such call costs far more than a row.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys whose state is kept together; a call to the state store takes as long as some hundred rows.
BUCKETS = 1024


def _plain(value):
    """A key's value as what is equal in Spark is equal in Python, too."""
    if isinstance(value, float):
        return "NaN" if value != value else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return bytes(value) if isinstance(value, bytearray) else value


class _Settle(StatefulProcessor):
    """State of a bucket of keys, pickled: {key: (least line, when it is forgotten)} and {key: [(event, due)]}."""

    def __init__(self, events: StructType, keys: list[str], line: str, settle_ms: int, keep_ms: int):
        self.names, self.keys, self.settle_ms, self.keep_ms = events.names, keys, settle_ms, keep_ms
        self.out = Row(*events.names, line, "logged")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getValueState("lines", StructType([StructField("known", BinaryType())]), ttlDurationMs=self.keep_ms)
        self.waiting = handle.getValueState("waiting", StructType([StructField("events", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        kept, held = self.lines.get(), self.waiting.get()
        known = {k: v for k, v in pickle.loads(kept[0]).items() if v[1] > now} if kept else {}
        waiting = pickle.loads(held[0]) if held else {}
        came, changed = {}, False
        for r in rows:
            k, line = _plain([r[n] for n in self.keys]), r["_line"]
            if line is None:
                came.setdefault(k, []).append(tuple(r[n] for n in self.names))
            elif k not in known or line < known[k][0]:
                known[k], changed = (line, now + self.keep_ms), True
        if changed:
            self.lines.update((pickle.dumps(known),))
        settled = [k for k in waiting if k in known]
        for k in settled:
            for event, _ in waiting.pop(k):
                yield self.out(*event, known[k][0], True)
        due, wait = now + self.settle_ms, False
        for k, events in came.items():
            if k in known:
                for event in events:
                    yield self.out(*event, known[k][0], True)
            else:
                waiting.setdefault(k, []).extend((event, due) for event in events)
                wait = True
        if wait:
            self.handle.registerTimer(due)
        if settled or wait:
            self._keep(waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, held, stay = expiredTimerInfo.getExpiryTimeInMs(), self.waiting.get(), {}
        for k, events in pickle.loads(held[0]).items() if held else ():
            for event, due in events:
                if due <= now:
                    yield self.out(*event, None, False)
                else:
                    stay.setdefault(k, []).append((event, due))
        self._keep(stay)

    def _keep(self, waiting: dict) -> None:
        if waiting:
            self.waiting.update((pickle.dumps(waiting),))
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def settled(events: DataFrame, lines: DataFrame, keys: list[str], line: str, settle_ms: int = 120, keep_ms: int = 3_600_000) -> DataFrame:
    """A stream of the events with ``line``, the least line number of their key that has come in time, and ``logged``.

    Both sides are streams; a null key is a key, and a null line number no line.
    """
    out = StructType([*events.schema.fields, StructField(line, LongType()), StructField("logged", BooleanType())])
    said = lines.where(F.col(line).isNotNull()).select(*keys, F.col(line).cast("long").alias("_line"))
    both = events.withColumn("_line", F.lit(None).cast("long")).unionByName(said, allowMissingColumns=True)
    buckets = both.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).groupBy("_bucket")
    return buckets.transformWithState(_Settle(events.schema, keys, line, settle_ms, keep_ms), out, "append", "ProcessingTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """Timers and lists of state need the RocksDB store; the session's own choice comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def wait_until_idle(query: StreamingQuery, after: float = 0, limit_s: float = 600) -> float:
    """Wait for the end of a batch without rows that began after a moment; when it began.

    ``processAllAvailable`` can't be used: with timers there is always another batch.
    """
    end = time.time() + limit_s
    while time.time() < end:
        if query.exception():
            raise query.exception()
        last = query.lastProgress
        if last and not last["numInputRows"] and (began := datetime.fromisoformat(last["timestamp"]).timestamp()) > after:
            return began
        time.sleep(0.1)
    raise TimeoutError(f"rows still come after {limit_s} s")


def run_until_settled(stream: DataFrame, path: str, state: str, settle_ms: int, limit_s: float = 600) -> None:
    """Run the stream until all that there is has been taken and every timer set by then has fired; rows go to Parquet."""
    with rocksdb(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(processingTime="100 milliseconds").start()
        try:
            wait_until_idle(query, wait_until_idle(query, 0, limit_s) + settle_ms / 1000, limit_s)
        finally:
            query.stop()
