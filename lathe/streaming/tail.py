"""Event tails: cursor, replay, idempotent dedupe, overlapping re-reads."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lathe.shared import durable, shared_folder


def after(events: DataFrame, seq: str, cursor: int) -> DataFrame:
    """Events past the cursor; a cursor ahead of the newest event replays them all."""
    newest = events.agg(F.coalesce(F.max(seq), F.lit(-1)).alias("_newest"))
    return events.join(F.broadcast(newest), F.lit(True)).where((F.col(seq) > cursor) | (F.lit(cursor) > F.col("_newest"))).drop("_newest")


def drain(spark: SparkSession, path: str, schema, key: list[str], ts: str, delay: str | None = None) -> DataFrame:
    """Run a file stream to its end: each key is stored once, however often it is delivered.

    Without ``delay`` every key is remembered, nothing is lost, and state grows with the keys.
    With one, state is bounded by the watermark, and rows later than that are dropped: Spark
    counts them in the query's progress, and this raises an error if there are any. Files and
    checkpoint lie in the shared folder.
    """
    out = shared_folder(spark, "stream")
    rows = spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))
    once = rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key) if delay else rows.dropDuplicates(key)
    query = once.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    if late:
        raise RuntimeError(f"{late} rows were later than {delay}")
    return spark.read.schema(once.schema).parquet(f"{out}/data")


def upsert_latest(stored: DataFrame, again: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows read again replace stored ones of the same key; the newest by ``order`` stays."""
    w = Window.partitionBy(*key).orderBy(*order)
    return stored.unionByName(again).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert_stream(rows: DataFrame, key: list[str], order: list, table: str, state: str) -> None:
    """Run a stream that re-reads its last days to its end: each batch is merged into the stored table by ``upsert_latest``.

    Every batch writes a new version of the table, named by its number, and then points to it, so that a batch
    that is run again starts from the version before it and nobody reads half a table.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = min(_pointer(spark, f"{table}/pointer"), n)
        stored = spark.read.schema(batch.schema).parquet(f"{table}/version={before}") if before else batch.where("false")
        upsert_latest(stored, batch, key, order).write.mode("overwrite").parquet(f"{table}/version={n + 1}")
        _point(spark, f"{table}/pointer", n + 1)

    rows.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def upserted(spark: SparkSession, table: str, schema) -> DataFrame:
    """The present version of a table that ``upsert_stream`` keeps."""
    return spark.read.schema(schema).parquet(f"{table}/version={_pointer(spark, f'{table}/pointer')}")


def routed(target: Column, sender: Column, own: str) -> Column:
    """Where an event is filed: what is sent to ``own`` goes under its sender."""
    return F.when(target == own, sender).otherwise(target)


def with_line(events: DataFrame, log: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Adds the first logged line of each event, and whether there is one; ``events`` may be a stream."""
    first = log.groupBy(*keys).agg(F.min(line).alias(line))
    return events.join(first, keys, "left").withColumn("logged", F.col(line).isNotNull())


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that the rows have; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def own_events(events: DataFrame, kind: str, sender: str, present_nick: Column) -> DataFrame:
    """Adds ``is_own`` and ``nick``: what one has said oneself is attributed to the present nick, the rest to its sender."""
    own = F.coalesce(F.col(kind).startswith("own_"), F.lit(False))
    return events.withColumn("is_own", own).withColumn("nick", F.when(own, present_nick).otherwise(F.col(sender)))


def first_request(body: Column, most: int = 8192) -> Column:
    """The first line of what was sent; the rest is dropped, and a body beyond ``most`` bytes is refused as null."""
    return F.when(F.octet_length(body) <= most, F.substring_index(body, "\n", 1))


def changed_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, size, stamp) that the stored state lacks or has otherwise; ``listing`` is the next state."""
    return listing.join(state.select("path", "size", "stamp"), ["path", "size", "stamp"], "left_anti")


def _pointer(spark: SparkSession, folder: str) -> int:
    """The highest number that has been put down in a folder; 0 if none."""
    try:
        return spark.read.schema("number long").parquet(folder).agg(F.max("number")).head()[0] or 0
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0


def _point(spark: SparkSession, folder: str, number: int) -> None:
    spark.range(1).select(F.lit(number).cast("long").alias("number")).coalesce(1).write.mode("append").parquet(folder)


def import_changed(listing: DataFrame, state: str, take: Callable[[DataFrame], object]) -> None:
    """Hand the files (path, size, stamp) that have changed since the kept state to ``take``; then keep this listing.

    The state moves on only after ``take`` has returned: each listing is a folder of its own, and a row
    added to a pointer makes it the present one. A run that dies anywhere before that leaves the old state, and the
    next run offers the same files again.
    """
    spark = listing.sparkSession
    listing = durable(listing.select("path", "size", "stamp"), "listing")
    version = _pointer(spark, f"{state}/pointer")
    seen = spark.read.schema(listing.schema).parquet(f"{state}/version={version}") if version else listing.where("false")
    take(durable(changed_files(listing, seen), "changed"))
    listing.write.mode("overwrite").parquet(f"{state}/version={version + 1}")  # what a run that died here had written is replaced
    _point(spark, f"{state}/pointer", version + 1)


def batches_of(events: DataFrame, by: list[str], order: list[str], size: int = 50) -> DataFrame:
    """(by, batch, body): events in batches of at most ``size``, each one JSON array in order."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    rest = [c for c in events.columns if c not in by]
    rows = events.withColumn("batch", F.floor(n / size)).groupBy(*by, "batch").agg(F.sort_array(F.collect_list(F.struct(*order, *(c for c in rest if c not in order)))).alias("rows"))
    return rows.select(*by, "batch", F.to_json("rows").alias("body"))


def unbatched(batches: DataFrame, by: list[str], event: str) -> DataFrame:
    """One row for each event of the bodies; ``event`` is its record type. A body that isn't an array gives none."""
    return batches.select(*by, "batch", F.explode(F.from_json("body", f"array<struct<{event}>>")).alias("e")).select(*by, "batch", "e.*")


def poll(spark: SparkSession, path: str, schema, state: str, wait_s: float = 0, step_s: float = 0.2) -> tuple[DataFrame, int]:
    """Rows that have come since the last acknowledged poll with this state folder, and the number to acknowledge.

    Without any it looks again until ``wait_s`` have passed, and then answers with none, which is how
    a caller knows a quiet source from a dead one. The state is a stream's checkpoint, so no file is taken twice;
    a batch lies in a folder of its number below the state, and rows whose poll died before it was acknowledged
    come again with the next one.
    """
    end = time.monotonic() + wait_s
    rows = spark.readStream.schema(schema).parquet(path)
    while True:
        put = lambda df, n: df.write.mode("overwrite").parquet(f"{state}/rows/_batch_={n}")
        rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).start().awaitTermination()
        done = _pointer(spark, f"{state}/seen")
        new, last = _rows_after(spark, f"{state}/rows", rows.schema, done)
        if last > done or time.monotonic() >= end:
            return new, last
        time.sleep(min(step_s, max(0.0, end - time.monotonic())))


def _rows_after(spark: SparkSession, folder: str, schema: StructType, done: int) -> tuple[DataFrame, int]:
    """Rows of the batches from number ``done`` on, and one more than the last that has rows."""
    try:
        rows = spark.read.schema(StructType([*schema.fields, StructField("_batch_", IntegerType())])).parquet(folder).where(F.col("_batch_") >= done)
        last = rows.agg(F.max("_batch_")).head()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema), done
    return rows.drop("_batch_"), done if last is None else last + 1


def acknowledge(spark: SparkSession, state: str, number: int) -> None:
    """Say that the rows of a poll have been dealt with; they don't come again."""
    _point(spark, f"{state}/seen", number)
