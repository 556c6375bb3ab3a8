"""A tail of numbered events as a streaming source: cursors, a bounded ring, replay after a restart.

A feed is a folder of Parquet files, one subfolder for each start of its producer (``epoch=<n>``), with a
sequence column that grows within an epoch. A reader's cursor is (epoch, seq). It gets the events past
its cursor; of a producer that promises to hold no more than its newest ``ring`` numbers at most those, without
such a promise all that the feed holds. A cursor that can't be placed, because it is ahead of the producer or of
another epoch, gets all that is held once: an event offered twice is refused downstream by its key, and one that is skipped is lost.

    spark.dataSource.register(RingSource)
    spark.readStream.format("ring").schema(...).option("path", feed).option("after", 500).load()

Only file footers are read to plan; a row group is a partition, so a batch of any size is more tasks,
not larger ones. What a batch reads follows from its two logged offsets alone, so one that is
run again after a failure reads the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType


@dataclass
class Slice(InputPartition):
    path: str
    group: int
    low: int | None
    high: int


def publish(events: DataFrame, feed: str, seq: str, epoch: int = 0) -> None:
    """Append events to the present epoch of a feed, in files that each hold a range of the sequence."""
    events.repartitionByRange(seq).sortWithinPartitions(seq).write.mode("append").parquet(f"{feed}/epoch={epoch}")


class _Feed:
    def __init__(self, options: dict, schema):
        self.folder, self.seq, self.schema = options["path"], options.get("seq", "seq"), schema
        self.ring, self.after = int(options["ring"]) if "ring" in options else None, options.get("after")
        self._footers: dict[str, list[tuple[int, int]]] = {}

    def _groups(self, fs, path: str) -> list[tuple[int, int]]:
        """(least, most) of the sequence in each row group of a file."""
        if path not in self._footers:
            meta = pq.ParquetFile(fs.open_input_file(path)).metadata
            at = meta.schema.to_arrow_schema().get_field_index(self.seq)
            found = (meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups))
            self._footers[path] = [(s.min, s.max) if s is not None and s.has_min_max else (0, -1) for s in found]
        return self._footers[path]

    def files(self, epoch: int | None = None) -> tuple[int, dict[str, list[tuple[int, int]]]]:
        """The epoch asked for, or the newest, and its files."""
        fs, root = pafs.FileSystem.from_uri(self.folder)
        infos = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        paths = [(int(i.path.split("epoch=")[1].split("/")[0]), i.path) for i in infos if "epoch=" in i.path and i.path.endswith(".parquet") and "/_temporary/" not in i.path]
        epoch = max((e for e, _ in paths), default=-1) if epoch is None else epoch
        return epoch, {p: self._groups(fs, p) for e, p in paths if e == epoch}

    def newest(self) -> dict:
        epoch, files = self.files()
        return {"epoch": epoch, "seq": max((most for groups in files.values() for _, most in groups), default=-1)}

    def first(self) -> dict:
        """Where a new reader stands: at its own cursor, which claims the present epoch, or before everything."""
        if self.after is None:
            return {"epoch": -1, "seq": -1}
        return {"epoch": self.newest()["epoch"], "seq": int(self.after)}

    def slices(self, start: dict, end: dict) -> list[Slice]:
        lost = start["epoch"] != end["epoch"] or start["seq"] > end["seq"]
        bounds = ([] if self.ring is None else [end["seq"] - self.ring]) + ([] if lost else [start["seq"]])
        low = max(bounds, default=None)
        _, files = self.files(end["epoch"])
        return [Slice(p, i, low, end["seq"]) for p, groups in sorted(files.items()) for i, (least, most) in enumerate(groups) if (low is None or most > low) and least <= end["seq"]]

    def rows(self, part: Slice):
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        wanted, names = to_arrow_schema(self.schema), self.schema.names
        file = pq.ParquetFile(fs.open_input_file(part.path), coerce_int96_timestamp_unit="us")
        for batch in file.iter_batches(10_000, row_groups=[part.group], columns=list(dict.fromkeys([*names, self.seq]))):
            n = batch.column(self.seq)
            past = pc.less_equal(n, part.high)
            kept = batch.filter(past if part.low is None else pc.and_(pc.greater(n, part.low), past))
            yield pa.RecordBatch.from_arrays([kept.column(f.name).cast(f.type) for f in wanted], names)


class RingStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema):
        self.feed = _Feed(options, schema)

    def initialOffset(self) -> dict:
        return self.feed.first()

    def latestOffset(self) -> dict:
        return self.feed.newest()

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return self.feed.slices(start, end)

    def read(self, partition: Slice):
        return self.feed.rows(partition)


class RingReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.feed = _Feed(options, schema)

    def partitions(self) -> list[Slice]:
        return self.feed.slices(self.feed.first(), self.feed.newest())

    def read(self, partition: Slice | None):
        return self.feed.rows(partition) if partition else iter(())


class RingSource(DataSource):
    """Options: path; seq, the sequence column; after, the cursor (without one, all the ring has); ring, how many numbers are held (without one, all)."""

    @classmethod
    def name(cls) -> str:
        return "ring"

    def schema(self):
        raise ValueError("a ring is read with a schema: .schema(...)")

    def streamReader(self, schema) -> RingStreamReader:
        return RingStreamReader(self.options, schema)

    def reader(self, schema) -> RingReader:
        return RingReader(self.options, schema)


def tail(spark: SparkSession, feed: str, schema, seq: str = "seq", after: int | None = None, ring: int | None = None, stream: bool = True) -> DataFrame:
    """The events of a feed past a cursor, as a stream or as they stand now."""
    spark.dataSource.register(RingSource)
    reader = (spark.readStream if stream else spark.read).format("ring").schema(schema).option("path", feed).option("seq", seq)
    for name, given in (("after", after), ("ring", ring)):
        reader = reader if given is None else reader.option(name, given)
    return reader.load()


def stored_rows(spark: SparkSession, stored: str, schema: StructType | str) -> DataFrame:
    """What ``take_new`` has stored, with the number of the batch that brought it."""
    fields = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fields
    return spark.read.schema(StructType([*fields, StructField("batch", IntegerType())])).parquet(stored)


def take_new(stream: DataFrame, key: list[str], stored: str, state: str) -> int:
    """Run a tail until nothing is new, and store each key once, however often it is offered; the number of batches.

    The checkpoint in ``state`` holds the cursor. A batch is written to a folder of its own number, so one
    that is run again replaces itself. Keys are compared with the ones stored, not remembered in memory.
    """
    ran = []

    def put(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        fresh = rows.dropDuplicates(key)
        if batch:
            earlier = stored_rows(spark, stored, rows.schema).where(F.col("batch") < batch)
            fresh = fresh.join(earlier.select(*key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{stored}/batch={batch}")
        ran.append(batch)

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(ran)
