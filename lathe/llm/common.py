"""Shared pieces of the training-data operators: words, hashes, durable tables.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere, which is what ``bytes.split()`` splits
UTF-8 into, so the Arrow operators work on encoded bytes and never decode a text
they only need to cut into words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: A table of at most so many rows (of a few longs each) may be broadcast.
BROADCAST_ROWS = 1_000_000

#: Rows of an Arrow batch; texts of a few kilobytes make batches of a few megabytes.
ARROW_ROWS = 1000

#: Bytes of an Arrow batch, whatever its rows; long texts make batches of a few rows.
ARROW_BYTES = 4 << 20

#: Words hashed in one block; longer texts are hashed block by block.
BLOCK_WORDS = 20_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session without one gets a temporary one."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not set_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="lathe-shared-")
        sc.setCheckpointDir(set_dir)
    return set_dir


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage.

    Tables stay until ``lathe-<application>`` in that folder is removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lathe-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> Column:
    """All columns as one struct, in which no name clashes with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the (durable) table has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces that bound what a task holds at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal in, equal out, well spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x5851F42D4C957F2D
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64, for j below n."""
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class WordHashes:
    """Hashes of runs of words of one block of words, from one prefix sum over the words' xxhashes.

    A word's bytes only enter by its xxhash. A polynomial over bytes modulo 2**64 would give equal
    hashes to words of 1,024 letters in Thue-Morse order and its complement, for every base; over
    words that takes runs of some thousand words, and runs here have at most some tens.
    """

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        up, self._down = _powers(self.n + 1)
        self._sums = np.zeros(self.n + 1, np.uint64)
        one = mix(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, self.n))
        np.cumsum(one * up[: self.n], dtype=np.uint64, out=self._sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """Of every run of k words, in order; empty with fewer words."""
        if self.n < k:
            return np.empty(0, np.uint64)
        return mix((self._sums[k:] - self._sums[: self.n - k + 1]) * self._down[: self.n - k + 1])

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the words first..last of each pair of positions."""
        return mix((self._sums[last + 1] - self._sums[first]) * self._down[first])


def gram_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of every run of k words of a text of any length."""
    if len(words) <= BLOCK_WORDS:
        return WordHashes(words).grams(k) if words else np.empty(0, np.uint64)
    return np.concatenate([WordHashes(words[i : i + BLOCK_WORDS + k - 1]).grams(k) for i in range(0, len(words) - k + 1, BLOCK_WORDS)])


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_ROWS rows and ARROW_BYTES bytes, which bounds a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
