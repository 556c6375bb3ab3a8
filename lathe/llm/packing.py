"""Packing along a space-filling curve.

Each text is a hashed vector of its word counts, projected to DIMS dimensions by random
signs and squashed to a grid; the Hilbert index of the cell is its place on the curve.
Keyed rows are written once and range-partitioned by (Hilbert key, hash of the row, place
in that table), so documents with one key, such as thousands of copies, and even equal rows
spread over ranges. Each range is sorted and streamed: its documents are tokenised, laid end
to end and cut at every ``capacity`` tokens, so neighbours on the curve share sequences. The
rest of a range is cut into sequences whose lengths are powers of two, which need no padding.

Tokenising happens once, after the shuffle, so only texts are shuffled, never ids. A range is
sorted by Spark, which spills, and streamed; so more text than RANGE_CHARS in each of
MOST_RANGES ranges makes longer tasks, not larger ones.

Defined results: a null or empty text is the end token alone; repeated rows are packed
each; a null ``doc_id`` is carried along; extra columns are ignored; an empty table
gives no piece.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import durable, gram_hashes, map_arrow, slices, utf8

CAPACITY = 2048
END_ID = 1
DIMS, GRID_BITS = 4, 8
#: Characters of text that one range holds, about, and the most ranges there are.
RANGE_CHARS = 8_000_000
MOST_RANGES = 1 << 16


# --- tokens ---------------------------------------------------------------------------

#: Texts of these characters only take the fast encoder; its splitting pattern and merges
#: are the same vocabulary's. Any other text, and a special token's string, goes to the
#: tokenizer file itself.
_PLAIN = re.compile(r"[\t\n\r -~¡-ɏ‐-‧‰-⁞₠-₿]*\Z")


class Encoder:
    """Token ids of texts by a tokenizer file, with the rank file of the same vocabulary."""

    def __init__(self, tokenizer: str, ranks: str | None):
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(tokenizer)
        self._special = [t.content for t in self._slow.get_added_tokens_decoder().values()]
        self._fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self._fast and _PLAIN.match(text) and not any(s in text for s in self._special):
            return np.array(self._fast.encode_ordinary(text), np.uint32)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(tokenizer: str | None = None, ranks: str | None = None) -> Encoder:
    """One encoder a worker process; by default the 50k byte-level BPE of public_tokenizers."""
    key = (tokenizer, ranks)
    if key not in _ENCODERS:
        if tokenizer is None:
            import public_tokenizers

            _ENCODERS[key] = Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
        else:
            _ENCODERS[key] = Encoder(tokenizer, ranks)
    return _ENCODERS[key]


# --- the curve ------------------------------------------------------------------------


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, dims), by the transpose method of Skilling (2004)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_point(text: bytes | None, dims: int = DIMS, bits: int = GRID_BITS) -> np.ndarray:
    """Grid cell of a text: signs hashed from each word, summed, scaled by length."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(dims, np.int64)
    h = gram_hashes(words, 1)
    sums = np.array([2 * np.count_nonzero(h & np.uint64(1 << j)) - len(words) for j in range(dims)])
    unit = np.tanh(sums / np.sqrt(len(words)) / 2) / 2 + 0.5
    return np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def curve_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, key: the Hilbert key above a hash of the row, in one long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            points = np.array([curve_point(t) for t in utf8(batch.column(1))]).reshape(-1, DIMS)
            low = batch.column(2).to_numpy().astype(np.int64) & 0x3FFFFFFF
            yield pa.record_batch({"doc_id": batch.column(0), "text": batch.column(1), "key": pa.array((hilbert_index(points, GRID_BITS) << 30) | low)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("low", F.xxhash64("doc_id", "text")).transform(map_arrow, run, "doc_id long, text string, key long")


def curve_ranges(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """doc_id, text, key, place: rows in ranges along the curve, sorted within each; a partition is a range."""
    keyed = durable(curve_keys(docs).withColumn("place", F.monotonically_increasing_id()), "keyed")
    chars = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    n = min(MOST_RANGES, -(-chars // range_chars)) or 1
    return keyed.repartitionByRange(n, "key", "place").sortWithinPartitions("key", "doc_id", "place")


# --- packing --------------------------------------------------------------------------

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


class _Packer:
    """Lays documents end to end and gives out the pieces of full sequences."""

    def __init__(self, rng: int, capacity: int):
        self.base, self.n, self.capacity = rng << 40, 0, capacity
        self.held: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start, ids, doc_tokens
        self.fill = 0

    def _close(self, size: int) -> Iterator[tuple]:
        """Pieces of one sequence of the first ``size`` ids that are held."""
        offset, rest = 0, []
        for doc_id, start, ids, total in self.held:
            take = min(len(ids), size - offset)
            if take:
                yield doc_id, start, take, zlib.crc32(ids[:take].astype("<u4").tobytes()), total, self.base + self.n, offset, size
            if take < len(ids):
                rest.append((doc_id, start + take, ids[take:], total))
            offset += take
        self.held, self.fill, self.n = rest, self.fill - size, self.n + 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.held.append((doc_id, 0, ids, len(ids)))
        self.fill += len(ids)
        while self.fill >= self.capacity:
            yield from self._close(self.capacity)

    def finish(self) -> Iterator[tuple]:
        while self.fill:
            yield from self._close(1 << (self.fill.bit_length() - 1))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Pieces of documents in sequences: see PIECES; ids themselves are not kept."""
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, out = encoder(tokenizer, ranks), _Packer(TaskContext.get().partitionId(), capacity), []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch({k: pa.array(c, pa.int64()) for k, c in zip(names, zip(*rows, strict=True), strict=True)})

        for batch in slices(batches, 200):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += packer.add(doc_id, np.append(enc.ids(text), np.uint32(END_ID)))
                if len(out) > 5000:
                    yield batch_of(out)
                    out = []
        out += packer.finish()
        if out:
            yield batch_of(out)

    return curve_ranges(docs, range_chars).select("doc_id", "text").transform(map_arrow, run, PIECES)
