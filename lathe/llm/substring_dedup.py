"""Substring dedup by seed and extend.

Seeds: of every 16 consecutive five-word grams the one with the smallest hash is an
anchor (winnowing), so any run of 20 words that occurs twice has the same anchor at
the same place in both. Anchors are joined by their count over all documents; those
met once are dropped.

Extend: the 20-word windows that share one anchor follow each other, and reach up to 15
words to its left and right. Such a stretch is compared, by hash, with the earliest
equal stretch of the same anchor; where it is equal, all its windows repeat. Where an
anchor has unequal stretches the match ends inside them: there the earliest copy of
each stretch is compared window by window. Matching windows that follow each other are
one maximal repeat; shorter agreements have no window and are no repeats.

Nothing is paired within a bucket: a passage of m documents costs m rows for each anchor.
The earliest occurrence is a minimum (combined before the shuffle), and the join with it
is a plain equi-join, whose skewed partitions Spark splits.

Between the passes over the texts, what to look at is a bitmap of at most 2**MAX_BITS
bits; a collision only sends a stretch to the exact comparison needlessly.

Defined results: a null or blank text has no words; rows with a null ``doc_id`` have no
place in the order, keep all their words and remove nothing elsewhere; rows that share
a ``doc_id`` are one document (a position that either repeats is removed in both);
extra columns, of any names, are kept or ignored as stated; an empty table gives no rows.
Stretches are compared as 64-bit hashes among those of one anchor, windows as 64-bit hashes
with 32 bits of their anchor's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import BLOCK_WORDS, WordHashes, durable, map_arrow, packed, signed, slices, small_batches, utf8

WINDOW = 20
GRAM = 5
MIN_BITS, MAX_BITS = 20, 28


def _blocks(words: list[bytes], window: int) -> Iterator[tuple[int, WordHashes]]:
    """Blocks of a text that overlap by a window less one word, with their offset."""
    for i in range(0, max(1, len(words) - window + 1), BLOCK_WORDS):
        yield i, WordHashes(words[i : i + BLOCK_WORDS + window - 1])


def _anchor_of(grams: np.ndarray, span: int) -> np.ndarray:
    """Index of the anchor of every window: the last of the smallest gram hashes."""
    views = sliding_window_view(grams, span)
    return np.arange(len(views)) + span - 1 - np.argmin(views[:, ::-1], axis=1)


def repeated_anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(anchor) met at two places or more, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            found = []
            for text in utf8(batch.column(0)):
                words = text.split() if text else []
                if len(words) >= window:
                    for _, block in _blocks(words, window):
                        grams = block.grams(gram)
                        found.append(grams[np.unique(_anchor_of(grams, window - gram + 1))])
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch({"anchor": signed(h), "n": pa.array(n.astype(np.int32))})

    counts = docs.where("doc_id IS NOT NULL").select("text").transform(map_arrow, run, "anchor long, n int")
    return counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Top bits of the column ``key`` as 64-bit words, 16 bits for each row within the fixed bounds."""
    bits = min(MAX_BITS, max(MIN_BITS, (16 * keys.count()).bit_length()))
    slot = F.expr(f"shiftrightunsigned(key, {64 - bits})")
    rows = keys.select(F.shiftright(slot, 6).cast("int").alias("word"), F.expr("1L").alias("one"), (slot % 64).cast("int").alias("bit"))
    found = rows.groupBy("word").agg(F.expr("bit_or(shiftleft(one, bit))").alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["word"].to_numpy()] = found["set"].to_numpy()
    return out.view(np.uint64)


def _in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys >> np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _occurrence(stretch: np.ndarray, doc_id: int, pos: np.ndarray) -> np.ndarray:
    """Key of one occurrence of a stretch; as SQL it is _OCCURRENCE."""
    return stretch ^ (np.array([doc_id], np.int64).view(np.uint64) << np.uint64(37)) ^ (pos.astype(np.uint64) << np.uint64(45))


_OCCURRENCE = "stretch ^ shiftleft(doc_id, 37) ^ shiftleft(CAST(pos AS BIGINT), 45)"


def _stretches(docs: DataFrame, anchors: np.ndarray, occurrences: np.ndarray | None, window: int, gram: int) -> DataFrame:
    """(anchor, stretch, doc_id, pos, n): stretches of n windows around the anchors.

    With a bitmap of occurrences: (window, seed, doc_id, pos), the windows of those stretches; the
    seed is 32 bits of the anchor, which equal windows have in common.
    """
    shared = docs.sparkSession.sparkContext.broadcast((anchors, occurrences))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, chosen = shared.value
        for batch in slices(batches):
            out: tuple[list, ...] = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = text.split() if text else []
                if len(words) < window:
                    continue
                for start, block in _blocks(words, window):
                    grams = block.grams(gram)
                    anchor = _anchor_of(grams, window - gram + 1)
                    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                    n = np.diff(np.append(first, len(anchor)))
                    met = _in(wanted, grams[anchor[first]])
                    first, n = first[met], n[met]
                    stretch, pos = block.spans(first, first + n + window - 2), first + start
                    if chosen is not None:
                        met = _in(chosen, _occurrence(stretch, doc_id, pos))
                        at = np.concatenate([np.arange(f, f + m) for f, m in zip(first[met], n[met], strict=True)]) if met.any() else np.empty(0, np.int64)
                        cols = (block.grams(window)[at], at + start, grams[anchor[at]])
                    else:
                        cols = (grams[anchor[first]], pos, stretch, n)
                    for held, c in zip(out, cols):
                        held.append(c)
                    out[4].append(np.full(len(cols[0]), doc_id, np.int64))
            if not out[0]:
                continue
            head, pos, *more = (np.concatenate(c) for c in out if c)
            ids, pos = pa.array(more[-1]), pa.array(pos.astype(np.int32))
            if chosen is not None:
                yield pa.record_batch({"window": signed(head), "seed": pa.array((more[0] >> np.uint64(32)).astype(np.uint32).view(np.int32)), "doc_id": ids, "pos": pos})
            else:
                yield pa.record_batch({"anchor": signed(head), "stretch": signed(more[0]), "doc_id": ids, "pos": pos, "n": pa.array(more[1].astype(np.int32))})

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.transform(map_arrow, run, "window long, seed int, doc_id long, pos int" if occurrences is not None else "anchor long, stretch long, doc_id long, pos int, n int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, runs (array of pos, n): n windows from pos on begin somewhere earlier too."""
    anchors = _bitmap(durable(repeated_anchors(docs, window, gram), "anchors").select(F.col("anchor").alias("key")))
    found = durable(_stretches(docs, anchors, None, window, gram), "stretches")
    first = durable(found.groupBy("anchor", "stretch").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("copies")), "first")
    later = found.join(first.where("copies > 1").select("anchor", "stretch", "first"), ["anchor", "stretch"]).where(F.struct("doc_id", "pos") > F.col("first")).select("doc_id", "pos", "n")
    # Where an anchor has several stretches, their earliest copies meet window by window.
    many = first.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    several = first.join(many, "anchor", "left_semi").select("stretch", "first.*").select(F.expr(_OCCURRENCE).alias("key"))
    windows = durable(_stretches(docs, anchors, _bitmap(durable(several, "several")), window, gram), "windows")
    earliest = windows.groupBy("window", "seed").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("c")).where("c > 1").select("window", "seed", "first")
    single = windows.join(earliest, ["window", "seed"]).where(F.struct("doc_id", "pos") > F.col("first")).select("doc_id", "pos", F.lit(1).alias("n"))
    return later.union(single).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("runs"))


def maximal_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, begin, end (word offsets): maximal runs of words that occur earlier."""
    runs = repeated_windows(docs, window, gram).select("doc_id", F.explode("runs").alias("r")).select("doc_id", F.col("r.pos").alias("begin"), (F.col("r.pos") + F.col("r.n") + window - 1).alias("end"))
    return (
        runs.withColumn("gap", F.expr("begin > max(end) OVER (PARTITION BY doc_id ORDER BY begin, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
        .withColumn("run", F.expr("sum(if(gap, 1, 0)) OVER (PARTITION BY doc_id ORDER BY begin, end)"))
        .groupBy("doc_id", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("run")
    )


def _kept(words: list[bytes], runs: list | None, window: int) -> np.ndarray:
    if runs is None or not len(runs):
        return np.ones(len(words), bool)
    edge = np.zeros(len(words) + 1, np.int64)
    begin, n = np.array([(r["pos"], r["n"]) for r in runs], np.int64).T
    np.add.at(edge, np.minimum(begin, len(words)), 1)
    np.add.at(edge, np.minimum(begin + n + window - 1, len(words)), -1)
    return np.cumsum(edge)[: len(words)] == 0


def removal_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, gone, sha = [], [], []
            for text, runs in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split() if text else []
                kept = _kept(words, runs, window)
                n.append(len(words))
                gone.append(len(words) - int(kept.sum()))
                sha.append(hashlib.sha256(b" ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k)).hexdigest())
            yield pa.record_batch({"doc_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(repeated_windows(rows, window), "doc_id", "left").select("doc_id", "text", "runs").transform(map_arrow, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeats cut out of ``text``; other columns stay.

    A text that loses nothing stays as it is, white space included; one that loses
    words has the rest joined by single spaces, and one that loses all is empty.
    """

    @F.pandas_udf("string")
    def cut(text, runs):
        def one(t, s):
            if t is None or s is None or not len(s):
                return t
            words = t.encode().split()
            return b" ".join(w for w, k in zip(words, _kept(words, list(s), window).tolist(), strict=True) if k).decode()

        return text.combine(runs, one)

    small_batches(docs.sparkSession)
    found = repeated_windows(docs.select("doc_id", F.col("text").cast("string").alias("text")), window)
    joined = docs.select(packed(docs).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(found, "doc_id", "left")
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(cut("text", "runs"))
    return joined.select(*(text.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns))
