"""I-Match fingerprints.

Terms (lower-cased words) whose document frequency lies in a band of inverse document
frequency make the lexicon. A document's terms in the lexicon are sorted, and hashed
once whole and once within each of several random subsets of the lexicon: a term is in
a subset by bits of its own hash. Subsets come in levels of falling density; dense ones
tell near-identical texts, sparse ones survive larger edits.

The likeness of two fingerprints is the share of equal subset hashes at the sparsest
level at which at least half the subsets are filled in either.

A term of the band stands in at least ``low`` of all documents, so the lexicon has at
most (distinct terms of a mean document) / ``low`` terms, whatever the corpus. It is
broadcast up to MAX_LEXICON terms; a larger one is joined to the documents' terms, which
gives the same fingerprints.

The digest needs each document's successor by descending id. Ids alone are range-sorted by
Spark first; where its ranges begin, at most MOST_RANGES (id, text hash) pairs, is all the
driver sees. Texts are then shuffled once, each to its range, and the first row of a range
also to the one before it. Rows alike in id and text are each other's successors but for the
last; if there are more than ALIKE of them, one row goes on with their number.

Defined results: a null text is empty; a text without a term of the band uses all its
terms; one without terms has the fingerprint ``-`` and likeness 0 to everything except
another such (1); equal texts have equal fingerprints; a null ``doc_id`` comes after all
others, rows of one id by the hash of their texts; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import durable, map_arrow, mix, slices, small, small_batches, utf8

#: Band of document frequency, as shares of all documents.
LOW, HIGH = 0.0005, 0.15
#: Levels of subsets: level j keeps a term with probability 4**-j / 2 in each of 16 subsets.
LEVELS, SUBSETS = 6, 16
#: A larger lexicon isn't broadcast.
MAX_LEXICON = 1_000_000
HELD_TERMS = 400_000
#: Rows of a range of the order of ids, about, and the most ranges there are.
RANGE_ROWS, MOST_RANGES = 1024, 4096
#: Rows alike in id and text beyond which one row stands for all.
ALIKE = 1000


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): in how many rows each lower-cased word stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        out = lambda: pa.record_batch({"term": pa.array(list(held), pa.binary()), "df": pa.array(list(held.values()), pa.int64())})
        for batch in slices(batches):
            for text in utf8(batch.column(0)):
                if text:
                    held.update(set(text.lower().split()))
            if len(held) > HELD_TERMS:
                yield out()
                held.clear()
        if held:
            yield out()

    return docs.select("text").transform(map_arrow, count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def band_lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term): terms of the band; at least two documents, so that copies can meet."""
    n = docs.count()
    df = durable(document_frequencies(docs), "df")
    return durable(df.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= high * n)).select("term"), "lexicon")


_SEEDS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64))


def _hashes(terms: list[bytes], lexicon: frozenset[bytes] | set[bytes]) -> np.ndarray | None:
    """Hash of the sorted distinct terms, then of those in every subset; zero for an empty one.

    A subset's hash is the sum of its terms' mixed 64-bit hashes, which like a hash of the
    sorted list depends on the set alone; so all subsets come from one pass.
    """
    mine = sorted(lexicon.intersection(terms)) or sorted(set(terms))
    if not mine:
        return None
    h = np.fromiter(map(xxhash.xxh64_intdigest, mine), np.uint64, len(mine))
    out = np.zeros(1 + LEVELS * SUBSETS, np.uint32)
    out[0] = xxhash.xxh32_intdigest(h.tobytes()) | 1
    # A term reaches level j of a subset if the low 2j + 1 bits of its hash there are zero.
    r = mix(h[:, None] ^ _SEEDS) | np.uint64(1 << 62)
    zeros = np.log2((r & (~r + np.uint64(1))).astype(np.float64)).astype(np.int64)
    level = np.minimum((zeros + 1) // 2, LEVELS)  # how many levels it reaches
    sums = np.zeros((LEVELS + 1, SUBSETS), np.uint64)
    np.add.at(sums, (level, np.broadcast_to(np.arange(SUBSETS), level.shape)), np.broadcast_to(mix(h)[:, None], level.shape))
    kept = np.cumsum(sums[:0:-1], axis=0, dtype=np.uint64)[::-1]  # by level: all that reach it
    out[1:] = np.where(kept == 0, 0, (mix(kept) >> np.uint64(32)) | np.uint64(1)).astype(np.uint32).ravel()
    return out


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    x, y = a[1:].reshape(LEVELS, SUBSETS), b[1:].reshape(LEVELS, SUBSETS)
    filled = (x != 0) | (y != 0)
    levels = np.flatnonzero(filled.sum(axis=1) * 2 >= SUBSETS)
    if not len(levels):
        return float(a[0] == b[0])
    at = levels[-1]
    return float(((x[at] == y[at]) & filled[at]).sum() / filled[at].sum())


def _text_of(h: np.ndarray | None) -> str:
    return "-" if h is None else h.astype(">u4").tobytes().hex()


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in ranges of descending doc_id, each range ending in a copy of the next one's first row.

    Columns: rng, doc_id, text, alike, own (false for the copy). Within a range, sorted as it
    comes, a row's next document is the row below; ``alike`` rows are meant by one. The last
    range ends in a copy of the very first row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.desc_nulls_last("doc_id"), F.asc("th"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    ids = durable(docs.groupBy("doc_id", "th").agg(F.count("*").alias("alike")), "ids")
    many = ids.where(f"alike > {ALIKE}")
    if many.limit(1).count():
        same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h"))
        keys = durable(many.select(F.col("doc_id").alias("_d"), F.col("th").alias("_h")), "many")
        rest = docs.join(small(keys), same, "left_anti").withColumn("alike", F.lit(1).cast("long"))
        # Counted within each task first, so that few of the alike texts are shuffled.
        docs = rest.unionByName(docs.join(small(keys), same, "left_semi").groupBy("doc_id", "th", "text").agg(F.count("*").alias("alike")))
    else:
        docs = docs.withColumn("alike", F.lit(1).cast("long"))
    parts = max(1, min(MOST_RANGES, -(-ids.count() // RANGE_ROWS)))
    sorted_ids = ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), (F.bitwise_not(F.coalesce("doc_id", F.lit(0)))).alias("down"), "th"))  # ~x falls as x rises, and has no overflow
    heads = sorted(tuple(r.first) for r in sorted_ids.groupBy("part").agg(first.alias("first")).select("first").collect())
    none, down, th = (np.array(c, np.int64) for c in (zip(*heads, strict=True) if heads else ([], [], [])))

    @F.pandas_udf("rng int, head boolean")
    def place(is_none: pd.Series, key: pd.Series, hashed: pd.Series) -> pd.DataFrame:
        x = np.rec.fromarrays([is_none.to_numpy(np.int64), key.to_numpy(np.int64), hashed.to_numpy(np.int64)])
        starts = np.rec.fromarrays([none, down, th])
        at = np.searchsorted(starts, x, "right") - 1
        return pd.DataFrame({"rng": at.astype(np.int32), "head": starts[at] == x})

    n = len(heads)
    placed = docs.withColumn("at", place(F.col("doc_id").isNull(), F.bitwise_not(F.coalesce("doc_id", F.lit(0))), F.col("th")))
    here = F.struct(F.col("at.rng").alias("rng"), F.lit(True).alias("own"))
    there = F.struct(F.pmod(F.col("at.rng") - 1, F.lit(n or 1)).cast("int").alias("rng"), F.lit(False).alias("own"))
    both = placed.withColumn("to", F.explode(F.when(F.col("at.head"), F.array(here, there)).otherwise(F.array(here)))).select("to.rng", "to.own", "doc_id", "th", "text", "alike")
    return both.repartition(tasks, "rng").sortWithinPartitions("rng", F.desc("own"), *order).select("rng", "doc_id", "text", "alike", "own")


def _edited(text: str, after: str) -> str:
    """The text whose last third of code points gives way to the first as many of the next."""
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


def _followed(batches: Iterator[pa.RecordBatch], know: Callable[[str], object]) -> Iterator[tuple]:
    """(doc_id, text, known, next text, next known, rows meant) of the ranges of with_next()."""
    before, at = None, None
    for batch in slices(batches, 200):
        for rng, doc_id, text, alike, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            known = know(text)
            if before is not None and at == rng:
                yield *before, text, known, 1
            if own and alike > 1:
                yield doc_id, text, known, text, known, alike - 1
            at, before = rng, (doc_id, text, known) if own else None


DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_digest(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """The columns of DIGEST for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lexicon = band_lexicon(docs, low, high)
    if lexicon.count() > MAX_LEXICON:
        return _digest_by_join(docs, lexicon)
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.term) for r in lexicon.collect()))
    schema = DIGEST + ", rows long"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = shared.value, []
        batch_of = lambda: pa.record_batch({k: pa.array(c, t) for k, c, t in zip(names, zip(*out, strict=True), kinds, strict=True)})
        for doc_id, text, h, after, after_h, rows in _followed(batches, lambda t: _hashes(t.encode().lower().split(), words)):
            edited = _edited(text, after).encode()
            e = _hashes(edited.lower().split(), words)
            out.append((doc_id, len(text), hashlib.sha256(edited).hexdigest(), _text_of(h), _text_of(e), likeness(h, e), likeness(h, after_h), rows))
            if len(out) >= 200:
                yield batch_of()
                out = []
        if out:
            yield batch_of()

    return _each(with_next(docs).transform(map_arrow, run, schema))


def _each(digest: DataFrame) -> DataFrame:
    """A row for each of the ``rows`` that a row stands for."""
    return digest.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("_", "rows")


def _digest_by_join(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The same, for a lexicon that isn't broadcast: own, edited and next texts meet it in a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text, _, after, _, rows in _followed(batches, lambda t: None):
            edited = _edited(text, after)
            yield pa.record_batch({"doc_id": pa.array([doc_id], pa.int64()), "n_chars": pa.array([len(text)]), "edited_sha256": pa.array([hashlib.sha256(edited.encode()).hexdigest()]), "rows": pa.array([rows]), "texts": pa.array([[text, edited, after]])})

    pairs = durable(with_next(docs).transform(map_arrow, run, "doc_id long, n_chars long, edited_sha256 string, rows long, texts array<string>").withColumn("row", F.monotonically_increasing_id()), "pairs")
    texts = pairs.select((F.col("row")).alias("row"), F.posexplode("texts").alias("which", "text")).select((F.col("row") * 3 + F.col("which")).alias("doc_id"), "text")
    prints = fingerprints_by_join(texts, lexicon)
    of = F.map_from_entries(F.collect_list(F.struct((F.col("doc_id") % 3).alias("k"), "fingerprint")))
    per = prints.groupBy(F.expr("doc_id DIV 3").alias("row")).agg(of.alias("f"))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        read = lambda s: None if s == "-" else np.frombuffer(bytes.fromhex(s), ">u4").astype(np.uint32)
        return pd.Series([likeness(read(x), read(y)) for x, y in zip(a, b, strict=True)])

    f = lambda k: F.element_at("f", F.lit(k).cast("long"))
    out = pairs.drop("texts").join(per, "row").select("doc_id", "n_chars", "edited_sha256", f(0).alias("fingerprint"), f(1).alias("edited_fingerprint"), alike(f(0), f(1)).alias("near_edited"), alike(f(0), f(2)).alias("near_next"), "rows")
    return _each(out)


def fingerprints(docs: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """doc_id, fingerprint of every row, with a given lexicon or the corpus's own band."""
    lexicon = band_lexicon(docs) if lexicon is None else lexicon
    if lexicon.count() > MAX_LEXICON:
        return fingerprints_by_join(docs, lexicon)
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.term) for r in lexicon.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [_text_of(_hashes(t.lower().split() if t else [], shared.value)) for t in utf8(batch.column(1))]
            yield pa.record_batch({"doc_id": batch.column(0), "fingerprint": pa.array(prints, pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, run, "doc_id long, fingerprint string")


def fingerprints_by_join(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The same for a lexicon of any size: the documents' distinct terms meet it in a join.

    Rows that share doc_id and text are one; a text's terms come together again in its own
    group, which is as large as the text.
    """

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            ids, keys, words = [], [], []
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                mine = sorted(set(text.lower().split())) if text else []
                mine = mine or [b""]
                ids += [doc_id] * len(mine)
                keys += [key] * len(mine)
                words += mine
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "term": pa.array(words, pa.binary())})

    @F.pandas_udf("string")
    def print_of(listed, every):
        return listed.combine(every, lambda a, b: _text_of(_hashes([bytes(x) for x in (a if a is not None and len(a) else b) if len(x)], frozenset())))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    met = rows.transform(map_arrow, terms, "doc_id long, key long, term binary").join(lexicon.select("term", F.lit(True).alias("listed")), "term", "left")
    per = met.groupBy("doc_id", "key").agg(F.collect_set(F.when(F.col("listed"), F.col("term"))).alias("listed"), F.collect_set("term").alias("every"))
    return per.select("doc_id", print_of("listed", "every").alias("fingerprint"))
