"""Brown class-based bigram language model, trained and applied with Spark.

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

Classes come from the exchange algorithm: a word moves to the class that most raises
the likelihood of the class bigrams. As in published distributed versions of it, one
round takes the words' left and right class counts over the whole corpus under the
present classes, and blocks of words then exchange against those counts in parallel.

Every word met twice or more gets a class from its own contexts, whatever its rank:

1. The ``frequent`` most frequent words exchange in rounds, until PATIENCE rounds in a row
   have each raised the best mean log10 probability of a token by less than GAIN; the best
   round counts. All other words stand in for one another
   by spelling meanwhile (BUCKETS items by the hash of the last three bytes).
2. The rest of the ``lexicon`` exchanges once against the classes found.
3. The words beyond it, of any number, come from a table of (word, classes beside it, count)
   that Spark groups by word; each takes the class that fits its contexts best.

Only words met once, and unseen ones, keep the class of their spelling bucket; within one a
word has the add-one estimate with a place for unseen words, so the probabilities of all
words sum to one. Class transitions are smoothed with the class unigram, emissions with a
half count.

Counts cover every training document. All texts are encoded once, as ids of the lexicon and
the words beyond; rounds and scoring read that table. What is broadcast has a fixed size:
the lexicon, with a class and a count for each of its words. The class and the count of a
word beyond are found by an equi-join, one row for each such token.

Defined results: a null text is empty (its end is still a token); a null ``doc_id`` is
never held out; repeated rows give a row each; without a training document every token has
the unseen probability, uniform over classes and buckets; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import durable, map_arrow, slices, utf8

CLASSES = 32
FREQUENT = 1 << 15
LEXICON = 1 << 17
BUCKETS = 512
BLOCK = 256
#: So many rounds in a row that raise the best mean log10 probability of a token by less end the training. There is no
#: limit to rounds: the mean is bounded, so it can't rise by GAIN for ever.
GAIN, PATIENCE = 0.002, 2
#: Weight of the class unigram in a class transition, in counts.
BACKOFF = 8.0
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: Tokens that a task counts together; and the first groups of the tree that sums the tasks' counts.
CHUNK, FIRST_SUMS = 1 << 20, 32


def _bucket(word: bytes) -> int:
    return crc32(word[-3:]) & (BUCKETS - 1)


def _bucket_sql(word: str) -> Column:
    return F.crc32(F.substring(word, -3, 3)).bitwiseAND(BUCKETS - 1).cast("int")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of every distinct word; the end of a text is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(list(held), pa.binary()), "c": pa.array(list(held.values()), pa.int64())})

        for batch in slices(batches):
            for text in utf8(batch.column(0)):
                if text:
                    held.update(text.lower().split())
            held[b""] += batch.num_rows
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
        if held:
            yield out()

    return docs.select("text").transform(map_arrow, count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The most frequent words met twice or more, by descending count, and the singletons of each bucket."""

    words: list[bytes]
    counts: np.ndarray
    frequent: int
    singletons: np.ndarray
    ends: int
    total: int
    distinct: int

    @property
    def end(self) -> int:
        """Id of the end of a text; before it come the words, then the buckets."""
        return len(self.words) + BUCKETS

    def item_of(self) -> np.ndarray:
        """Of each id: the frequent words are items, then come the buckets, then the end."""
        rest = [self.frequent + _bucket(w) for w in self.words[self.frequent :]]
        return np.concatenate((np.arange(self.frequent), np.array(rest, np.int64), self.frequent + np.arange(BUCKETS + 1))).astype(np.int32)


def build_lexicon(counts: DataFrame, lexicon: int = LEXICON, frequent: int = FREQUENT) -> Lexicon:
    words = counts.where("word <> X''")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.expr("word = X''"), F.col("c"))).alias("ends")).first()
    # Written first: collected at once, every partition would send its own candidates to the driver.
    top = durable(words.where("c > 1").orderBy(F.desc("c"), "word").limit(lexicon), "lexicon").orderBy(F.desc("c"), "word").collect()
    singletons = np.zeros(BUCKETS)
    for bucket, n in words.where("c = 1").groupBy(_bucket_sql("word")).count().collect():
        singletons[bucket] = n
    return Lexicon([bytes(r.word) for r in top], np.array([r.c for r in top], np.int64), min(frequent, len(top)), singletons, total.ends or 0, total.n or 0, total.v)


class _Ids(dict):
    """word -> id; a word that isn't listed has the id of its bucket."""

    def __missing__(self, word: bytes) -> int:
        return self.first_bucket + _bucket(word)


def encode(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """row, doc_id, held_out, low, high, beyond (words that have only a bucket's id), written once.

    Ids, with the end, are kept as their low two bytes and the one above, which is mostly zero and so takes no room.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon.words)
    n, end = len(lexicon.words), lexicon.end
    if end >= 1 << 24:
        raise ValueError("a lexicon has fewer than 2**24 words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Ids(zip(shared.value, range(n), strict=True))
        known.first_bucket = n
        for batch in slices(batches):
            low, high, beyond = [], [], []
            for text in utf8(batch.column(2)):
                words = text.lower().split() if text else []
                x = np.array([*map(known.__getitem__, words), end], np.uint32)
                low.append(x.astype(np.uint16).tobytes())
                high.append((x >> 16).astype(np.uint8).tobytes())
                beyond.append([words[i] for i in np.flatnonzero(x[:-1] >= n).tolist()])
            yield pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(1), "low": pa.array(low, pa.binary()), "high": pa.array(high, pa.binary()), "beyond": pa.array(beyond, pa.list_(pa.binary()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    return durable(rows.transform(map_arrow, run, "doc_id long, held_out boolean, low binary, high binary, beyond array<binary>").withColumn("row", F.monotonically_increasing_id()), "encoded")


def _ids(low: list[bytes], high: list[bytes]) -> np.ndarray:
    """Ids of encoded texts, one after the other."""
    return np.frombuffer(b"".join(low), np.uint16).astype(np.int64) + (np.frombuffer(b"".join(high), np.uint8).astype(np.int64) << 16)


# --- exchange -------------------------------------------------------------------------


def _contexts(encoded: DataFrame, item_of: np.ndarray, items: int, class_of: np.ndarray, n_classes: int) -> DataFrame:
    """(block, packed): per item of the block, counts of the classes before and after it.

    ``item_of`` and ``class_of`` are of ids; an id with a negative item isn't counted.
    """
    shared = encoded.sparkSession.sparkContext.broadcast((item_of, class_of.astype(np.uint8)))
    width, blocks = n_classes + 1, -(-items // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, cls = shared.value
        partly, both = bool((item < 0).any()), np.zeros((2, blocks * BLOCK * width), np.int64)
        low: list[bytes] = []
        high: list[bytes] = []

        def count() -> None:
            x = _ids(low, high)
            low.clear()
            high.clear()
            c = cls[x]
            at = item[x].astype(np.int64)
            chosen = np.flatnonzero(at >= 0) if partly else slice(None)
            at = at[chosen] * width
            both[0] += np.bincount(at + np.append(n_classes, c[:-1])[chosen], minlength=both.shape[1])
            both[1] += np.bincount(at + np.append(c[1:], n_classes)[chosen], minlength=both.shape[1])

        size = 0
        for batch in batches:
            low += batch.column(0).to_pylist()
            high += batch.column(1).to_pylist()
            size += batch.column(1).nbytes
            if size > CHUNK:
                count()
                size = 0
        if low:
            count()
        both = both.reshape(2, blocks, BLOCK * width)
        for b in range(blocks):
            if both[:, b].any():
                # In as few bytes as the block's largest count needs; how many tells the length.
                counts = both[:, b].astype(np.min_scalar_type(int(both[:, b].max())))
                yield pa.record_batch({"block": pa.array([b], pa.int32()), "packed": pa.array([counts.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != at and at is not None:
                    yield pa.record_batch({"block": pa.array([at], pa.int32()), "packed": pa.array([total.tobytes()], pa.binary())})
                    at = None
                if at is None:
                    at, total = block, np.zeros(2 * BLOCK * width, np.int64)
                total += np.frombuffer(packed, f"u{len(packed) // len(total)}").astype(np.int64)
        if at is not None:
            yield pa.record_batch({"block": pa.array([at], pa.int32()), "packed": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, packed binary"
    parts = encoded.select("low", "high").transform(map_arrow, run, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FIRST_SUMS)))
    # A tree: the tasks' counts are summed in FIRST_SUMS groups, then these. Blocks stream by in order: a task holds one.
    first = parts.repartition("block", "part").sortWithinPartitions("block").select("block", "packed").transform(map_arrow, add, schema)
    return durable(first.repartition("block").sortWithinPartitions("block").transform(map_arrow, add, schema), "contexts")


def _unpack(packed: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.frombuffer(packed, np.int64).reshape(2, BLOCK, width)
    return before, after


def _class_bigrams(contexts: DataFrame, classes: np.ndarray, width: int) -> np.ndarray:
    """Counts of class pairs, from the blocks' counts of classes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((width, width), np.int64)
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before, _ = _unpack(packed, width)
                own = classes[block * BLOCK : (block + 1) * BLOCK]
                np.add.at(pairs.T, own, before[: len(own)])
        yield pa.record_batch({"pairs": pa.array([pairs.tobytes()], pa.binary())})

    return _matrix(contexts.transform(map_arrow, run, "pairs binary"), width)


def _matrix(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the packed matrices of the column ``pairs``, in FIRST_SUMS parts first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.frombuffer(packed, np.int64)
        yield pa.record_batch({"pairs": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("pairs").repartition(FIRST_SUMS).transform(map_arrow, add, "pairs binary").collect()
    return sum((np.frombuffer(r.pairs, np.int64).reshape(width, width) for r in parts), np.zeros((width, width), np.int64))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """Mean log10 probability of a token under the class bigrams, less what no exchange changes."""
    n = pairs.astype(float)
    return float((_xlogx(n).sum() - _xlogx(n.sum(axis=0)).sum() - _xlogx(n.sum(axis=1)).sum()) / max(1.0, n.sum()) / np.log(10))


def exchange_block(before: np.ndarray, after: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """New classes of a block's items, moved one after the other; the end's class is fixed."""
    n, own = pairs.astype(float), own.copy()
    value, free = _xlogx(n), len(n) - 1

    def add(c: int, le: np.ndarray, ri: np.ndarray) -> None:
        n[c] += ri
        n[:, c] += le
        np.maximum(n, 0, out=n)
        value[c], value[:, c] = _xlogx(n[c]), _xlogx(n[:, c])

    for i in np.argsort(-before.sum(axis=1), kind="stable"):
        le, ri = before[i].astype(float), after[i].astype(float)
        if own[i] == free or not le.sum():
            continue
        add(own[i], -le, -ri)
        rows, cols = n.sum(axis=1), n.sum(axis=0)
        # Only classes beside the item change what the likelihood gains.
        x, y = np.flatnonzero(ri), np.flatnonzero(le)
        gain = (_xlogx(n[:, x] + ri[x]) - value[:, x]).sum(axis=1) + (_xlogx(n[y] + le[y, None]) - value[y]).sum(axis=0)
        gain -= _xlogx(rows + ri.sum()) - _xlogx(rows) + _xlogx(cols + le.sum()) - _xlogx(cols)
        own[i] = int(np.argmax(gain[:free]))
        add(own[i], le, ri)
    return own


def _exchange(contexts: DataFrame, classes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    width = len(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = classes[block * BLOCK : (block + 1) * BLOCK]
                before, after = _unpack(packed, width)
                new.append(exchange_block(before[: len(own)], after[: len(own)], own, pairs).astype(np.int64).tobytes())
            yield pa.record_batch({"block": batch.column(0), "classes": pa.array(new, pa.binary())})

    out = classes.copy()
    tasks = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, so that small blocks aren't put into one task
    for block, own in contexts.repartition(tasks, "block").transform(map_arrow, run, "block int, classes binary").collect():
        own = np.frombuffer(own, np.int64)
        out[block * BLOCK : block * BLOCK + len(own)] = own
    return out


# --- words beyond the lexicon ---------------------------------------------------------


def _codes(x: np.ndarray, class_of: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which tokens lie beyond the lexicon, class of each token, plus ``width`` for those beyond)."""
    beyond = (x >= n) & (x < n + BUCKETS)
    return beyond, class_of[x].astype(np.int32) + np.where(beyond, width, 0)


def _beyond(encoded: DataFrame, lexicon: Lexicon, class_of: np.ndarray, width: int) -> DataFrame:
    """Training tokens beyond the lexicon: (w1, l, r) each, with the codes beside it; (w1, w2) of two in a row; and ``pairs`` of all others."""
    shared = encoded.sparkSession.sparkContext.broadcast(class_of.astype(np.uint8))
    n, end_class = len(lexicon.words), width - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(width * width, np.int64)
        for batch in batches:
            x = _ids(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            beyond, code = _codes(x, shared.value, n, width)
            left, right = np.append(end_class, code[:-1]), np.append(code[1:], end_class)
            inside = ~beyond & (left < width)
            pairs += np.bincount(left[inside].astype(np.int64) * width + code[inside], minlength=len(pairs))
            at = np.flatnonzero(beyond)
            words = batch.column(2).flatten()
            two = np.flatnonzero(np.diff(at) == 1)
            none = pa.nulls(len(two), pa.int32())
            yield pa.record_batch({"w1": words, "w2": pa.nulls(len(at), pa.binary()), "l": pa.array(left[at], pa.int32()), "r": pa.array(right[at], pa.int32()), "pairs": pa.nulls(len(at), pa.binary())})
            yield pa.record_batch({"w1": words.take(pa.array(two)), "w2": words.take(pa.array(two + 1)), "l": none, "r": none, "pairs": pa.nulls(len(two), pa.binary())})
        yield pa.record_batch({"w1": pa.nulls(1, pa.binary()), "w2": pa.nulls(1, pa.binary()), "l": pa.nulls(1, pa.int32()), "r": pa.nulls(1, pa.int32()), "pairs": pa.array([pairs.tobytes()], pa.binary())})

    return durable(encoded.select("low", "high", "beyond").transform(map_arrow, run, "w1 binary, w2 binary, l int, r int, pairs binary"), "beyond")


def best_classes(before: np.ndarray, after: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Of each row of class counts, the class that most raises the likelihood, to first order: a rare word hardly moves the pairs."""
    n = pairs + 1.0
    gain = after @ np.log(n).T + before @ np.log(n) - np.outer(after.sum(axis=1), np.log(n.sum(axis=1))) - np.outer(before.sum(axis=1), np.log(n.sum(axis=0)))
    return np.argmax(gain[:, :-1], axis=1)


def _rare_words(beyond: DataFrame, bucket_class: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """(word, c, cls) of every training word beyond the lexicon; and ``pairs`` with its neighbours of known class."""
    width = len(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(width * width, np.int64)
        for batch in batches:
            words, contexts = batch.column(0), batch.column(1)
            near = contexts.flatten()
            of = np.repeat(np.arange(len(words)), np.diff(contexts.offsets.to_numpy()))
            le, ri, n = (near.field(k).to_numpy() for k in ("l", "r", "n"))
            c = np.bincount(of, n, len(words)).astype(np.int64)
            before = np.bincount(of * width + le % width, n, len(words) * width).reshape(-1, width)
            after = np.bincount(of * width + ri % width, n, len(words) * width).reshape(-1, width)
            cls = best_classes(before, after, pairs)
            for i in np.flatnonzero(c == 1).tolist():
                cls[i] = bucket_class[_bucket(words[i].as_py())]
            for key, known in ((le * width + cls[of], le < width), (cls[of] * width + ri, ri < width)):
                found += np.bincount(key[known], n[known], len(found)).astype(np.int64)
            yield pa.record_batch({"word": words, "c": pa.array(c), "cls": pa.array(cls, pa.int32()), "pairs": pa.nulls(len(words), pa.binary())})
        yield pa.record_batch({"word": pa.nulls(1, pa.binary()), "c": pa.nulls(1, pa.int64()), "cls": pa.nulls(1, pa.int32()), "pairs": pa.array([found.tobytes()], pa.binary())})

    # One exchange by word serves both groupings; a word has at most (2 * width)**2 different contexts.
    rows = beyond.where("w1 IS NOT NULL AND w2 IS NULL").select("w1", "l", "r").repartition("w1")
    contexts = rows.groupBy("w1", "l", "r").agg(F.count("*").alias("n")).groupBy("w1").agg(F.collect_list(F.struct("l", "r", "n")).alias("contexts"))
    return durable(contexts.transform(map_arrow, run, "word binary, c long, cls int, pairs binary"), "rare")


# --- model ----------------------------------------------------------------------------


@dataclass
class BrownModel:
    """``class_of`` is of ids; ``rare`` has (word, c, cls) of the words beyond the lexicon; logs are to base 10."""

    lexicon: Lexicon
    class_of: np.ndarray
    rare: DataFrame
    log_transition: np.ndarray
    log_mass: np.ndarray
    rounds: int

    @property
    def bucket_class(self) -> np.ndarray:
        return self.class_of[len(self.lexicon.words) : -1]

    def log_emission(self) -> np.ndarray:
        """Of each word of the lexicon and the end, given its class; buckets have 0 here."""
        lex = self.lexicon
        own = np.log10(np.append(lex.counts, np.zeros(BUCKETS + 1)) + 0.5) - self.log_mass[self.class_of]
        own[len(lex.words) : -1], own[-1] = 0.0, np.log10(lex.ends + 0.5) - self.log_mass[-1]
        return own

    def log_bucket(self) -> np.ndarray:
        """Of an unseen word of each bucket, given the bucket's class; a singleton has twice that."""
        s = self.lexicon.singletons
        return np.log10(s + 0.5) - self.log_mass[self.bucket_class] - np.log10(2 * s + 1)


def train(encoded: DataFrame, lexicon: Lexicon, classes: int = CLASSES, gain: float = GAIN, patience: int = PATIENCE, most_rounds: int | None = None) -> BrownModel:
    """A model of the encoded training documents; ``most_rounds`` is for those who want fewer than it takes."""
    width, n = classes + 1, len(lexicon.words)
    item_of = lexicon.item_of()
    items = lexicon.frequent + BUCKETS + 1
    cls = np.arange(items) % classes
    cls[-1] = classes
    best, rounds, idle = None, 0, 0
    while True:
        contexts = _contexts(encoded, item_of, items, cls[item_of], classes)
        pairs = _class_bigrams(contexts, cls, width)
        value = likelihood(pairs)
        idle = idle + 1 if best is not None and value < best[0] + gain else 0
        if best is None or value > best[0]:
            best = value, cls, pairs
        if idle == patience or rounds == most_rounds:
            break
        cls = _exchange(contexts, cls, pairs)
        rounds += 1
    _, cls, pairs = best
    class_of = cls[item_of]
    if n > lexicon.frequent:
        rest = np.full(len(class_of), -1, np.int32)
        rest[lexicon.frequent : n] = np.arange(n - lexicon.frequent)
        contexts = _contexts(encoded, rest, n - lexicon.frequent, class_of, classes)
        class_of = class_of.copy()
        class_of[lexicon.frequent : n] = _exchange(contexts, class_of[lexicon.frequent : n], pairs)
    beyond = _beyond(encoded, lexicon, class_of, width)
    rare = _rare_words(beyond, class_of[n:-1], pairs)
    known = rare.where("word IS NOT NULL").select("word", "c", "cls")
    pairs = _matrix(beyond.where("pairs IS NOT NULL"), width) + _matrix(rare.where("pairs IS NOT NULL"), width)
    two = beyond.where("w2 IS NOT NULL").groupBy("w1", "w2").agg(F.count("*").alias("n"))
    two = two.join(known.select(F.col("word").alias("w1"), F.col("cls").alias("a")), "w1").join(known.select(F.col("word").alias("w2"), F.col("cls").alias("b")), "w2")
    for a, b, c in two.groupBy("a", "b").agg(F.sum("n")).collect():
        pairs[a, b] += c
    members = np.bincount(class_of, minlength=width)
    for c, m in known.where("c > 1").groupBy("cls").count().collect():
        members[c] += m
    size = pairs.sum(axis=0)
    unigram = (size + 1) / (size.sum() + width)
    transition = (pairs + BACKOFF * unigram) / (pairs.sum(axis=1, keepdims=True) + BACKOFF)
    return BrownModel(lexicon, class_of, known, np.log10(transition), np.log10(np.maximum(size + 0.5 * members, 0.5)), rounds)


def score(encoded: DataFrame, model: BrownModel) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every encoded document.

    A row for each document sums what the broadcast lexicon gives; a row for each token
    beyond meets its word's class and count in a join, and one for two such in a row both.
    """
    lex, width = model.lexicon, len(model.log_transition)
    n, end_class, floor = len(lex.words), width - 1, np.log10(lex.total + lex.distinct + 1)
    log_count = np.log10(np.concatenate((lex.counts, np.zeros(BUCKETS), [lex.ends])) + 1.0)
    shared = encoded.sparkSession.sparkContext.broadcast((model.class_of, model.log_transition, model.log_emission(), log_count))
    end_known = lex.ends > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, log_transition, log_emission, log_counts = shared.value
        for batch in batches:
            high = batch.column(4).to_pylist()
            x, size = _ids(batch.column(3).to_pylist(), high), np.array([len(p) for p in high])
            starts = np.append(0, np.cumsum(size)[:-1])
            beyond, code = _codes(x, class_of, n, width)
            left, right = np.append(end_class, code[:-1]), np.append(code[1:], end_class)
            both = ~beyond & (left < width)
            s = log_emission[x] + np.where(both, log_transition[np.minimum(left, end_class), np.minimum(code, end_class)], 0.0)
            rows, base = batch.column(0), np.add.reduceat(log_counts[x], starts) - floor * size
            known = size - 1 - np.add.reduceat(beyond.astype(np.int64), starts) + end_known
            at, words = np.flatnonzero(beyond), batch.column(5).flatten()
            of = rows.take(pa.array(np.searchsorted(starts, at, "right") - 1))
            two = np.flatnonzero(np.diff(at) == 1)
            blank = lambda m: {"doc_id": pa.nulls(m, pa.int64()), "held_out": pa.nulls(m, pa.bool_()), "n_tokens": pa.nulls(m, pa.int64()), "n_known": pa.nulls(m, pa.int64()), "base": pa.nulls(m, pa.float64()), "score": pa.nulls(m, pa.float64())}
            near = lambda m: {"w1": pa.nulls(m, pa.binary()), "w2": pa.nulls(m, pa.binary()), "l": pa.nulls(m, pa.int32()), "r": pa.nulls(m, pa.int32())}
            sums = {"doc_id": batch.column(1), "held_out": batch.column(2), "n_tokens": pa.array(size), "n_known": pa.array(known), "base": pa.array(base), "score": pa.array(np.add.reduceat(s, starts))}
            yield pa.record_batch({"row": rows} | sums | near(len(rows)))
            yield pa.record_batch({"row": of} | blank(len(at)) | near(len(at)) | {"w1": words, "l": pa.array(left[at], pa.int32()), "r": pa.array(right[at], pa.int32())})
            yield pa.record_batch({"row": of.take(pa.array(two))} | blank(len(two)) | near(len(two)) | {"w1": words.take(pa.array(two)), "w2": words.take(pa.array(two + 1))})

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, w1 binary, w2 binary, l int, r int"
    parts = durable(encoded.select("row", "doc_id", "held_out", "low", "high", "beyond").transform(map_arrow, run, schema), "parts")
    array = lambda x: F.lit(np.asarray(x))
    of_bucket = lambda word, values: F.element_at(array(values), _bucket_sql(word) + 1)
    flat = array(model.log_transition.ravel().astype(float))
    step = lambda a, b: F.element_at(flat, a * width + b + 1)
    cls = lambda k: F.coalesce(F.col(f"cls{k}"), of_bucket(f"w{k}", model.bucket_class.astype(np.int32)))
    rare = lambda k: model.rare.select(F.col("word").alias(f"w{k}"), F.col("cls").alias(f"cls{k}"), F.col("c").alias(f"c{k}"))
    once = F.coalesce(F.log10(F.col("c1") + 1.0), F.lit(0.0))
    emitted = F.when(F.col("c1") > 1, F.log10(F.col("c1") + 0.5) - F.element_at(array(model.log_mass.astype(float)), F.col("g") + 1)).otherwise(of_bucket("w1", model.log_bucket().astype(float)) + once)
    beside = F.when(F.col("l") < width, step(F.col("l"), F.col("g"))).otherwise(0.0) + F.when(F.col("r") < width, step(F.col("g"), F.col("r"))).otherwise(0.0)
    tokens = parts.where("w1 IS NOT NULL AND w2 IS NULL").select("row", "w1", "l", "r").join(rare(1), "w1", "left").withColumn("g", cls(1))
    tokens = tokens.select("row", F.when(F.col("c1").isNotNull(), 1).otherwise(0).cast("long").alias("n_known"), once.alias("base"), (emitted + beside).alias("score"))
    pairs = parts.where("w2 IS NOT NULL").select("row", "w1", "w2").join(rare(1), "w1", "left").join(rare(2), "w2", "left")
    pairs = pairs.select("row", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), step(cls(1), cls(2)).alias("score"))
    whole = parts.where("w1 IS NULL").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score")
    every = whole.unionByName(tokens.unionByName(pairs), allowMissingColumns=True)
    out = every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    )
    return out.drop("row").withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out() -> Column:
    """The fold of a document: crc32 of its id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def fit(docs: DataFrame, lexicon: int = LEXICON, frequent: int = FREQUENT, **how) -> tuple[DataFrame, BrownModel]:
    """(all documents encoded, model of those that are not held out); ``docs`` has doc_id, text and held_out."""
    counts = durable(word_counts(docs.where(~F.col("held_out"))), "words")
    words = build_lexicon(counts, lexicon, frequent)
    encoded = encode(docs, words)
    return encoded, train(encoded.where(~F.col("held_out")), words, **how)


def score_corpus(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out, and score every document."""
    encoded, model = fit(docs.select("doc_id", "text").withColumn("held_out", held_out()))
    return score(encoded, model).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
