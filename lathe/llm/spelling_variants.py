"""Spelling variants by anagram hashing.

* The key of a word is the sum of its letters' fifth powers, so anagrams share it, and one inserted,
  deleted or replaced letter shifts it by that letter's power or by the difference of two.
* Keys that differ by any such value meet where the letter's power is taken off: K + v = K' is an
  addition or removal, and K - v = K' - v' an exchange. So each word gives its key, and its key less each of
  its different letters, to an equi-join; the values of the alphabet are never listed.
* Letter order is verified where keys met: the position of the letter and a hash of the letters left
  (61 bits, by two bases) say which words agree in order, and every group is compared letter by
  letter with one of its members. A group that a hash joined wrongly ends the job with an error.

A group that agrees in all but one letter at one place has at most as many words as the alphabet
has letters, and a word with its possible insertions as many as letters times places; they are
numbered by frequency, so a group is counted by a window and no pairs are emitted. Words travel as
numbers; texts of any length, words too, cost a row of fixed size for each letter that met.

A word's form is its near word of largest n (ties: smallest in code-point order) if that is at least
RATIO times its own n. Forms grow in n by that ratio, so chains are short and have no cycles; roots
follow by pointer jumping.

Defined results: null and blank texts have no runs; a null ``doc_id`` reads as ''; repeated rows
count each; no words give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm.common import durable, lower_ascii, map_arrow
from lathe.operators.order import with_place

#: A form is at least so many times as frequent.
RATIO = 5

_MOD = (1 << 61) - 1
_BASES = (0x1B873593CC9E2D51, 0x0165667B19E3779F)
_INVERSE = tuple(pow(b, -1, _MOD) for b in _BASES)


def letter_value(code: int) -> int:
    return code**5 % _MOD


def anagram_key(word: str) -> int:
    return sum(letter_value(ord(c)) for c in word) % _MOD


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, drop_every: int = 199) -> DataFrame:
    """(word, n): runs of Latin letters, A-Z lowered; where ``drop_every`` divides the crc32 of ``<doc_id>:<run>``,
    the run loses one letter, which the crc32 chooses (a made spelling error)."""
    runs = F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    # The outer form: the plain one puts a filter below itself that matches every text again.
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode_outer(runs).alias("run")).where("run IS NOT NULL")
    lower = F.when(F.col("run").rlike("[À-Þ]"), lower_ascii(F.col("run"))).otherwise(F.lower("run"))
    each = each.select("id", lower.alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = each.select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _reduced(words: DataFrame) -> DataFrame:
    """(reduced, letter, place) of (place, word): the word's key as letter 0, and the key less each different letter."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            reduced, letters, places = [], [], []
            for place, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = set(map(ord, word))
                key = anagram_key(word)
                reduced += [key, *((key - letter_value(c)) % _MOD for c in codes)]
                letters += [0, *codes]
                places += [place] * (len(codes) + 1)
            yield pa.record_batch([pa.array(reduced, pa.int64()), pa.array(letters, pa.int32()), pa.array(places, pa.int64())], ["reduced", "letter", "place"])

    return map_arrow(words.select("place", "word"), run, "reduced long, letter int, place long")


def _remainders(word: str) -> tuple[list[tuple[int, int]], tuple[int, int]]:
    """Hashes of the word without the letter at each place, and of the word."""
    codes, cuts, wholes = list(map(ord, word)), [], []
    for base, inverse in zip(_BASES, _INVERSE, strict=True):
        before, total, power = [0], 0, 1
        for c in codes:
            total = (total + c * power) % _MOD
            power = power * base % _MOD
            before.append(total)
        cuts.append([(before[i] + (total - before[i + 1]) * inverse) % _MOD for i in range(len(codes))])
        wholes.append(total)
    return list(zip(*cuts, strict=True)), tuple(wholes)


def _ordered(met: DataFrame) -> DataFrame:
    """(reduced, slot, h1, h2, place, at) of (place, word, met): the letters left, in order, wherever keys have met.

    Slot is the place of an exchanged letter, or -1 for additions, where ``at`` is the place of the added
    letter, -1 for the shorter word itself.
    """
    names = ["reduced", "slot", "h1", "h2", "place", "at"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = [[] for _ in names]

            def put(*row):
                for column, value in zip(out, row, strict=True):
                    column.append(value)

            for place, word, keys in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                cuts, whole = _remainders(word)
                for key in keys:
                    if not key["letter"]:
                        put(key["reduced"], -1, *whole, place, -1)
                        continue
                    letter, last = chr(key["letter"]), -2
                    i = word.find(letter)
                    while i >= 0:
                        if key["exchange"]:
                            put(key["reduced"], i, *cuts[i], place, i)
                        if key["addition"] and i != last + 1:  # within a run of one letter every cut gives the same word
                            put(key["reduced"], -1, *cuts[i], place, i)
                        last, i = i, word.find(letter, i + 1)
                if len(out[0]) > 50_000:
                    yield pa.record_batch([pa.array(c, pa.int32() if n in ("slot", "at") else pa.int64()) for n, c in zip(names, out, strict=True)], names)
                    out = [[] for _ in names]
            yield pa.record_batch([pa.array(c, pa.int32() if n in ("slot", "at") else pa.int64()) for n, c in zip(names, out, strict=True)], names)

    return map_arrow(met.select("place", "word", "met"), run, "reduced long, slot int, h1 long, h2 long, place long, at int")


def verify_order(rows: DataFrame, words: DataFrame) -> None:
    """Every member of a group (place, slot, at, base) against the group's first, letter by letter; one that differs elsewhere is an error."""
    pair = rows.where("place <> base").select("place", "slot", "at", "base").join(words, "place").join(words.select(F.col("place").alias("base"), F.col("word").alias("of_base")), "base")
    left, right = F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.char_length("word"))
    skipped = F.when(F.col("slot") >= 0, 2).otherwise(1)
    base_left, base_right = F.substring("of_base", F.lit(1), F.col("at")), F.substring("of_base", F.col("at") + skipped, F.char_length("of_base"))
    if pair.where((left != base_left) | (right != base_right)).limit(1).count():
        raise RuntimeError("words with equal hashes differ in more than one letter")


def near_words(words: DataFrame) -> DataFrame:
    """(place, n_near, best) of (place, word), places being a total order: how many words are one letter away, and the first of them."""
    reduced = durable(_reduced(words), "reduced")
    some = F.col("letter") > 0
    keys = reduced.groupBy("reduced").agg(F.min(F.when(some, F.col("letter"))).alias("least"), F.max(F.when(some, F.col("letter"))).alias("most"), F.max((~some).cast("int")).alias("whole"))
    keys = keys.select("reduced", (F.col("least") < F.col("most")).alias("exchange"), ((F.col("whole") == 1) & F.col("most").isNotNull()).alias("addition")).where("exchange OR addition")
    met = reduced.join(keys, "reduced").where("letter > 0 OR addition").groupBy("place").agg(F.collect_list(F.struct("reduced", "letter", "exchange", "addition")).alias("met"))
    group = Window.partitionBy("reduced", "slot", "h1", "h2")
    whole, first = F.col("at") < 0, F.min("place").over(group)
    n, n_whole = F.count("*").over(group), F.count(F.when(whole, 1)).over(group)
    shorter, longer = F.min(F.when(whole, F.col("place"))).over(group), F.min(F.when(~whole, F.col("place"))).over(group)
    exchange = F.col("slot") >= 0
    rows = _ordered(met.join(words, "place")).select(
        "place", "slot", "at",
        F.when(exchange, n - 1).when(whole, n - n_whole).otherwise(n_whole).alias("near"),
        F.when(exchange, F.when(F.col("place") == first, F.lead("place").over(group.orderBy("place"))).otherwise(first)).when(whole, longer).otherwise(shorter).alias("best"),
        F.when(exchange, first).otherwise(shorter).alias("base"),
    ).where("near > 0")
    rows = durable(rows, "near")
    verify_order(rows, words)
    return rows.groupBy("place").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(place, root) of (place, form): the last form that can be reached; forms have no cycles."""
    to = durable(forms.toDF("place", "root"), "roots")
    while True:
        up = to.select(F.col("place").alias("root"), F.col("root").alias("above"))
        to = durable(to.join(up, "root", "left").select("place", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        moved = to.where("moved").limit(1).count()
        to = to.select("place", "root")
        if not moved:
            return to


def variant_groups(counts: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n), words being distinct."""
    words = durable(with_place(durable(counts.select("word", "n"), "words"), F.desc("n"), F.asc("word")), "placed")
    near = durable(near_words(words.select("place", "word")), "near-words")
    target = words.select(F.col("place").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    formed = near.join(words.select("place", "n"), "place").join(target, "best").where(F.col("form_n") >= RATIO * F.col("n"))
    formed = durable(formed.select("place", "best", "form", "form_n"), "forms")
    ends = roots(formed.select("place", "best")).join(words.select(F.col("place").alias("root"), F.col("word").alias("root_word")), "root").select("place", "root_word")
    out = words.join(near.select("place", "n_near"), "place", "left").join(formed.drop("best"), "place", "left").join(ends, "place", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Groups of the words of documents, with made errors; see ``word_counts``."""
    return variant_groups(word_counts(docs))
