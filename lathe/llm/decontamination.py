"""Benchmark decontamination with a positional inverted index.

* Items are cut into windows of ``window`` words (a shorter item is one window); equal windows
  of all items are searched once.
* The index holds a posting (term, document, position) for every word of every document that
  occurs in the benchmark at all. It is partitioned by documents, so building it moves nothing.
* Terms are ranked in each window by their postings, rarest first. The list of the rarest term,
  its positions less the term's offset in the window, gives the places where the window may start;
  the lists of the second and third rarest are intersected with those, and the lists of the
  common terms only with the few places left, in documents that still have one.
* A place that every term of the window confirms is a phrase match. With ``slop`` above 0 each term
  may stand that many words from its place (counted from the rarest term's), which is a proximity match.

Terms are ids of whole words, so equal ids are equal words and nothing is matched by hash.
A benchmark of more than MAX_TERMS different words is searched in blocks of windows, each with
its own index over all documents; ids of one block are all that the driver gathers and
broadcasts. Joins are on the document with a position and a term, so neither a long document,
nor a copied one, nor a frequent word gathers in one task.

Defined results: null or blank texts have no words and match nothing; repeated rows are searched
each and give a row each, a null ``doc_id`` too; items that share an ``item_id`` are one in the
list; an item with a null ``item_id`` is searched and can be hit, but not listed; an empty benchmark
hits nothing; an empty table gives no rows; further columns are ignored. Texts are cut into words
piece by piece, so a long one needs no more memory than its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm.common import durable, map_arrow, small, utf8

#: Different words that one block of the benchmark may hold.
MAX_TERMS = 1_000_000

#: Bytes of text cut into words at a time.
PIECE = 1 << 18

#: Postings of an Arrow batch, at least; a piece of text adds some to it.
BATCH = 1 << 15

#: Ranks of a window's terms whose lists are intersected one after the other; the rest follow at once.
FIRST_RANKS = (2, 3)

#: Bytes to bytes: A-Z lowered, every ASCII character that is no letter or digit a space.
_CLEAN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def _pieces(raw: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, in order, some at a time."""
    clean = (raw or b"").translate(_CLEAN)
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def item_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """(item, words) of every window of every item, ``item`` as a string and words as UTF-8."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                held: list[bytes] = []
                whole = True
                for words in _pieces(raw):
                    held += words
                    cut = [held[i : i + window] for i in range(len(held) - window + 1)]
                    whole = whole and not cut
                    held = held[len(cut) :]
                    yield pa.record_batch([pa.array([name] * len(cut), pa.string()), pa.array(cut, pa.list_(pa.binary()))], ["item", "words"])
                if whole and held:
                    yield pa.record_batch([pa.array([name], pa.string()), pa.array([held], pa.list_(pa.binary()))], ["item", "words"])

    return map_arrow(items.select(F.col("item_id").cast("string").alias("item"), "text"), run, "item string, words array<binary>")


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text")


def build_index(rows: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(term, doc, pos, doc_id) of rows (doc, doc_id, text): a posting for each word in ``terms``, and for each document
    a row of term -1 with its words in ``pos``, the only one to carry ``doc_id``.
    """
    shared = rows.sparkSession.sparkContext.broadcast(terms)
    names = ["term", "doc", "pos", "doc_id"]

    def run(batches):
        find = shared.value.get
        for batch in batches:
            docs_, ids = batch.column(0), batch.column(1)
            counts, out, held = [], [], 0

            def postings(out):
                t, d, p = (np.concatenate(x) for x in zip(*out, strict=True))
                return pa.record_batch([pa.array(t), pa.array(d), pa.array(p), pa.nulls(len(t), ids.type)], names)

            for doc, raw in zip(docs_.to_pylist(), utf8(batch.column(2)), strict=True):
                n = 0
                for words in _pieces(raw):
                    found = np.fromiter(map(find, words, repeat(-1)), np.int32, len(words))
                    at = np.flatnonzero(found >= 0)
                    out.append((found[at], np.full(len(at), doc, np.int64), (at + n).astype(np.int32)))
                    n, held = n + len(words), held + len(at)
                    if held > BATCH:
                        yield postings(out)
                        out, held = [], 0
                counts.append(n)
            if out:
                yield postings(out)
            yield pa.record_batch([pa.array(np.full(len(counts), -1, np.int32)), docs_, pa.array(counts, pa.int32()), ids], names)

    return map_arrow(rows, run, f"term int, doc long, pos int, doc_id {rows.schema['doc_id'].dataType.simpleString()}")


def _asked(places: DataFrame, wanted: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """Of every place the terms of ``wanted`` that have a posting where the place needs one: (w, doc, start, len, off)."""
    width = 2 * slop + 1
    asked = places.join(small(wanted.select("w", "off", "term")), "w").withColumn("low", F.col("start") + F.col("off") - slop)
    cell = lambda c: F.floor(c / width).cast("int")
    if slop:
        asked = asked.withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("low")), cell(F.col("low") + width - 1)))))
    else:
        asked = asked.withColumn("cell", F.col("low"))
    lists = postings.join(small(wanted.select("term").distinct()), "term", "left_semi").withColumn("cell", cell(F.col("pos")) if slop else F.col("pos"))
    met = asked.join(lists, ["doc", "cell", "term"]).where((F.col("pos") >= F.col("low")) & (F.col("pos") < F.col("low") + width)).select("w", "doc", "start", "len", "off")
    return met.distinct() if slop else met


def intersect(index: DataFrame, window_terms: DataFrame, slop: int = 0) -> DataFrame:
    """(w, doc, start, len): where the windows of ``window_terms`` (w, off, term, len) occur in the documents of an index."""
    postings = index.where("term >= 0").select("term", "doc", "pos")
    sizes = durable(postings.groupBy("term").agg(F.count("*").alias("postings")), "sizes")
    listed = window_terms.join(small(sizes), "term", "left")
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("w").orderBy(F.col("postings").asc_nulls_first(), "off")))
    met = F.count("postings").over(Window.partitionBy("w")) == F.col("len")
    ranked = durable(ranked.withColumn("met", met).where("met").drop("met", "postings"), "ranked")
    rarest = ranked.where("rank = 1").select("w", "off", "term", "len")
    places = postings.join(small(rarest), "term").select("w", "doc", (F.col("pos") - F.col("off")).alias("start"), "len")
    if not slop:
        places = places.where("start >= 0")
    for rank in FIRST_RANKS:
        wanted = ranked.where(F.col("rank") == rank)
        places = durable(places.where(F.col("len") < rank).unionByName(_asked(places.where(F.col("len") >= rank), wanted, postings, slop).drop("off")), "places")
    last = FIRST_RANKS[-1]
    open_ = places.where(F.col("len") > last)
    near = postings.join(small(durable(open_.select("doc").distinct(), "near")), "doc", "left_semi")
    met = _asked(open_, ranked.where(F.col("rank") > last), near, slop).groupBy("w", "doc", "start", "len").agg(F.count("*").alias("n"))
    return places.where(F.col("len") <= last).unionByName(met.where(F.col("n") == F.col("len") - last).drop("n"))


def _blocks(windows: DataFrame) -> int:
    """The least power of two of blocks of windows in which none has more than MAX_TERMS different words."""
    blocks = 1
    while True:
        words = windows.select(F.pmod("w", F.lit(blocks)).alias("b"), F.explode("words").alias("word")).distinct()
        most = words.groupBy("b").count().agg(F.max("count")).head()[0] or 0
        if most <= MAX_TERMS or blocks > 1 << 20:
            return blocks
        blocks *= 2


def search(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: doc, doc_id, n_words; matches: doc, w, start, len; windows of items: item, w).

    A match of slop 0 is a phrase match: the window's words stand at start, start + 1 and so on.
    """
    every = durable(item_windows(items, window), "item-windows")
    windows = durable(every.select("words").distinct().withColumn("w", F.monotonically_increasing_id()), "windows")
    of_items = durable(every.join(windows, "words").select("item", "w").distinct(), "of-items")
    blocks = _blocks(windows)
    found, heads = None, None
    rows = numbered(docs) if blocks == 1 else durable(numbered(docs), "rows")  # all blocks must see the same numbers
    for b in range(blocks):
        mine = windows.where(F.pmod("w", F.lit(blocks)) == b)
        flat = mine.select("w", F.size("words").alias("len"), F.posexplode("words").alias("off", "word"))
        ids = durable(flat.select("word").distinct().withColumn("term", F.row_number().over(Window.orderBy("word")) - 1), "ids")
        index = durable(build_index(rows, {bytes(r.word): r.term for r in ids.collect()}), "index")
        window_terms = durable(flat.join(small(ids), "word").drop("word"), "window-terms")
        matches = durable(intersect(index, window_terms, slop), "matches")
        found = matches if found is None else found.unionByName(matches)
        heads = heads if heads is not None else index.where("term = -1").select("doc", "doc_id", F.col("pos").cast("long").alias("n_words"))
    return heads, found, of_items


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, item_id, start, len): every place where a window of an item stands in a document."""
    return _named(*search(docs, items, window))


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 3) -> DataFrame:
    """(doc_id, item_id, start, len): every place where each term of a window stands at most ``slop`` words from where
    a phrase match with the same rarest term would have it; phrase matches are among them."""
    return _named(*search(docs, items, window, slop))


def _named(heads: DataFrame, matches: DataFrame, of_items: DataFrame) -> DataFrame:
    return matches.join(of_items, "w").join(heads, "doc").select("doc_id", F.col("item").alias("item_id"), "start", "len").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    heads, matches, of_items = search(docs, items, window)
    spans = matches.groupBy("doc", "start").agg((F.col("start") + F.max("len")).alias("end"))
    before = F.max("end").over(Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))))
    hits = fresh.groupBy("doc").agg(F.sum("fresh").alias("n_hit"))
    named = matches.select("doc", "w").distinct().join(of_items.where("item IS NOT NULL"), "w").select("doc", "item").distinct()
    lists = named.groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = heads.join(hits, "doc", "left").join(lists, "doc", "left")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    items_ = F.coalesce("items", none)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def contamination_sql(window: int = 10) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {words} AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS words FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(words), {window}) AS n, array_to_string(words[i:i + least(len(words), {window}) - 1], ' ') AS k
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - {window} + 1, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
dw AS (SELECT doc, n, i, array_to_string(words[i:i + n - 1], ' ') AS k
  FROM (SELECT doc, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(words) >= n)),
m AS (SELECT doc, i, n, item FROM dw JOIN iw USING (n, k)),
h AS (SELECT doc, count(DISTINCT p) AS n_hit FROM (SELECT doc, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc, i, n FROM m)) GROUP BY doc),
l AS (SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc, item FROM m WHERE item IS NOT NULL) GROUP BY doc)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc) LEFT JOIN l USING (doc)"""
