"""Source divergence audit: which sources of a language write unlike the others, and by which terms.

Plain relational, exact arithmetic throughout:

* the matches of TERM are exploded and counted by (lang, source, term); a match that differs from
  the one before it in its text's sorted matches counts its document, so no document meets a shuffle;
* a language keeps the terms of at least ``least_docs`` of its documents (V of them);
* the language's sources are crossed with its kept terms, which makes missing counts zeros, and
  p = 1 + floor(10^9 (count + 2) / (N + 2 V)), with N the source's matches of kept terms;
* the dense table is joined with itself on lang and term, one order of each pair of sources, and
  f = floor((p - q)^2 / (p + q)) is summed for each pair; f is symmetric, so the other order is a copy;
* against the language's own q, f ranks the terms a source overuses.

The rows to join are sources x terms of a language, and the pairs the square of its sources
times its terms, which is what the audit asks for: give it sources in hundreds, not single hosts.
Every join key and group holds the term, so no hot source or language gathers in one task,
and only the first ``top`` terms of a group leave a task for its ranking.

Defined results: null text, lang and source are ''; every row is a document, repeated rows each;
a source without terms has p of zero counts; a language without kept terms gives pairs of value 0
and no term rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm.common import durable, lower_ascii, small

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000


def _lower(text: Column) -> Column:
    """A-Z only; for a text of ASCII alone that is ``lower``, which is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(lower_ascii(text))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term) with ``n`` matches and ``docs`` documents."""
    texts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), _lower(F.col("text")).alias("text"))
    found = texts.select("lang", "source", F.sort_array(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))
    # The outer form, as Spark would put a filter on the array before the plain one, and match every text again for it.
    each = found.select("lang", "source", F.inline_outer(F.arrays_zip("term", F.concat(F.array(F.lit("")), "term").alias("before")))).where("term IS NOT NULL")
    return each.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum((F.col("term") != F.col("before")).cast("long")).alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (count + 2) / (total + 2 terms)); decimals, as the product leaves 64 bits beyond nine billion."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(count + 2), wide(total + 2 * terms)) + 1


def _apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)): p and q are at most UNIT + 1, so the square stays in 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def dense_shares(docs: DataFrame, least_docs: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources of languages, kept terms of languages, every source with every kept term of its language: n, p and the language's q)."""
    groups = durable(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct(), "groups")
    counts = durable(term_counts(docs), "terms")
    kept = durable(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs), "kept")
    found = durable(counts.drop("docs").join(small(kept.select("lang", "term")), ["lang", "term"]), "found")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = groups.join(langs, "lang").join(found.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    totals = durable(totals.withColumn("total", F.coalesce("total", F.lit(0).cast("long"))), "totals")
    cells = kept.drop("docs").join(small(totals), "lang").join(found, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    p, q = _share(F.col("n"), F.col("total"), F.col("v")), _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    return groups, kept, durable(cells.select("lang", "term", "source", "n", p.alias("p"), q.alias("q")), "cells")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows to each other source of the language, ``term`` rows of the terms overused most."""
    groups, kept, cells = dense_shares(docs, least_docs)
    left, right = cells.select("lang", "term", "source", "p"), cells.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    half = left.join(right, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(_apart("p", "q")).alias("value"))
    half = durable(half, "pairs")
    bare = groups.join(kept.select("lang").distinct(), "lang", "left_anti")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).unionByName(none)
    terms = cells.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [d.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank")) for part, d in (("pair", pairs), ("term", terms))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


def audit_sql(least_docs: int = 10, top: int = 10) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
m AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM m GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM m JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
cell AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
  CAST(1 + CAST({UNIT} AS HUGEINT) * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * v.v) AS BIGINT) AS p,
  CAST(1 + CAST({UNIT} AS HUGEINT) * (kept.n + 2) // (v.total + 2 * v.v) AS BIGINT) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT x.lang, x.source, y.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM cell WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term
QUALIFY rank <= {top}"""
