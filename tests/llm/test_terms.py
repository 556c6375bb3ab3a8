"""The operators on terms and spellings: small tables of odd rows, and the test tables against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lathe.llm import decontamination, divergence, queries, spelling_variants

SF = "/root/testdata/sf0.001"


def _audit_sql(rows, least_docs):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(c.sql(divergence.audit_sql(least_docs)).fetchall())


ODD = [
    ("A b-b B_c é É", "en", "x"), ("a é 漢字 漢字", "en", "x"), ("b b b 漢字", "en", "y"), (None, "en", None), ("", "en", "z"), ("a", None, None), ("a a", None, "y"),
    ("q", "solo", "x"), ("w " * 20_000, "en", "x"), ("a\U0001F600b ퟿", "en", "y"), ("12 _ @", "mute", "x"), ("7", "mute", "y"), ("a é 漢字 漢字", "en", "x"),
]


@pytest.mark.parametrize("least_docs", [1, 2, 99])
def test_divergence_of_odd_rows(spark, least_docs):
    """Null and empty texts, sources without terms, languages of one source or without kept terms, ties, repeated rows."""
    docs = spark.createDataFrame([(i, *r, "n", 1, "p") for i, r in enumerate(ODD)], "doc_id long, text string, lang string, source string, term string, value long, p string").repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(docs, least_docs).collect())
    assert got == _audit_sql(ODD, least_docs)
    assert {r[:4] for r in got} >= {("mute", "x", "pair", "y"), ("en", "", "pair", "z")}
    assert divergence.audit(docs.where("false"), least_docs).collect() == []


def test_divergence_of_huge_counts(spark):
    """Beyond nine billion matches the scaled count leaves 64 bits; the share must not."""
    from pyspark.sql import functions as F

    n, total, v = 2 * 10**12, 3 * 10**13, 5 * 10**6
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).head()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_sql_of_terms(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op12_divergence", "op13_decontamination"):
        got = queries.queries()[name](spark, SF)
        want = c.sql(queries.oracle_sql()[name])
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def _words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _windows(items, k=10):
    out = {}
    for item, text in items:
        w = _words(text)
        for i in range(max(1, len(w) - k + 1) if w else 0):
            out.setdefault(tuple(w[i : i + k]), set()).add(item)
    return out


def _contamination(docs, items):
    windows, out = _windows(items), []
    for doc, text in docs:
        w, hit, named = _words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    named |= {str(y) for y in windows[x] if y is not None}
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def _proximity(docs, items, slop):
    """By the docstring: each term at most ``slop`` from its place, seen from every posting of the rarest."""
    windows, texts = _windows(items), [_words(t) for _, t in docs]
    count = {}
    for w in texts:
        for x in w:
            count[x] = count.get(x, 0) + 1
    out = set()
    for x, named in windows.items():
        off = min(range(len(x)), key=lambda i: (count.get(x[i], 0), i))
        for (doc, _), w in zip(docs, texts, strict=True):
            for at in [i for i, y in enumerate(w) if y == x[off]]:
                if all(any(0 <= p < len(w) and w[p] == y for p in range(at - off + j - slop, at - off + j + slop + 1)) for j, y in enumerate(x)):
                    out |= {(doc, str(n), at - off, len(x)) for n in named}
    return out


PASSAGE = " ".join(f"p{i}" for i in range(14))
ITEMS = [(1, PASSAGE), (2, "Short one"), (3, None), (4, ""), (5, "--- !"), (6, PASSAGE.replace("p13", "q")), (7, "a a a a a a a a a a a"), (6, "word"), (8, "Short, ONE!"), (9, "École漢字 É")]
TEXTS = [
    (1, "x " + PASSAGE.upper() + "."), (2, PASSAGE[:30]), (3, None), (4, ""), (5, "short-one word short one"), (6, "a " * 12 + "b " + "a " * 9), (7, "École漢字-É"), (8, "école漢字 É"),
    (9, "y " * 30_000 + PASSAGE + " " + PASSAGE), (1, "x " + PASSAGE), (None, PASSAGE), (10, PASSAGE.replace("p5", "p5 extra")), (11, PASSAGE.replace("p3 p4", "p4 p3")),
]


@pytest.mark.parametrize("most", [1_000_000, 12])
def test_contamination_of_odd_rows(spark, monkeypatch, most):
    """Null and empty texts and items, short items, repeats within a window, repeated rows, long texts cut into pieces, several blocks of windows."""
    monkeypatch.setattr(decontamination, "MAX_TERMS", most)
    monkeypatch.setattr(decontamination, "PIECE", 1000)
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in TEXTS], "doc_id long, text string, w string, start int").repartition(3)
    items = spark.createDataFrame([(i, t, "d") for i, t in ITEMS], "item_id long, text string, doc string")
    got = lambda d, i: sorted(map(tuple, decontamination.contamination(d, i).collect()), key=repr)
    assert got(docs, items) == _contamination(TEXTS, ITEMS)
    if most > 100:
        assert got(docs, items.where("false")) == _contamination(TEXTS, [])
        assert got(docs.where("false"), items) == []
        assert got(docs, items.withColumn("item_id", items.item_id.cast("string").substr(9, 1))) == _contamination(TEXTS, [("", t) for _, t in ITEMS])
        unnamed = got(docs, items.selectExpr("CAST(NULL AS LONG) AS item_id", "text"))
        assert unnamed == _contamination(TEXTS, [(None, t) for _, t in ITEMS])


@pytest.mark.parametrize("slop", [0, 1, 4])
def test_matches_near_their_places(spark, slop):
    g = np.random.default_rng(3)
    texts = TEXTS[:-5] + [(20 + i, " ".join(f"p{x}" for x in g.permutation(14)[: g.integers(9, 15)])) for i in range(40)] + [(9, PASSAGE.replace("p7", "p7 z z"))] + TEXTS[-2:]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {tuple(r) for r in decontamination.proximity_matches(docs, items, slop=slop).collect()}
    assert got == _proximity(texts, ITEMS, slop)
    if not slop:
        assert got == {tuple(r) for r in decontamination.phrase_matches(docs, items).collect()}


def _counts(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def _variants(n):
    """By patterns with one gap: equal patterns are exchanges, a pattern without its gap that is a word is an addition."""
    gaps, near = {}, {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            gaps.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
            if (shorter := w[:i] + w[i + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for ws in gaps.values():
        for w in ws:
            near[w] |= set(ws) - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def _sorted(rows):
    return sorted(map(tuple, rows))


def test_spelling_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n = _counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = spelling_variants.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = _sorted(got.collect())
    assert got == _variants(n)
    assert any(r[1] for r in got) and max(r[4] for r in got) > 3


def test_spelling_of_odd_rows(spark):
    """Null texts and ids, repeated rows, runs of other letters around, capital letters beyond A-Z, a letter dropped at every place."""
    runs = "garden gardén GARDEN GardeN Éclairs éclairs straße× naïveté12abcdef ﬁnance x_longword-longword".split()
    rows = [(i % 7 if i % 5 else None, " ".join(runs * (i % 3 + 1))) for i in range(40)] + [(3, None), (4, ""), (None, None), (5, "garden " * 900)] * 2
    rows += [(1000 + i, "variation variation") for i in range(600)]
    docs = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], "doc_id long, text string, word string, n int, place int").repartition(3)
    got = _sorted(spelling_variants.word_counts(docs).collect())
    assert got == sorted(_counts(rows).items())
    assert _sorted(spelling_variants.spelling_variants(docs).collect()) == _variants(_counts(rows))
    assert spelling_variants.spelling_variants(docs.where("false")).collect() == []


def test_spelling_of_close_words(spark):
    """Few letters, so that exchanges, additions, runs of one letter, anagrams and ties meet; chains of forms; long words."""
    g = np.random.default_rng(5)
    n = {"".join("abé"[x] for x in g.integers(0, 3, g.integers(1, 7))): int(5 ** g.integers(0, 6)) for _ in range(500)}
    n |= {"x" * 30_000: 1, "x" * 29_999: 30, "x" * 15_000 + "y" + "x" * 14_999: 7, "alone": 4, "": 2} | {"chain"[: i + 1] + "zz": 10**i for i in range(5)}
    counts = spark.createDataFrame(sorted(n.items()), "word string, n long")
    assert _sorted(spelling_variants.variant_groups(counts).collect()) == _variants(n)


def test_keys_shift_by_one_letter():
    key, value = spelling_variants.anagram_key, lambda c: spelling_variants.letter_value(ord(c))
    assert key("listen") == key("silent") != key("listed")
    assert key("listed") - key("listen") == value("d") - value("n") and key("listens") - key("listen") == value("s")
    assert len({value(chr(c)) for c in range(256)}) == 256


@pytest.mark.parametrize("row, right", [((2, 1, 1, 1), True), ((2, 0, 0, 1), False), ((3, -1, 0, 1), True), ((3, -1, 2, 1), False)])
def test_groups_are_compared_letter_by_letter(spark, row, right):
    words = spark.createDataFrame([(1, "abc"), (2, "axc"), (3, "zabc")], "place long, word string")
    rows = spark.createDataFrame([row], "place long, slot int, at int, base long")
    if right:
        return spelling_variants.verify_order(rows, words)
    with pytest.raises(RuntimeError, match="equal hashes"):
        spelling_variants.verify_order(rows, words)
