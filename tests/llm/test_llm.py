"""The training-data operators on a small table of edge cases, and against plain versions."""

import hashlib
import math
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lathe.llm import brown_lm, decision_list, host_reputation, imatch, jaccard_join, license_rules, mixing, packing, queries, substring_dedup, warc_derive
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls long, n string, word string"
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = {1: BASE, 2: BASE, 3: BASE.replace("w59", "x"), 4: None, 5: "", 6: " \t\n", 7: "One two", 8: "one TWO", 9: " ".join(f"v{i % 977}" for i in range(30_000)), 10: "ß Ä 漢字 <|endoftext|>", 11: BASE + " tail " + BASE}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", None, i, "x", "y") for i, t in TEXTS.items()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _null_ids(spark):
    return spark.createDataFrame([(None, BASE, None, None, None, None, None, None)] * 2 + [(1, BASE, None, None, None, None, None, None)] * 2, SCHEMA)


def test_components(spark, docs, real):
    for d, texts in ((docs, TEXTS), (real, {r.doc_id: r.text for r in real.collect()})):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_components(d).collect()} == brute.components(texts)
    assert jaccard_join.near_duplicate_components(docs.where("false")).count() == 0
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard_join.near_duplicate_components(_null_ids(spark)).collect()) == [(0, 1), (0, 1), (1, 1), (1, 1)]
    assert {r.doc_id for r in jaccard_join.keep_one_of_each(docs).collect()} == {1, 4, 5, 6, 7, 9, 10}  # 11 holds BASE twice: 56 of 64 shingles


def test_components_of_random_near_copies(spark, monkeypatch):
    """Texts with equal prefixes and sizes, chains, stars, and buckets of every kind, also with the exact steps alone."""
    g = np.random.default_rng(7)
    texts, i = {}, 0
    for n in (6, 7, 12, 25, 60, 90):
        for family in range(4):
            base = [f"f{n}x{family}y{j}" for j in range(n)]
            for _ in range(12):
                t = list(base)
                for _ in range(int(g.integers(0, 3))):
                    t[int(g.integers(0, n))] = f"z{g.integers(0, 3)}"
                if g.random() < 0.3:
                    t = t[: n - int(g.integers(0, 3))]
                texts[i] = " ".join(t)
                i += 1
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = brute.components(texts)
    for rounds, linear, probe in ((8, 16, 4_000_000), (0, 16, 4_000_000), (2, 0, 4_000_000), (1, 0, 1500)):
        monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", rounds)
        monkeypatch.setattr(jaccard_join, "LINEAR", linear)
        monkeypatch.setattr(jaccard_join, "MAX_PROBE", probe)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_components(d).collect()} == want


def test_components_with_large_buckets_and_more_star_rounds(spark, monkeypatch):
    """Groups of a bucket's main label meet the others alone; heavy buckets have rounds of their own."""
    g = np.random.default_rng(11)
    texts = {}
    for family in range(3):
        base = [f"f{family}y{j}" for j in range(60)]
        for i in range(40):
            t = list(base)
            for _ in range(int(g.integers(0, 9))):
                t[int(g.integers(0, 60))] = f"z{g.integers(0, 5)}"
            texts[100 * family + i] = " ".join(t)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = brute.components(texts)
    assert len({c for _, c in want.values()}) > 6
    for rounds, linear, few in ((8, 1, 1_000_000), (8, 4, 0), (1, 1, 0)):
        monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", rounds)
        monkeypatch.setattr(jaccard_join, "LINEAR", linear)
        monkeypatch.setattr(jaccard_join, "FEW", few, raising=False)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_components(d).collect()} == want


def test_star_rounds_that_find_nothing_stop(spark, monkeypatch):
    """Sets that share a prefix and are not similar: one more round, not all of them, whatever is left to probe."""
    low = next(w for w in (f"a{i} b c d e" for i in range(1000)) if jaccard_join.shingle_set(w.encode())[0] < 1 << 60)
    texts = {i: f"{low} u{i}" for i in range(100)}  # no task sees the common shingle twice, so it stands first in most prefixes
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartitionByRange(100, "doc_id")
    weighed, heavy = [], jaccard_join._heavy

    def recorded(*x):
        found = heavy(*x)
        weighed.append(found[2])
        return found

    monkeypatch.setattr(jaccard_join, "_heavy", recorded)
    monkeypatch.setattr(jaccard_join, "MAX_PROBE", 40)
    monkeypatch.setattr(jaccard_join, "FEW", 10, raising=False)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_components(d).collect()} == brute.components(texts)
    assert weighed[0] > 40 and len(weighed) <= 2


def test_group_of_many_sets_with_one_prefix(spark):
    """Sets that agree in size and in their coldest shingles, and differ in hot ones: one group of several classes."""
    hot = [f"h{i}" for i in range(30)]
    cold = [f"c{i}" for i in range(400)]
    tail = lambda i: [hot[(i + j) % 30] for j in range(10)]
    mine = {i: " ".join(cold + tail(i)) for i in range(24)}
    # All that the 24 texts differ in is common elsewhere, so it comes last in the order.
    filler = {1000 + 60 * i + k: " ".join(cold[-4:] + tail(i) + [f"u{i}v{k}w{j}" for j in range(20)]) for i in range(24) for k in range(60)}
    texts = mine | filler
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    signed = jaccard_join._signatures(d, 5, 80, jaccard_join._repeats(d, 5, 22)).where("doc_id < 1000")
    assert signed.groupBy("gid").agg(F.count_distinct("k1").alias("c")).agg(F.max("c")).first()[0] > 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_components(d).collect()} == brute.components(texts)


def test_repeats(spark, docs, real):
    for d, texts in ((docs, TEXTS), (real, {r.doc_id: r.text for r in real.collect()})):
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removal_digest(d).collect()} == brute.repeats(texts)
    assert substring_dedup.removal_digest(docs.where("false")).count() == 0
    assert {r.n_removed for r in substring_dedup.removal_digest(_null_ids(spark)).collect()} == {0}
    cut = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    assert cut[1] == BASE and cut[2] == "" and cut[4] is None and cut[11] == "tail"


def test_brown_scores(docs, real):
    for d, texts in ((docs, TEXTS), (real, {r.doc_id: r.text for r in real.collect()})):
        tokens = {k: (v or "").encode().lower().split() + [b""] for k, v in texts.items()}
        c = Counter(w for k, v in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in v)
        n, v = sum(c.values()), len(c)
        got = {r.doc_id: r for r in brown_lm.score_corpus(d).collect()}
        assert set(got) == set(texts)
        for k, ws in tokens.items():
            r = got[k]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert brown_lm.score_corpus(docs.where("false")).count() == 0


def _classes(model):
    lex = model.lexicon
    listed = dict(zip(lex.words, model.class_of[: len(lex.words)].tolist(), strict=True))
    return listed | {bytes(r.word): r.cls for r in model.rare.where("c > 1").collect()}


@pytest.mark.parametrize("lexicon, frequent", [(1 << 17, 1 << 15), (150, 60), (0, 0)])
def test_brown_against_counts(docs, real, lexicon, frequent):
    """The model and its scores, with words of every kind: in rounds, in the lexicon, beyond it, met once and unseen."""
    for d in (docs, real.where("doc_id < 120"))[lexicon != 150 :]:
        d = d.select("doc_id", "text").withColumn("held_out", brown_lm.held_out())
        texts = {r.doc_id: r.text for r in d.collect()}
        encoded, model = brown_lm.fit(d, lexicon, frequent, most_rounds=1)
        train = {r.doc_id for r in d.where("NOT held_out").collect()}
        want = brute.class_scores(texts, train, _classes(model), model.bucket_class.tolist(), brown_lm.CLASSES + 1, brown_lm.BACKOFF)
        got = {r.doc_id: r for r in brown_lm.score(encoded, model).collect()}
        assert {k: r.score for k, r in got.items()} == pytest.approx(want)
        counts = Counter(w for k in train for w in (texts[k] or "").encode().lower().split())
        assert set(_classes(model)) == {w for w, c in counts.items() if c > 1}
        assert all(r.n_known == sum(w in counts for w in (texts[k] or "").encode().lower().split()) + 1 for k, r in got.items())


def test_brown_is_a_distribution(spark, real):
    """Over all words, and an unseen one of every bucket, what texts of one word can be adds up."""
    d = real.select("doc_id", "text").withColumn("held_out", brown_lm.held_out())
    _, model = brown_lm.fit(d, 100, 50, most_rounds=1)
    words = {w for (t,) in d.where("NOT held_out").select("text").collect() for w in (t or "").encode().lower().split()}
    new, i = {}, 0
    while len(new) < brown_lm.BUCKETS:
        w, i = f"\u00a7{i:05d}".encode(), i + 1
        new.setdefault(brown_lm._bucket(w), w)
    ones = spark.createDataFrame([(i, w.decode()) for i, w in enumerate(sorted(words | set(new.values())))], "doc_id long, text string").withColumn("held_out", F.lit(True))
    p = sum(10**r.score for r in brown_lm.score(brown_lm.encode(ones, model.lexicon), model).collect())
    t = 10**model.log_transition
    assert p == pytest.approx((t[-1, :-1] * t[:-1, -1]).sum()) and np.allclose(t.sum(axis=1), 1)


def test_brown_rounds_stop_when_they_gain_little(real, monkeypatch):
    seen = []
    monkeypatch.setattr(brown_lm, "likelihood", lambda pairs, f=brown_lm.likelihood: seen.append(f(pairs)) or seen[-1])
    d = real.select("doc_id", "text").withColumn("held_out", brown_lm.held_out())
    _, model = brown_lm.fit(d)
    small = [b < max(seen[: i + 1]) + brown_lm.GAIN for i, b in enumerate(seen[1:])]
    n = brown_lm.PATIENCE
    assert len(seen) == model.rounds + 1 and all(small[-n:]) and not any(all(small[i : i + n]) for i in range(len(small) - n))


def test_brown_without_training_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a b")] * 3 + [(None, "a c")] * 2, "doc_id long, text string").withColumn("word", F.lit("x"))
    got = sorted((r.doc_id or 0, r.n_tokens, r.held_out) for r in brown_lm.score_corpus(rows).collect())
    assert got == [(0, 3, False)] * 2 + [(1, 3, zlib.crc32(b"1") % 7 == 2)] * 3
    encoded, model = brown_lm.fit(rows.select("doc_id", "text").withColumn("held_out", F.lit(True)))
    out = brown_lm.score(encoded, model).collect()
    assert len(out) == 5 and all(r.score < -5 and r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in out)


def test_packing(docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, range_chars=20_000).collect()
    ids = {k: np.array([*tok.encode(v or "", add_special_tokens=False).ids, 1], "<u4") for k, v in TEXTS.items()}
    seen = Counter()
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
    assert seen == {k: len(v) for k, v in ids.items()}
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and (at & (at - 1)) == 0
    assert packing.pack(docs.where("false")).count() == 0


def test_both_encoders_give_the_same_ids():
    """Random strings of plain characters, of any characters, and of words run together, by the file and by the fast way."""
    from tokenizers import Tokenizer

    import public_tokenizers

    g, enc, tok = np.random.default_rng(11), packing.encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(161, 592), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0))]
    common = ["'s", "'LL", " the", "  ", "\n\n", "\r\n", " \t", "100", "½", "naïve", "Straße", "…", "—", "don't", "I'VE", "²³", "ǅ", "ª", "<|endoftext|>"]
    strings = ["".join(g.choice(plain, g.integers(0, 40))) for _ in range(4000)]
    strings += ["".join(g.choice(common + plain[:100], g.integers(0, 30))) for _ in range(4000)]
    strings += ["".join(map(chr, g.integers(1, 0xD7FF, 20))) for _ in range(500)]
    assert sum(bool(packing._PLAIN.match(s)) for s in strings) > 7000
    for s in strings:
        assert enc.ids(s).tolist() == tok.encode(s, add_special_tokens=False).ids, s


def test_equal_rows_are_packed_each(spark):
    rows = spark.createDataFrame([(None, "a b c")] * 40 + [(7, "d")] * 3, "doc_id long, text string")
    got = Counter()
    for r in packing.pack(rows, range_chars=20).collect():
        got[r.doc_id] += r.length
    assert got[None] == 40 * (len(packing.encoder().ids("a b c")) + 1) and got[7] == 3 * (len(packing.encoder().ids("d")) + 1)


def test_hilbert_is_a_walk():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    walk = grid[np.argsort(packing.hilbert_index(grid, 4))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("way", ["broadcast", "join"])
def test_imatch(spark, docs, real, way, monkeypatch):
    if way == "join":
        monkeypatch.setattr(imatch, "MAX_LEXICON", 0)
    cols = [f.split()[0] for f in imatch.DIGEST.split(", ")]
    for d, rows in ((docs, 3), (real, 20)):
        monkeypatch.setattr(imatch, "RANGE_ROWS", rows)
        got = sorted(tuple(r[c] for c in cols) for r in imatch.fingerprint_digest(d).collect())
        assert got == sorted(brute.imatch([(r.doc_id, r.text) for r in d.collect()], imatch.LOW, imatch.HIGH))
    assert imatch.fingerprint_digest(docs.where("false")).count() == 0


def test_imatch_repeated_rows_and_ids(spark, monkeypatch):
    """Equal rows beyond ALIKE, null ids, the smallest id, and a third of all rows alike."""
    monkeypatch.setattr(imatch, "ALIKE", 4)
    monkeypatch.setattr(imatch, "RANGE_ROWS", 3)
    rows = [(i, f"a{i % 3} b c{i} d") for i in range(20)] + [(None, "same words here")] * 12 + [(7, "x y z w")] * 5 + [(-(2**63), "least of all")] + [(2**63 - 1, None)] * 6
    got = sorted(map(repr, map(tuple, imatch.fingerprint_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())))
    want = brute.imatch(sorted(rows, key=lambda r: (r[0] or 0, xxhash.xxh64((r[1] or "").encode(), 42).intdigest() + 2**63 & (2**64 - 1))), imatch.LOW, imatch.HIGH)
    assert got == sorted(map(repr, want))


def test_quality(spark, docs, real):
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 0), (3, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in decision_list.quality_report(docs, labels).collect()}
    assert out[4].base_failed and not out[4].kept and out[1].kept and out[9].n_repeat_words == 30_000 and out[10].n_symbols == 4
    assert decision_list.quality_report(docs.where("false"), labels.where("false")).count() == 0
    assert decision_list.keep_good(docs, labels).columns == docs.columns
    twice = _null_ids(spark)
    assert decision_list.quality_report(twice, labels).count() == 4 and decision_list.keep_good(twice, labels).count() == 4
    own = spark.read.parquet(f"{SF}/labels.parquet")
    rules = decision_list.learn_rules(real, own)
    for d in (docs, real):
        texts = {r.doc_id: r.text for r in d.collect()}
        got = {r.doc_id: r for r in decision_list.judge(d.select("doc_id", "text"), rules).select("doc_id", "s.*", "base_failed", "kept").collect()}
        for k, t in texts.items():
            want = brute.statistics(t)
            assert all(got[k][c] == v for c, v in want.items()), k
        assert {k for k, r in got.items() if r.kept} == brute.judged(texts, rules)


def test_sample_of_labels_is_the_same_with_ties(spark, real):
    labels = spark.createDataFrame([(i % 40, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    a, b = (decision_list.labelled_features(real, x, 30).toPandas() for x in (labels, labels.repartition(7)))
    cols = list(a.columns)
    assert len(a) == 30 and a.sort_values(cols).reset_index(drop=True).equals(b.sort_values(cols).reset_index(drop=True))


def test_decision_list_recovers_a_rule():
    import pandas as pd

    g = np.random.default_rng(3)
    rows = pd.DataFrame({k: g.random(3000) for k in decision_list.FEATURES} | {"turn": np.arange(3000)})
    rows["bad"] = (rows["upper_share"] > 0.8) | (rows["distinct_share"] < 0.1)
    rules = decision_list.learn(rows)
    said = np.zeros(len(rows), bool)
    for r in rules:
        said |= r.covers({k: rows[k].to_numpy() for k in decision_list.FEATURES})
    assert (said == rows["bad"]).mean() > 0.98


def _levels(sizes: dict) -> dict:
    """source -> target: excess over three times the size is shared again by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, open_, out, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(order), {}, float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(spark, docs):
    tenth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for d in (docs, _null_ids(spark), tenth):
        rows = mixing.mix_report(d).collect()
        words = {}
        for r in d.collect():
            words[r.source] = words.get(r.source, 0) + len((r.text or "").encode().split())
        want = _levels(words)
        assert len(rows) == d.count() and all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
        assert all(r.target == pytest.approx(want[r.source]) and r.source_size == words[r.source] for r in rows)
        for s in words:
            of = [r for r in rows if r.source == s]
            short = [r.size for r in of if r.size <= words[s] / max(1, sum(x.size > 0 for x in of))]
            slack = max(short, default=0) if sum(short) > 2 * max(r.size for r in of) else max(r.size for r in of)
            assert abs(sum(r.taken for r in of) - of[0].target) <= max(0.05 * of[0].target, slack), s
            assert all(math.floor(r.target / max(1, r.source_size) + 1e-9) <= r.copies <= math.ceil(r.target / max(1, r.source_size) - 1e-9) for r in of)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(d).collect()))
        mixed = Counter((r.doc_id, r.source, r.text) for r in mixing.mix(d).collect())
        assert sum(mixed.values()) == sum(r.copies for r in rows) and set(mixed) <= {(r.doc_id, r.source, r.text) for r in d.collect()}
    assert mixing.mix_report(docs.where("false")).count() == 0 and mixing.mix(docs.where("false")).count() == 0


def test_mixing_of_equal_rows_and_clashing_names(spark):
    rows = [(None, "a b c d e f g", "hot", 1, 2, 3)] * 600 + [(i, "w " * (i % 40), "b", 1, 2, 3) for i in range(300)] + [(i, "v w", "c", 1, 2, 3) for i in range(9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, copies int, size int").repartition(5)
    got = mixing.mix_report(d).collect()
    for s in "hot", "b", "c":
        of = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 40
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns and mixed.count() == sum(r.copies for r in got)


def test_mixing_keeps_expectations(spark):
    """Over four thousand seeds each document's mean number of extra copies is its fraction, and every seed keeps the words' sum."""
    sizes, p, seeds = [50, 20, 20, 7, 3, 1], [0.3, 0.8, 0.5, 0.1, 0.9, 0.4], 4000
    unit = {"row": "bigint", "doc_id": "bigint", "size": "bigint", "salt": "bigint", "p": "double"}
    assert set(unit) == set(mixing.UNIT)
    values = [{"row": F.lit(i), "doc_id": F.lit(i), "size": F.lit(n), "salt": F.col("id"), "p": F.lit(x)} for i, (n, x) in enumerate(zip(sizes, p, strict=True))]
    items = F.array(*(F.struct(*(v[k].cast(unit[k]).alias(k) for k in mixing.UNIT)) for v in values))
    start = F.struct(F.element_at("items", 1).alias("carry"), F.expr("CAST(array() AS array<struct<row: bigint, extra: int>>)").alias("done"))
    folded = spark.range(seeds).select(items.alias("items")).select(F.aggregate(F.slice("items", 2, len(sizes)), start, mixing._meet(1)).alias("r")).collect()
    total, one = np.zeros(len(sizes)), np.zeros(len(sizes))
    for (r,) in folded:
        one[r.carry.row] = r.carry.p
        for d in r.done:
            one[d.row] = d.extra
        assert abs(np.dot(one, sizes) - np.dot(p, sizes)) < 1e-6
        total += one
    error = np.sqrt(np.array(p) * (1 - np.array(p)) / seeds)
    assert np.all(np.abs(total / seeds - p) < 4.5 * error), total / seeds


def test_mixing_sources_come_near_their_targets(spark, monkeypatch):
    rows = [(i, "w " * (3 + i * i % 37), "a" if i % 5 else "b") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total: Counter = Counter()
    for seed in range(2):
        monkeypatch.setattr(mixing, "SEED", seed)
        for r in mixing.mix_report(d).collect():
            total[r.source] += r.copies - r.target / r.source_size
    assert abs(total["a"]) < 12 and abs(total["b"]) < 6


def test_mixing_block_above_the_default(spark):
    # 6000 units of one size, two sources: one block holds more than 64 * 64 of them.
    sized = spark.range(6000).select(F.col("id").alias("row"), F.col("id").alias("doc_id"), F.when(F.col("id") % 12 == 0, "b").otherwise("a").alias("source"), F.lit(10).cast("long").alias("size"))
    for block in (64, 10_000):
        rows = mixing.rounded_copies(sized, block=block).collect()
        for name in ("a", "b"):
            of = [r for r in rows if r.source == name]
            assert abs(sum(r.size * r.copies for r in of) - of[0].target) <= 10


def test_urls(spark):
    urls = ["http://A.com/en/1", "x://example.com/en/7?q", "http://example.net/de/81", "http://b.net/de", None, "plain", "http://u.org/es/", "http://co.uk.org:80/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit(""))
    none = spark.createDataFrame([], "url string, bad boolean")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.filter_urls(pages, none, queries.URL_RULES).collect()}
    assert out == {
        0: ("a.com", "/en/1", "com/en/", "block"), 1: ("example.com", "/en/7", "example.com/en/7", "allow"), 2: ("example.net", "/de/81", "example.net/de/8", "block"), 3: ("b.net", "/de", None, "allow"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("u.org", "/es/", "org/es/", "block"), 7: ("co.uk.org:80", "/", None, "allow"),
    }
    bad = spark.createDataFrame([("http://spam.com/1", True)] * 200 + [("http://ok.com/1", False)] * 200, "url string, bad boolean")
    two = spark.createDataFrame([(1, "http://spam.com/9"), (2, "http://ok.com/9")], "page_id long, url string")
    assert host_reputation.filter_urls(two.where("false"), bad.where("false"), queries.URL_RULES).count() == 0
    clash = two.withColumns({c: F.lit("x") for c in ("host", "n", "bad", "prior", "mean", "rule", "siblings", "domain", "suffix")})
    assert host_reputation.filter_urls(clash.unionByName(clash), bad, []).count() == 4
    assert {r.page_id: r.verdict for r in host_reputation.filter_urls(two, bad, []).collect()} == {1: "block", 2: "allow"}


def test_threshold_is_of_costs(spark):
    assert host_reputation.THRESHOLD == host_reputation.threshold_of(host_reputation.BLOCKED_GOOD, host_reputation.ALLOWED_BAD) == 0.5
    assert host_reputation.threshold_of(1, 4) == pytest.approx(0.2)
    bad = spark.createDataFrame([(f"http://{h}/1", i < n) for h, n in (("a.com", 80), ("b.org", 4)) for i in range(200)], "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://a.com/9"), (2, "http://b.org/9")], "page_id long, url string")
    said = lambda t: {r.page_id: r.verdict for r in host_reputation.filter_urls(pages, bad, [], threshold=t).collect()}
    assert said(host_reputation.THRESHOLD) == {1: "allow", 2: "allow"} and said(host_reputation.threshold_of(1, 4)) == {1: "block", 2: "allow"}


def test_no_host_of_the_test_pages_is_blocked(spark):
    out = queries.op2_host_reputation(spark, SF).where("rule IS NULL")
    assert out.count() and {r.verdict for r in out.select("verdict").distinct().collect()} == {"allow"}


def test_public_suffixes(spark):
    names = ["a.com.mx", "b.com.mx", "x.org:80", "y.x.org", "", "co.uk", "a.b.co.uk:8080", "p.q.r.ck", "www.ck", "a.www.ck", "r.ck"]
    hosts = spark.createDataFrame([(h,) for h in names], "host string")
    rules = spark.createDataFrame([(r,) for r in ("com", "org", "mx", "com.mx", "uk", "co.uk", "*.ck", "!www.ck")], "rule string")
    cut = lambda *of: {r.host: (r.domain, r.suffix) for r in host_reputation.domain_and_suffix(hosts, *of).collect()}
    assert cut(rules) == {
        "a.com.mx": ("a.com.mx", "com.mx"), "b.com.mx": ("b.com.mx", "com.mx"), "x.org:80": ("x.org", "org"), "y.x.org": ("x.org", "org"), "": ("", ""), "co.uk": ("co.uk", "co.uk"),
        "a.b.co.uk:8080": ("b.co.uk", "co.uk"), "p.q.r.ck": ("q.r.ck", "r.ck"), "www.ck": ("www.ck", "ck"), "a.www.ck": ("www.ck", "ck"), "r.ck": ("r.ck", "r.ck"),
    }
    assert cut()["a.b.co.uk:8080"] == ("b.co.uk", "co.uk") and cut()["x.org:80"] == ("x.org", "org")
    # Strangers below a listed suffix: one's labels say less of the other than of its own subdomain.
    bad = spark.createDataFrame([(f"http://{h}/1", i < n) for h, n in (("a.com.mx", 150), ("d.com.mx", 50), ("ok.org", 20)) for i in range(200)], "url string, bad boolean")
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(["a.com.mx", "b.com.mx", "c.a.com.mx", "d.com.mx", "ok.org"])], "page_id long, url string")
    out = {r.page_id: r.bound for r in host_reputation.filter_urls(pages, bad, [], suffixes=rules).collect()}
    assert out[1] < out[2] < out[0]


def test_suffixes_from_a_published_list(spark, tmp_path):
    (tmp_path / "list").write_text("// a remark\n\ncom\nck\n*.ck\n!www.ck\nco.uk // more\n  github.io\n")
    rules = host_reputation.read_public_suffixes(spark, str(tmp_path / "list"))
    hosts = spark.createDataFrame([("a.b.github.io",), ("x.y.ck",), ("z.www.ck",)], "host string")
    assert {r.host: (r.domain, r.suffix) for r in host_reputation.domain_and_suffix(hosts, rules).collect()} == {"a.b.github.io": ("b.github.io", "github.io"), "x.y.ck": ("x.y.ck", "y.ck"), "z.www.ck": ("www.ck", "ck")}


def _posteriors(labels: dict[str, tuple[int, int]]) -> dict[str, float]:
    """host -> posterior mean, level by level, of hosts a.b.c with (pages, bad pages)."""
    rates: dict = {}
    for host, (n, bad) in labels.items():
        for level, key in enumerate((host, ".".join(host.split(".")[-2:]), host.split(".")[-1], "")):
            a, b = rates.setdefault(level, {}).get(key, (0, 0))
            rates[level][key] = (a + n, b + bad)
    means = {3: {"": rates[3][""][1] / max(1, rates[3][""][0])}}
    for level in (2, 1, 0):
        parent = (lambda k: "") if level == 2 else (lambda k: k.split(".")[-1]) if level == 1 else (lambda k: ".".join(k.split(".")[-2:]))
        s = noise = room = 0.0
        for key, (n, bad) in rates[level].items():
            m, c = means[level + 1][parent(key)], sum(x[0] > 0 and parent(k) == parent(key) for k, x in rates[level].items())
            if n and c > 1:
                s, noise, room = s + n * (bad / n - m) ** 2 * c / (c - 1), noise + m * (1 - m), room + m * (1 - m) * (n - 1)
        between = (s - noise) / room if room else 0.0
        k = min(1000.0, max(1.0, 1 / between - 1)) if between > 0 else 1000.0
        means[level] = {key: (means[level + 1][parent(key)] * k + bad) / (n + k) for key, (n, bad) in rates[level].items()}
    return means[0]


def test_posteriors_level_by_level(spark):
    g = np.random.default_rng(5)
    labels = {f"{h}.d{d}.t{t}": (int(n := g.integers(0, 60)), int(g.binomial(n, g.beta(2 + t, 4)))) for t in range(3) for d in range(4) for h in "xyz"}
    pages = spark.createDataFrame([(h,) for h in labels], "host string")
    seen = spark.createDataFrame([(h, i < bad) for h, (n, bad) in labels.items() for i in range(n)] + [("x.d0.t0", None)], "host string, bad boolean")
    got = {r.host: r["mean"] for r in host_reputation.host_posteriors(pages, seen).collect()}
    assert got == pytest.approx(_posteriors(labels))
    # Hosts differ within their domains here, which differ little: a host keeps its own rate.
    apart = {f"{h}.d{d}.t": (50, 45 if h == "x" else 5) for d in range(6) for h in "xy"}
    assert _posteriors(apart)["x.d0.t"] > 0.8


def test_licences(spark, docs):
    df = spark.createDataFrame([(1, "Hi.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0. bye"), (2, None), (3, "Permission is hereby granted!")], "doc_id long, text string")
    assert {r.doc_id: (r.licences, r.n_unmatched) for r in license_rules.scan_licences(df).collect()} == {1: ("MIT, CC-BY-NC-4.0", 0), 2: (None, 0), 3: (None, 0)}
    assert license_rules.scan_licences(docs.where("false")).count() == 0


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
APACHE_REST = """
Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_REST = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES.
"""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
GPL_REST = """
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL_COPY = """
You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
LGPL_REST = GPL_REST.replace("This program", "This library").replace("GNU General", "GNU Lesser General")
ISC_REST = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES.
"""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
ZERO_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.
"""
GPL_TWO = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.
"""
GPL_TWO_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.
"""
LGPL_TWO = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
LGPL_THREE = """This library is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
EPL_TEXT = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
BOOST_TEXT = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
OWNED = "(c) me\nAll rights reserved.\n\n"
#: Published texts and notices, wrapped as they are, and the licences they must give; nothing of the rule table.
WRAPPED = [
    (OWNED + BSD_TEXT + BSD_THIRD + BSD_REST, "BSD-3-Clause"), (BSD_TEXT + BSD_THIRD + BSD_REST, "BSD-3-Clause"), (BSD_TEXT + BSD_THIRD, "BSD-3-Clause"), (OWNED + BSD_TEXT + BSD_REST, "BSD-2-Clause"), (BSD_TEXT + BSD_REST, "BSD-2-Clause"),
    (OWNED + BSD_TEXT, "BSD-2-Clause"), (BSD_TEXT, "BSD-2-Clause"), (APACHE_TEXT + APACHE_REST, "Apache-2.0"), (APACHE_TEXT, "Apache-2.0"), ("MIT License\n\nCopyright (c) me\n\n" + MIT_TEXT, "MIT"), (MIT_TEXT, "MIT"),
    (GPL_TEXT + GPL_REST + GPL_COPY, "GPL-3.0-or-later"), (GPL_TEXT + GPL_REST, "GPL-3.0-or-later"), (GPL_TEXT, "GPL-3.0-or-later"), (GPL_TWO + GPL_REST + GPL_COPY, "GPL-2.0-or-later"), (GPL_TWO, "GPL-2.0-or-later"),
    (GPL_TWO_ONLY + GPL_REST, "GPL-2.0-only"), (GPL_TWO_ONLY, "GPL-2.0-only"), (LGPL_TWO + LGPL_REST, "LGPL-2.1-or-later"), (LGPL_THREE + LGPL_REST, "LGPL-3.0-or-later"), (LGPL_THREE, "LGPL-3.0-or-later"),
    (GPL_TEXT.replace("GNU General", "GNU Affero General") + GPL_REST.replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later"), (MPL_TEXT, "MPL-2.0"), (EPL_TEXT, "EPL-2.0"), (ISC_TEXT + ISC_REST, "ISC"), (ZERO_TEXT + ISC_REST, "0BSD"),
    (BOOST_TEXT, "BSL-1.0"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), (UNLICENSE_TEXT, "Unlicense"), (ZLIB_TEXT, "Zlib"), ("Licensed under the Apache License,\nVersion 2.0.", "Apache-2.0"),
    ("Released under the\nMIT License.", "MIT"), ("This work is licensed under the GNU General\nPublic License, version 3.", "GPL-3.0-only"), ("Licensed under\nCC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under\nCC BY 4.0.", "CC-BY-4.0"),
    ("Licensed under CC\nBY-SA 4.0.", "CC-BY-SA-4.0"), ("Dedicated to the public domain\nunder CC0 1.0.", "CC0-1.0"),
    ("This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"), ("SPDX-License-Identifier: LGPL-2.1-only\n\nimport x", "LGPL-2.1-only"), ("# SPDX-License-Identifier: MIT", "MIT"),
]


def test_licences_wrapped(spark):
    starred = [("/*\n" + "".join(f" * {line}\n" for line in t.splitlines()) + " */", n) for t, n in WRAPPED]
    slashed = [("".join(f"// {line}\n" for line in t.splitlines()), n) for t, n in WRAPPED]
    below = [("a line without an end\n" + t, n) for t, n in WRAPPED]
    unwrapped = [("\n\n".join(" ".join(p.split()) for p in t.split("\n\n")), n) for t, n in WRAPPED if not t.startswith(OWNED)]
    rows = [(i, t, n) for i, (t, n) in enumerate(WRAPPED + starred + slashed + below + unwrapped)]
    got = {r.doc_id: (r.licences, r.n_unmatched) for r in license_rules.scan_licences(spark.createDataFrame(rows, "doc_id long, text string, n string")).collect()}
    for i, t, n in rows:
        assert got[i] == (n, 0), t
    assert {n for _, n in WRAPPED} >= {n for n, _ in license_rules.RULES}
    assert all(" " + s + " " not in " " + " ".join("".join(c if c.isalnum() else " " for c in BASE.lower()).split()) + " " for _, s in license_rules.ALL_SENTENCES)


def test_licences_of_odd_tables(spark):
    """Very long texts, repeated rows, clashing names, and near misses that name nothing."""
    long = "no licence here, a b c. " * 40_000 + "Released under the MIT License."
    rows = [(1, long), (1, long), (None, "MIT"), (2, "Permission is hereby granted to look."), (3, "All rights reserved. All rights reserved.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("f", "rest", "m", "found", "identifiers", "n")})
    got = sorted((r.doc_id or 0, r.licences or "", r.n_unmatched) for r in license_rules.scan_licences(df).collect())
    assert got == [(0, "", 0), (1, "MIT", 0), (1, "MIT", 0), (2, "", 0), (3, "", 2)]


def test_warc_round_trip(spark):
    page = '<html><head><!-- <title>wrong</title> --><title>A &amp; b</title><script>x("</p>")</script></head><body><p>One<br>two <a href="/x?a=1&amp;b=2">l</a><!-- c --></body>'
    pages = spark.createDataFrame([(1, "http://a/", page, "x"), (2, None, None, "x"), (1, "http://a/", page, "x")], "page_id long, url string, html string, record_id string")
    rows = warc_derive.derive(warc_derive.responses(pages))
    got = {(r.page_id, r.record_type): r for r in rows.collect()}
    assert rows.count() == 6 and got[1, "conversion"].block == "One\ntwo l" and "outlink: /x?a=1&b=2" in got[1, "metadata"].block and "title: A & b\r\n" in got[1, "metadata"].block
    assert got[1, "conversion"].source_payload_digest == warc_derive.digest(page.encode()) and got[2, "conversion"].block == ""
    for i in (1, 2):
        assert got[i, "conversion"].linked_id == got[i, "metadata"].record_id and got[i, "metadata"].linked_id == got[i, "conversion"].record_id
    for r in warc_derive.serialise(rows).collect():
        head, block = warc_derive.parse_record(r.record)
        assert warc_derive.digest(block) == head["WARC-Block-Digest"] and head["WARC-Refers-To"].startswith("<urn:uuid:")
    empty = warc_derive.derive(warc_derive.responses(pages.where("false")))
    assert empty.count() == 0 and warc_derive.serialise(empty).count() == 0
    bare = spark.createDataFrame([(1, "<urn:uuid:1>", None, None, None, "<p>x", None, None)], warc_derive.RESPONSE)
    assert all("None" not in r.block for r in warc_derive.derive(bare).collect())


def test_page_of_broken_markup():
    read = warc_derive.read_page
    assert read("a < b <p title='>'>c</p>&#65;&#0000066;&#99999999999999;") == ("a < b\nc\nAB\ufffd", "", [])
    assert read("one <b title=\"never closed>two</b> three <i x='>'>four") == ("one two three '>four", "", [])
    assert read("x<script>y") == ("x", "", []) and read("x<!-- y") == ("x", "", []) and read("x <a href=/q") == ("x", "", ["/q"])
    assert read("<title>T<b>u</title>v") == ("v", "T<b>u", []) and read("") == ("", "", [])


@pytest.mark.parametrize("piece", ["<a ", "<a href=", "<a href='x\"> ", "<title>", "<!--", "</", "<script>", "<p '\">x", "&#9", "<", "</title ", " href", "<a \">\" '", "\n ", "<style></styl "])
def test_long_hostile_page(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    warc_derive.read_page(page)
    assert time.process_time() - began < 5


def test_warc_against_a_parser(spark):
    """Words, title and links of the test pages by the standard library's parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.words, self.links, self.hidden, self.title, self.in_title = [], {}, 0, None, False

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "noscript", "template")
            self.in_title |= tag == "title"
            if tag == "a" and (dict(attrs).get("href") or "").strip():
                self.links[dict(attrs)["href"].strip()] = None

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "noscript", "template")
            self.in_title &= tag != "title"

        def handle_data(self, data):
            if self.in_title:
                self.title = (self.title or "") + data
            elif not self.hidden:
                self.words.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in pages:
        want = Plain()
        want.feed(r.html or "")
        want.close()
        text, title, links = warc_derive.read_page(r.html or "")
        assert "".join(text.split()) == "".join("".join(want.words).split()), r.page_id
        assert title.split() == (want.title or "").split() and links == list(want.links), r.page_id


def test_sql_agrees(spark):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df, want = queries.queries()[name](spark, SF), c.sql(sql)
        rows = lambda cols, data: sorted((tuple(r[cols.index(x)] for x in sorted(cols)) for r in data), key=repr)
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall()), name


def _check_pieces(pieces, docs):
    """Every id of every row of (doc_id, text) lies in one piece, and pieces fill their sequences without gaps."""
    enc = packing.encoder()
    want: Counter = Counter()
    for d, t in docs:
        want[d] += len(enc.ids(t or "")) + 1
    got: Counter = Counter()
    ids = {}
    for d, t in docs:
        ids.setdefault(d, np.append(enc.ids(t or ""), 1).astype("<u4"))
    alike = {d for d in ids if sum(t is not None for x, t in docs if x == d) and len({t for x, t in docs if x == d}) == 1}
    by: dict = {}
    for p in pieces:
        got[p.doc_id] += p.length
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
        if p.doc_id in alike:
            assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
    assert got == want
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_pipeline(spark, monkeypatch):
    """Every stage against a plain version on what the stage before it kept, and run() as their chain."""
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        monkeypatch.setattr(corpus_pipeline, name, stage)
    stages = [(n, (lambda n, f: lambda s, d, sf: kept.setdefault(n, (d, f(s, d, sf)))[1])(n, f)) for n, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    pieces = corpus_pipeline.run(spark, SF).collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = {r.doc_id: r.text for r in kept["quality"][0].collect()}
    good = {r.doc_id: r.text for r in kept["near_duplicates"][0].collect()}
    assert set(good) == brute.judged(docs, decision_list.learn_rules(kept["quality"][0], labels)) and len(good) < len(docs)
    one = {r.doc_id: r.text for r in kept["passages"][0].collect()}
    assert set(one) == {d for d, (_, c) in brute.components(good).items() if c == d}
    cut = {r.doc_id: r.text for r in kept["mixture"][0].collect()}
    left = brute.repeats(one)
    assert set(cut) == {d for d, (n, gone, _) in left.items() if n > gone}
    assert all(hashlib.sha256(b" ".join(t.encode().split())).hexdigest() == left[d][2] for d, t in cut.items())
    mixed = [(r.doc_id, r.source, r.text) for r in kept["packed"][0].collect()]
    counts = {r.doc_id: r.copies for r in mixing.mix_report(kept["mixture"][0]).collect()}
    assert Counter(d for d, _, _ in mixed) == Counter({d: n for d, n in counts.items() if n}) and all(cut[d] == t for d, _, t in mixed)
    _check_pieces(pieces, [(d, t) for d, _, t in mixed])
    for name in ("near_duplicates", "passages", "mixture", "packed"):
        assert kept[name][0].columns == kept["quality"][0].columns


CLASHES = ("runs", "_doc", "copies", "_d", "_s", "_z", "row", "s", "cls", "n", "component_id", "size", "key", "place", "doc", "p", "extra", "source_size", "a.b")


def test_pipeline_of_odd_tables(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, clashing names, an empty table."""
    long = " ".join(f"v{i * 7919 % 9973}" for i in range(60_000))
    words = [" ".join(f"w{i * k % 613}x" for i in range(1, 90)) for k in (5, 7, 11)]
    rows = [(1, words[0], "s"), (2, words[0], None), (3, words[1], "s"), (3, words[1], "s"), (None, words[2], "t"), (None, words[2], "t"), (None, None, None), (4, None, "s"), (5, "", "s"), (6, " \n ", "t"), (7, long, "t"), (8, words[1] + " " + words[2], "s")]
    d = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in CLASHES}).repartition(4)
    texts = lambda x: sorted(((r.doc_id or 0, (r.text or "")[:20]) for r in x.collect()))
    good = corpus_pipeline.quality(spark, d, SF)
    assert good.columns == d.columns and {i for i, _ in texts(good)} == {0, 1, 2, 3, 8} and len(texts(good)) == 7
    one = corpus_pipeline.near_duplicates(spark, d, SF)
    assert one.columns == d.columns and [i for i, _ in texts(one)] == [0, 0, 0, 1, 3, 3, 4, 5, 6, 7, 8]
    cut = corpus_pipeline.passages(spark, d, SF)
    assert cut.columns == d.columns and [i for i, _ in texts(cut)] == [0, 0, 0, 1, 3, 3, 4, 6, 7, 8]
    assert {r.doc_id: r.text for r in cut.where("doc_id = 8").collect()} == {8: words[2]} and cut.where("doc_id IS NULL").where(F.col("text") == words[2]).count() == 2
    mixed = corpus_pipeline.mixture(spark, d, SF)
    assert mixed.columns == d.columns and mixed.count() == sum(r.copies for r in mixing.mix_report(d).collect())
    _check_pieces(corpus_pipeline.packed(spark, d, SF).collect(), [(i, t) for i, t, _ in rows])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.where("false"), SF).count() == 0


def test_no_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from lathe.llm.common import shared_dir

    sc = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda k, v: v), getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=sc))
