"""Words that a polynomial hash modulo a power of two confuses, for any base: they must stay apart everywhere."""

import numpy as np

from lathe.llm import decision_list, jaccard_join, substring_dedup
from lathe.llm.common import WordHashes, gram_hashes
from tests.llm import brute

MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))


def _docs(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")


def test_grams_differ():
    around = [f"w{i}" for i in range(12)]
    one, two = ([*around[:6], x, *around[6:]] for x in (MORSE, OTHER))
    for k in (1, 3, 5, 13):
        a, b = ([h for h in gram_hashes([w.encode() for w in ws], k)] for ws in (one, two))
        assert sum(x == y for x, y in zip(a, b, strict=True)) == max(0, 7 - k) + max(0, 7 - k)
    first, last = np.array([0, 3]), np.array([5, 9])
    a, b = (WordHashes([w.encode() for w in ws]).spans(first, last) for ws in (one, two))
    assert a[0] == b[0] and a[1] != b[1]
    assert WordHashes([b"x", b"y", b"x", b"y"]).grams(2)[0] == WordHashes([b"q", b"x", b"y"]).grams(2)[1]


def test_unequal_words_are_not_removed(spark):
    around = [f"w{i}" for i in range(19)]
    texts = {1: " ".join([*around, MORSE]), 2: " ".join([*around, OTHER]), 3: " ".join([*around, MORSE])}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removal_digest(_docs(spark, texts)).collect()}
    assert got == brute.repeats(texts)
    assert got[2][1] == 0 and got[3][1] == 20


def test_unequal_shingles_link_nothing(spark):
    around = [f"w{i}" for i in range(24)]
    texts = {1: " ".join([*around[:12], MORSE, *around[12:]]), 2: " ".join([*around[:12], OTHER, *around[12:]])}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_components(_docs(spark, texts)).collect()}
    assert got == brute.components(texts) == {1: (21, 1), 2: (21, 2)}


def test_unequal_words_repeat_nothing():
    repeat = lambda text: decision_list.text_stats(text.encode())[4]
    assert repeat(f"p {MORSE} q r p {OTHER} q z") == 0
    assert repeat(f"p {MORSE} q r p {MORSE} q z") == 6
    assert repeat("a a a a") == 4 and repeat("a b c") == 0 and repeat("a b c a b c") == 6
