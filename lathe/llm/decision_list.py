"""Quality rules: base statistics, and a decision list learned by sequential covering.

Statistics of every text come from one Arrow-batched function; everything after it is a
Spark expression. The list is learned from labelled statistics, of at most SAMPLE rows
(those with the smallest hash of their id, so a rerun takes the same): rules that reject
are grown one after the other as conjunctions of thresholds, each condition the one of
most information gain on the growing part, then pruned from the end on the pruning part,
and kept while they are precise there; the rows a rule covers leave the sample. The
result is an ordered CASE expression that ends in "keep".

Defined results: a null or blank text has no words and fails the base rule; documents
without labels are judged like all others; without labels at all the list is empty and
keeps what the base rule keeps; conflicting or null labels: null ones are dropped, a
document labelled twice counts twice; extra columns stay or are ignored as stated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import packed, small_batches

#: Labelled rows that the list is learned from, at most.
SAMPLE = 20_000
MAX_RULES, MAX_CONDITIONS, CANDIDATES = 12, 4, 48
#: A rule must be right about at least this share of what it rejects.
PRECISION = 0.97

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long, n_digits long, n_distinct long, n_lines long, n_stops long"
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?")] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:")] = True


def _repeated_triples(words: list[bytes]) -> np.ndarray:
    """Where runs of three words that occur twice or more begin; the words themselves are compared, as numbers by first use."""
    numbers: dict[bytes, int] = {}
    n = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    _, pairs = np.unique(n[:-1] * len(numbers) + n[1:], return_inverse=True)
    _, where, count = np.unique(pairs[:-1] * len(numbers) + n[2:], return_inverse=True, return_counts=True)
    return np.flatnonzero(count[where] > 1)


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """The values of STATS for one text."""
    words = text.split() if text else []
    if not words:
        return (0, 0, 0, 0, 0, 0, 0, 0, 0, text.count(b"\n") + 1 if text else 0, 0)
    b = np.frombuffer(text, np.uint8)
    n = np.bincount(b, minlength=256)
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    repeated = 0
    if len(words) > 3:
        at = _repeated_triples(words)
        if len(at):
            covered = np.zeros(len(words), bool)
            for i in range(3):
                covered[at + i] = True
            repeated = int(covered.sum())
    code_points = len(b) - int(n[0x80:0xC0].sum())
    pick = lambda mask: int(n[mask].sum())
    return (len(words), code_points - pick(_SPACE), pick(_SYMBOLS), len(lines) - len(set(lines)), repeated, pick(_UPPER), pick(_MARKS), pick(_DIGIT), len(set(words)), text.count(b"\n") + 1, pick(_STOPS))


def _stats_batch(text: pd.Series) -> pd.DataFrame:
    names = [f.split()[0] for f in STATS.split(", ")]
    rows = [text_stats(None if t is None else t.encode()) for t in text]
    return pd.DataFrame(rows, columns=names, dtype="int64")


def stats_of(text: Column) -> Column:
    """The STATS of a text column, as one struct."""
    return F.pandas_udf(_stats_batch, STATS)(text)


#: What thresholds are put on, as SQL over the statistics; ratios are over words or characters.
FEATURES = {
    "n_words": "s.n_words",
    "chars_per_word": "s.word_chars / greatest(s.n_words, 1)",
    "symbols_per_word": "s.n_symbols / greatest(s.n_words, 1)",
    "dup_lines_per_line": "s.n_dup_lines / greatest(s.n_lines, 1)",
    "repeat_share": "s.n_repeat_words / greatest(s.n_words, 1)",
    "upper_share": "s.n_upper / greatest(s.word_chars, 1)",
    "marks_per_word": "s.n_marks / greatest(s.n_words, 1)",
    "digit_share": "s.n_digits / greatest(s.word_chars, 1)",
    "distinct_share": "s.n_distinct / greatest(s.n_words, 1)",
    "words_per_line": "s.n_words / greatest(s.n_lines, 1)",
    "stops_per_word": "s.n_stops / greatest(s.n_words, 1)",
}


@dataclass(frozen=True)
class Rule:
    """Reject where every (feature, '<=' or '>', threshold) holds."""

    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, t in self.conditions:
            out &= x[name] <= t if op == "<=" else x[name] > t
        return out

    def sql(self) -> str:
        return " AND ".join(f"{FEATURES[name]} {op} {t!r}D" for name, op, t in self.conditions)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    inside, chosen = np.ones(len(bad), bool), []
    while len(chosen) < MAX_CONDITIONS:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not p or not n:
            break
        best = (1e-9, None, None)
        for name, v in x.items():
            cuts = np.unique(np.quantile(v[inside], np.linspace(0, 1, CANDIDATES)))
            # midway between neighbours, so that a threshold isn't tied to one document
            cuts = np.unique(np.concatenate(((cuts[:-1] + cuts[1:]) / 2, np.quantile(v[inside & bad], (0.02, 0.1, 0.9, 0.98)))))
            for t in cuts:
                low = inside & (v <= t)
                for op, part in (("<=", low), (">", inside & ~low)):
                    q, m = (part & bad).sum(), (part & ~bad).sum()
                    if q:
                        gain = q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))
                        if gain > best[0]:
                            best = (gain, (name, op, float(t)), part)
        if best[1] is None:
            break
        chosen.append(best[1])
        inside = best[2]
    return Rule(tuple(chosen))


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    best = (rule, -2.0, 0.0, 0)
    for k in range(len(rule.conditions), 0, -1):
        part = Rule(rule.conditions[:k])
        covered = part.covers(x)
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[1]:
            best = (part, worth, p / max(1, p + n), p)
    return best[0], best[2], best[3]


def learn(rows: pd.DataFrame, precision: float = PRECISION, max_rules: int = MAX_RULES) -> list[Rule]:
    """Ordered rules from rows of FEATURES, ``bad`` (boolean) and ``turn`` (an integer that deals rows)."""
    rules: list[Rule] = []
    rows = rows.reset_index(drop=True)
    while len(rules) < max_rules and rows["bad"].sum() >= 5:
        grown = (rows["turn"] % 3 != 0).to_numpy()
        x = {k: rows[k].to_numpy(float) for k in FEATURES}
        bad = rows["bad"].to_numpy(bool)
        rule = _grow({k: v[grown] for k, v in x.items()}, bad[grown])
        if not rule.conditions:
            break
        rule, right, hits = _prune(rule, {k: v[~grown] for k, v in x.items()}, bad[~grown])
        covered = rule.covers(x)
        if right < precision or hits < 2 or bad[covered].mean() < precision:
            break
        rules.append(rule)
        rows = rows[~covered].reset_index(drop=True)
    return rules


def labelled_features(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """FEATURES, bad and turn of at most ``sample`` labelled documents."""
    turn = F.xxhash64("doc_id")
    few = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("_doc"), (F.col("quality") == 0).alias("bad"), turn.alias("turn"))
    few = few.orderBy("turn", "bad").limit(sample)
    some = docs.join(F.broadcast(few), F.col("doc_id") == F.col("_doc")).select(stats_of(F.col("text").cast("string")).alias("s"), "bad", "turn")
    return some.select(*(F.expr(sql).cast("double").alias(k) for k, sql in FEATURES.items()), "bad", F.abs(F.col("turn") % 1000).alias("turn"))


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    small_batches(docs.sparkSession)
    rows = labelled_features(docs, labels, sample).toPandas().sort_values(["turn", *FEATURES], kind="stable")
    return learn(rows) if len(rows) else []


def base_failed() -> Column:
    return F.expr("s.n_words < 50 OR 100 * s.n_repeat_words > 50 * s.n_words")


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression over the column ``s``."""
    out = None
    for rule in rules:
        out = F.when(F.expr(rule.sql()), F.lit(False)) if out is None else out.when(F.expr(rule.sql()), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows with ``s`` (STATS), base_failed, rule (which one rejects) and kept."""
    which = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        which = F.when(F.expr(rule.sql()), F.lit(i)).otherwise(which)
    with_stats = docs.withColumn("s", stats_of(F.col("text").cast("string")))
    return with_stats.withColumn("base_failed", base_failed()).withColumn("rule", which).withColumn("kept", ~base_failed() & verdict(rules))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = learn_rules(docs, labels)
    out = judge(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", "base_failed", "rule", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    rules = learn_rules(docs.select("doc_id", "text"), labels)
    s = stats_of(F.col("text").cast("string"))
    return docs.select(packed(docs).alias("row"), s.alias("s")).where(~base_failed() & verdict(rules)).select("row.*")
