"""Queries of this subpackage for the driver's entry point, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import brown_lm, decision_list, decontamination, divergence, host_reputation, imatch, jaccard_join, license_rules, mixing, packing, spelling_variants, substring_dedup, warc_derive
from lathe.llm.common import load

#: Rules of the URL query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_corpus(load(spark, sf_dir, "documents"))


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page's path ends in the number of the document it shows, whose label says bad (low quality or toxic) or not."""
    pages = load(spark, sf_dir, "pages")
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("number"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    numbered = pages.select("url", F.regexp_extract("url", r"^[^:]*://[^/?#]*/[a-z]+/([0-9]+)", 1).alias("number")).where("number <> ''")
    return host_reputation.filter_urls(pages, numbered.join(labels, "number").select("url", "bad"), URL_RULES)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_components(load(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan_licences(load(spark, sf_dir, "documents"))


def op6_warc_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derive.derive(warc_derive.responses(load(spark, sf_dir, "pages")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_digest(load(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digest(load(spark, sf_dir, "documents"))


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.quality_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(load(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_brown_lm, op2_host_reputation, op3_jaccard_join, op4_mixing, op5_license_rules, op6_warc_derive, op7_packing, op8_imatch, op9_substring_dedup, op10_decision_list, op11_spelling_variants, op12_divergence, op13_decontamination)
    return {f.__name__: f for f in own}


def _reputation_sql() -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r[1]))
    fits = [(v, r, *r.partition("/")[::2]) for v, r in rules]
    test = lambda h, p: f"(p.host = '{h}' OR ends_with(p.host, '.{h}')) AND starts_with(path, '/{p}')"
    rule = " ".join(f"WHEN {test(h, p)} THEN '{r}'" for v, r, h, p in fits)
    said = " ".join(f"WHEN {test(h, p)} THEN '{v}'" for v, r, h, p in fits)
    two = ", ".join(f"'{s}'" for s in host_reputation.PUBLIC_SUFFIXES)
    lower = "translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    z, t = host_reputation.Z, host_reputation.THRESHOLD

    def strength(table: str) -> str:
        s, noise = "sum(n * (bad / n - prior) * (bad / n - prior) * c / (c - 1))", "sum(prior * (1 - prior))"
        between = f"(({s} - {noise}) / nullif(sum(prior * (1 - prior) * (n - 1)), 0))"
        return f"(SELECT coalesce(CASE WHEN {between} > 0 THEN least({host_reputation.STRONGEST}, greatest({host_reputation.WEAKEST}, 1 / {between} - 1)) END, {host_reputation.STRONGEST}) FROM {table} WHERE n > 0 AND c > 1)"

    siblings = lambda by: f"count(*) FILTER (n > 0) OVER ({by})"
    return f"""
WITH cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, coalesce({lower}, '') AS host, coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0), '') AS path,
  regexp_extract(url, '^[^:]*://[^/?#]*/[a-z]+/([0-9]+)', 1) AS number FROM cut),
o AS (SELECT host, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM p JOIN labels ON number = CAST(doc_id AS VARCHAR) WHERE number <> '' GROUP BY host),
h0 AS (SELECT p.host, CAST(coalesce(any_value(n), 0) AS DOUBLE) AS n, CAST(coalesce(any_value(bad), 0) AS DOUBLE) AS bad, string_split(p.host, '.') AS l FROM p LEFT JOIN o ON p.host = o.host GROUP BY p.host),
h AS (SELECT host, n, bad, CASE WHEN regexp_matches(host, '{host_reputation.ADDRESS}') THEN host WHEN array_to_string(l[-2:], '.') IN ({two}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
  CASE WHEN regexp_matches(host, '{host_reputation.ADDRESS}') THEN 'address' WHEN array_to_string(l[-2:], '.') IN ({two}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM h0),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
total AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS m FROM s),
s1 AS (SELECT s.*, m AS prior, {siblings('')} AS c FROM s, total),
sp AS (SELECT suffix, (prior * k + bad) / (n + k) AS sm FROM s1, (SELECT {strength('s1')} AS k)),
d1 AS (SELECT d.*, sm AS prior, {siblings('PARTITION BY suffix')} AS c FROM d JOIN sp USING (suffix)),
dp AS (SELECT domain, suffix, (prior * k + bad) / (n + k) AS dm FROM d1, (SELECT {strength('d1')} AS k)),
h1 AS (SELECT h.*, dm AS prior, {siblings('PARTITION BY domain, suffix')} AS c FROM h JOIN dp USING (domain, suffix)),
hp AS (SELECT host, n, bad, k AS kh, (prior * k + bad) / (n + k) AS hm FROM h1, (SELECT {strength('h1')} AS k)),
b AS (SELECT host, n, bad, hm - {z} * sqrt(hm * (1 - hm) / (n + kh + 1)) AS bound FROM hp)
SELECT page_id, p.host, path, CASE {rule} END AS rule, CASE {said} WHEN bound > {t} THEN 'block' ELSE 'allow' END AS verdict,
  CAST(n AS BIGINT) AS host_n, CAST(bad AS BIGINT) AS host_bad, round(bound, 6) AS bound
FROM p JOIN b ON p.host = b.host"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_host_reputation": _reputation_sql(),
        "op5_license_rules": license_rules.scan_sql(),
        "op12_divergence": divergence.audit_sql(),
        "op13_decontamination": decontamination.contamination_sql(),
        "op9_substring_dedup": """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
place AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS h FROM place JOIN w USING (doc_id)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
one AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT one.doc_id, string_agg(word, ' ' ORDER BY one.i) AS t FROM one LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY one.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    }
