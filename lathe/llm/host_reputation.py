"""URL filter by Empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host, registered domain and public
suffix. Each level has a beta prior: its mean is the posterior mean of the level above
(for suffixes the mean over all), its strength comes by the method of moments from how far
the level's own rates lie from those means, over groups with a sibling. A host's posterior is a beta distribution; a page is
blocked where even its lower bound (mean less ``z`` standard deviations) passes the
threshold, so that a few bad pages on a small host don't block it. Listed rules come
first.

Counts are combined before they are shuffled, so a host with a third of all pages is one
row of each task. The verdict is joined to the pages by host; Spark splits that join's
skewed partitions. The driver sees a few sums.

Defined results: a null url or one without ``://`` has an empty host and path, which no
rule fits and which has the prior of all pages; a host without labels has its domain's
posterior; without any label nothing is blocked but by rule; a null outcome isn't
counted; repeated pages count each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.common import durable, lower_ascii

#: registries' second-level names of some countries, as in the public suffix list. Any other host's suffix is its last label.
SECOND_LEVELS = {
    "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "nz": "ac co geek gen govt iwi maori mil net org school", "jp": "ac ad co ed go gr lg ne or",
    "br": "art blog com edu eco gov jus leg mil net org", "mx": "com edu gob net org", "ar": "com edu gob gov int mil net org tur", "co": "com edu gov mil net nom org", "pe": "com edu gob mil net nom org",
    "in": "ac co edu firm gen gov ind mil net org res", "cn": "ac com edu gov mil net org", "hk": "com edu gov idv net org", "tw": "club com edu gov idv net org", "kr": "ac co go ne or pe re", "sg": "com edu gov net org",
    "my": "com edu gov mil name net org", "th": "ac co go in mi net or", "id": "ac biz co desa go mil my net or sch web", "za": "ac co edu gov law net org school web", "ke": "ac co go me ne or sc", "ng": "com edu gov net org sch",
    "tr": "av bel biz com edu gov info name net org", "il": "ac co gov k12 muni net org", "ua": "com edu gov in net org", "pl": "com edu gov net org", "es": "com edu gob nom org", "gr": "com edu gov net org",
}
PUBLIC_SUFFIXES = tuple(f"{name}.{country}" for country, names in SECOND_LEVELS.items() for name in names.split())
#: What it costs to block a good page, and to allow a bad one. Stated, as nothing in the data says it: alike.
BLOCKED_GOOD, ALLOWED_BAD = 1.0, 1.0


def threshold_of(blocked_good: float, allowed_bad: float) -> float:
    """The bad rate beyond which to block costs less than to allow: (1 - p) * blocked_good < p * allowed_bad."""
    return blocked_good / (blocked_good + allowed_bad)


#: Lower bound of the bad rate beyond which a host is blocked, and its distance in deviations.
THRESHOLD, Z = threshold_of(BLOCKED_GOOD, ALLOWED_BAD), 1.645
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
#: More rules than this are joined to the pages instead of written into the expression.
INLINE_RULES = 200


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


#: Hosts that are IP addresses, of either kind.
ADDRESS = r"^(?:[0-9]{1,3}(?:[.][0-9]{1,3}){3}|\[.*\])$"


def read_public_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """(rule) of a public suffix list in its published form: a rule a line, ``//`` before remarks."""
    rule = F.regexp_extract("value", r"^\s*(\S+)", 1)
    return spark.read.text(path).where(~F.col("value").rlike(r"^\s*(//|$)")).select(rule.alias("rule"))


def domain_and_suffix(hosts: DataFrame, suffixes: DataFrame | tuple[str, ...] = PUBLIC_SUFFIXES) -> DataFrame:
    """Adds ``domain`` and ``suffix`` to distinct hosts, by the rules of public suffix lists.

    ``suffixes`` are such rules, or a table with one in each row of its first column: plain
    (``co.uk``), with any label in front (``*.ck``), or an exception (``!www.ck``, whose suffix
    is ``ck``). An exception prevails, else the longest rule; a port isn't part of the name. An
    IP address is its own domain, and the suffix of all of them is ``address``: its numbers are no labels.
    """
    rules = suffixes if isinstance(suffixes, DataFrame) else hosts.sparkSession.createDataFrame([(s,) for s in suffixes], "rule string")
    rules = rules.select(F.lower(F.trim(F.col(rules.columns[0]))).alias("rule")).distinct()
    name = F.regexp_replace("host", ":[0-9]*$", "")
    labels = F.split(name, r"\.")
    end = lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
    # (labels of the suffix, exception or not, rule) of each rule that could fit
    tries = lambda n: F.array(
        F.struct(F.lit(False).alias("exception"), n.alias("k"), end(n).alias("rule")),
        F.struct(F.lit(False).alias("exception"), n.alias("k"), F.concat(F.lit("*."), end(n - 1)).alias("rule")),
        F.struct(F.lit(True).alias("exception"), (n - 1).alias("k"), F.concat(F.lit("!"), end(n)).alias("rule")),
    )
    tried = hosts.select("host", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size(labels)), tries))).alias("t")).select("host", "t.*")
    best = tried.join(rules, "rule").groupBy("host").agg(F.max(F.struct("exception", "k")).alias("best"))
    found = hosts.join(best, "host", "left").withColumn("_name", name).withColumn("_k", F.coalesce("best.k", F.lit(1)))
    address = F.col("_name").rlike(ADDRESS)
    domain, suffix = F.expr("substring_index(_name, '.', -(_k + 1))"), F.expr("substring_index(_name, '.', -_k)")
    found = found.withColumn("domain", F.when(address, F.col("_name")).otherwise(domain)).withColumn("suffix", F.when(address, "address").otherwise(suffix))
    return found.drop("best", "_name", "_k")


def matched_rule(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest rule that fits, else nulls.

    A rule is (verdict, host + path). Few rules become one conditional expression; many
    are joined by (a suffix of the host, a leading part of the path that ends in a slash).
    """
    split = [(v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules]
    split.sort(key=lambda x: (-len(x[1]), -len(x[2]), x[1], x[0]))
    if len(split) <= INLINE_RULES:
        name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for v, r, host, path in reversed(split):
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            name, verdict = F.when(fits, F.lit(r)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
        return pages.withColumn("rule", name).withColumn("rule_verdict", verdict)
    rows = [(v, r, host, path, path[: path.rindex("/") + 1], i) for i, (v, r, host, path) in enumerate(split)]
    table = pages.sparkSession.createDataFrame(rows, "v string, r string, rule_host string, rule_path string, folder string, place int")
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    # Each distinct (host, path) meets the rules once, however many pages share it.
    keys = pages.select("host", "path").distinct()
    tries = keys.select("host", "path", F.explode(hosts).alias("rule_host"), folders.alias("folders")).select("host", "path", "rule_host", F.explode("folders").alias("folder"))
    best = tries.join(table, ["rule_host", "folder"]).where(F.col("path").startswith(F.col("rule_path"))).groupBy("host", "path").agg(F.min(F.struct("place", "r", "v")).alias("best"))
    return pages.join(best, ["host", "path"], "left").withColumn("rule", F.col("best.r")).withColumn("rule_verdict", F.col("best.v")).drop("best")


def _with_siblings(groups: DataFrame, parents: DataFrame, by: list[str], prior: str) -> DataFrame:
    """Adds the parent's posterior mean as ``prior``, and how many labelled groups the parent has."""
    counted = groups.groupBy(*by).agg(F.count_if(F.col("n") > 0).alias("siblings"))
    return groups.join(parents.select(*by, F.col(prior).alias("prior")).join(counted, by), by)


def _strength(groups: DataFrame) -> float:
    """Prior strength k of groups (n, bad, prior, siblings), so that the spread of a rate p is prior (1 - prior) / n (1 + (n - 1) / (k + 1)).

    Groups with one parent are drawn towards its mean, which they make up themselves, hence
    the factor; a group without a sibling says nothing of the spread among siblings.
    """
    off, noise = F.col("bad") / F.col("n") - F.col("prior"), F.col("prior") * (1 - F.col("prior"))
    r = groups.where("n > 0 AND siblings > 1").agg(F.sum(F.col("n") * off * off * F.col("siblings") / (F.col("siblings") - 1)).alias("s"), F.sum(noise).alias("noise"), F.sum(noise * (F.col("n") - 1)).alias("room")).first()
    between = (r.s - r.noise) / r.room if r.room else 0.0
    return min(STRONGEST, max(WEAKEST, 1 / between - 1)) if between > 0 else STRONGEST


def host_posteriors(pages: DataFrame, outcomes: DataFrame, suffixes: DataFrame | tuple[str, ...] = PUBLIC_SUFFIXES, z: float = Z) -> DataFrame:
    """host, host_n, host_bad, mean, bound of every host; outcomes are (host, bad boolean)."""
    counted = outcomes.where("bad IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = pages.select("host").distinct().join(counted, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    hosts = durable(domain_and_suffix(hosts, suffixes), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = durable(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    tops = durable(domains.groupBy("suffix").agg(*sums).withColumn("root", F.lit(0)), "suffixes")
    root = tops.groupBy("root").agg(*sums).select("root", F.coalesce(F.try_divide("bad", "n"), F.lit(0.0)).alias("mean"))

    def posterior(groups: DataFrame, mean: str) -> tuple[DataFrame, float]:
        k = _strength(groups)
        return groups.withColumn(mean, (F.col("prior") * k + F.col("bad")) / (F.col("n") + k)).drop("prior", "siblings"), k

    tops, _ = posterior(_with_siblings(tops, root, ["root"], "mean"), "top_mean")
    domains, _ = posterior(_with_siblings(domains, tops, ["suffix"], "top_mean"), "domain_mean")
    out, k = posterior(_with_siblings(hosts, domains, ["domain", "suffix"], "domain_mean"), "mean")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(k) + 1))
    return out.select("host", F.col("n").alias("host_n"), F.col("bad").alias("host_bad"), "mean", (F.col("mean") - z * deviation).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD, z: float = Z, suffixes: DataFrame | tuple[str, ...] = PUBLIC_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, host_n, host_bad, bound of every page.

    ``pages`` has page_id and url; ``outcomes`` url and bad.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    judged = matched_rule(pages.select("page_id", host.alias("host"), path.alias("path")), rules)
    seen = outcomes.select(host.alias("host"), F.col("bad").cast("boolean").alias("bad"))
    posts = host_posteriors(judged, seen, suffixes, z)
    own = F.when(F.col("bound") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(posts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "host_n", "host_bad", F.round("bound", 6).alias("bound"))
