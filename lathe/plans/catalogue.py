"""The library's queries over the test tables, and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lathe.functions import nested as N
from lathe.functions import text as T
from lathe.operators import bom, dedup, metrics, order, paths, reconcile
from lathe.plans import feeds, formats, records, reports, servers, streams, trees  # noqa: F401  they register their queries
from lathe.plans.registry import TABLES, oracle_sql, queries, query  # noqa: F401
from lathe.shared import durable, shared_folder
from lathe.streaming import tail
from lathe.tables import load, timed_events

@query("""WITH e AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, value, row_number() OVER (PARTITION BY event_type, strftime(ts, '%Y-%m-%d') ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT event_type, day, round(max(CASE WHEN n = 1 THEN value END), 6) AS last, round(avg(value), 6) AS mean, round(max(value), 6) AS max, count(*) AS n FROM e GROUP BY ALL""")
def series_last_mean_max(spark, d):
    e = timed_events(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = metrics.series_reduce(e, ["event_type", "day"], "ts", "event_id", "value")
    return out.select("event_type", "day", *(F.round(c, 6).alias(c) for c in ("last", "mean", "max")), "n")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def row_count_ledger(spark, d):
    out = None
    for t in TABLES:
        one = load(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.union(one)
    return out


@query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def keep_first_exact(spark, d):
    return dedup.keep_first(load(spark, d, "documents"), ["text"], ["doc_id"]).select("doc_id", "lang", "source")


@query("""WITH f AS (SELECT user_id, event_type, CASE WHEN round(value) = 7 THEN '' ELSE CAST(round(value) AS VARCHAR) END AS v, min(event_id) AS id, count(*) AS c FROM events GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY id) AS n FROM f)
SELECT CAST(sum(c) AS BIGINT) AS n_in, count(*) AS n_kept, CAST(sum(c) - count(*) AS BIGINT) AS n_exact, count(*) FILTER (n > 1) AS n_conflicts, count(*) FILTER (v = '') AS n_blank FROM s""")
def dedup_counters(spark, d):
    """Values of 7 are blank; others come with white space of all kinds around them."""
    around = F.element_at(F.array(*map(F.lit, ("", " ", "\t", "\n", "\u00a0"))), (F.col("event_id") % 5 + 1).cast("int"))
    value = F.when(F.round("value") == 7, around).otherwise(F.concat(around, F.round("value").cast("string"), around))
    return dedup.dedup_counters(load(spark, d, "events").withColumn("v", value), ["user_id", "event_type"], "v")


_CASED = "CASE WHEN doc_id % 2 = 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE text END"


@query(f"SELECT md5(lower({_CASED})) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def case_variant_groups(spark, d):
    return dedup.duplicate_groups(load(spark, d, "documents"), F.md5(F.lower(F.expr(_CASED))))


@query("SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = lower(text) AS same FROM documents")
def ascii_vs_unicode_lower(spark, d):
    return load(spark, d, "documents").select("doc_id", (T.ascii_lower(F.col("text")) == F.lower("text")).alias("same"))


@query("SELECT lang, source, count(DISTINCT sha256(text)) = 1 AS identical, count(*) AS n FROM documents GROUP BY ALL")
def all_identical_hash(spark, d):
    return load(spark, d, "documents").groupBy("lang", "source").agg((F.count_distinct(F.sha2("text", 256)) == 1).alias("identical"), F.count("*").alias("n"))


@query("""SELECT p_partkey, p_brand, CASE WHEN max(p_retailprice) OVER w - min(p_retailprice) OVER w > 97 THEN 'ambiguous'
WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) = 1 THEN 'keep' ELSE 'quarantine' END AS decision FROM part WINDOW w AS (PARTITION BY p_brand)""")
def survivor_argmax(spark, d):
    best = [("p_size", True), ("p_retailprice", True), ("p_partkey", False)]
    return dedup.survivor(load(spark, d, "part"), ["p_brand"], best, "p_retailprice", 97).select("p_partkey", "p_brand", "decision")


@query("""WITH h AS (SELECT DISTINCT CASE WHEN page_id % 3 = 1 THEN '' ELSE regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\\.', '') END AS site, page_id % 4 AS u FROM pages WHERE page_id % 2 = 0),
n AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\\.', '') AS site, page_id % 5 AS u, page_id % 2 AS p FROM pages)
SELECT page_id, EXISTS (SELECT 1 FROM h WHERE h.site = n.site AND h.u = n.u) OR row_number() OVER (PARTITION BY site, u, p, EXISTS (SELECT 1 FROM h WHERE h.site = n.site AND h.u = n.u) ORDER BY page_id) > 1 AS skipped FROM n""")
def merge_logins(spark, d):
    """An export merged into a vault whose items have several addresses: what is there, or came before, is skipped."""
    p = load(spark, d, "pages")
    vault = p.where("page_id % 2 = 0").select(F.when(F.col("page_id") % 3 == 1, F.array(F.lit(""))).otherwise(F.array("url", F.concat("url", F.lit("?again")))).alias("uris"), F.concat(F.lit(" U"), F.col("page_id") % 4).alias("username"))
    new = p.select(F.col("page_id").alias("seq"), "url", F.concat(F.lit("u"), F.col("page_id") % 5, F.lit("\t")).alias("username"), F.concat(F.lit("p"), F.col("page_id") % 2, F.lit("\n")).alias("password"))
    return dedup.merge_logins(vault, new).select(F.col("seq").alias("page_id"), "skipped")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_merge(spark, d):
    present = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return dedup.anti_merge(load(spark, d, "orders"), present, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\\.', '') AS site FROM pages")
def host_normalise(spark, d):
    return load(spark, d, "pages").select("page_id", T.site(F.col("url")).alias("site"))


_TRACK = "lower(lang) || '/' || CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || CASE doc_id % 3 WHEN 0 THEN '.mp3' WHEN 1 THEN '.ogg' ELSE '.flac' END"


@query(f"WITH t AS (SELECT DISTINCT {_TRACK} AS path FROM documents) SELECT path FROM t WHERE path LIKE '%.mp3' AND regexp_replace(path, '[.][^./]{{3}}$', '') IN (SELECT regexp_replace(path, '[.](flac|ogg)$', '') FROM t WHERE path LIKE '%.flac' OR path LIKE '%.ogg')")
def semi_sibling(spark, d):
    """Files of one format whose stem has a sibling of a better one."""
    t = load(spark, d, "documents").select(F.expr(_TRACK).alias("path")).distinct()
    better = t.where(F.col("path").rlike(r"\.(flac|ogg)$")).select(F.regexp_replace("path", r"\.(flac|ogg)$", "").alias("stem")).distinct()
    mp3 = t.where(F.col("path").endswith(".mp3")).withColumn("stem", paths.joined(paths.dirname(F.col("path")), paths.stem(F.col("path"))))
    return mp3.join(better, "stem", "left_semi").select("path")


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN (SELECT lower(upper(p_type)) FROM part UNION SELECT lower(o_orderpriority) FROM orders UNION SELECT 'building')")
def open_windows(spark, d):
    """Rows whose name is one of the open names, in any case."""
    names = load(spark, d, "part").select(F.upper("p_type").alias("name")).union(load(spark, d, "orders").select("o_orderpriority")).union(spark.createDataFrame([("Building",)], "name string"))
    return load(spark, d, "customer").withColumn("key", F.lower("c_mktsegment")).join(names.select(F.lower("name").alias("key")).distinct(), "key", "left_semi").select("c_custkey")


@query("""WITH b AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), a AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1)
SELECT l_orderkey, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, CASE WHEN a.n IS NULL THEN 'LOST' WHEN b.n IS NULL THEN 'new' WHEN a.n < b.n THEN 'SHRANK' WHEN a.n > b.n THEN 'grew' ELSE 'same' END AS verdict FROM b FULL JOIN a USING (l_orderkey)""")
def two_sided_verdict(spark, d):
    line = load(spark, d, "lineitem")
    count = lambda cond: line.where(cond).groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return reconcile.count_verdicts(count("l_linenumber <= 3"), count("l_linenumber >= 2"), "l_orderkey").na.fill(0, ["n_before", "n_after"])


@query("""WITH a AS (SELECT o_custkey, o_orderstatus FROM orders), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice < 150000)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def multiset_diff(spark, d):
    o = load(spark, d, "orders")
    return reconcile.multiset_diff(o.select("o_custkey", "o_orderstatus"), o.where("o_totalprice < 150000").select("o_custkey", "o_orderstatus"))


@query("""WITH b AS (SELECT o_totalprice AS s, coalesce(t, 0) AS t FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)
SELECT count(*) FILTER (s > t) AS n_larger, count(*) FILTER (s < t) AS n_smaller, count(*) FILTER (s = t) AS n_equal, round(sum(CASE WHEN s > t THEN s - t END), 2) AS surplus FROM b""")
def size_compare_tally(spark, d):
    lines = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("size"))
    return reconcile.size_tally(load(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("size")), lines, "o_orderkey")


@query("""WITH seen AS (SELECT DISTINCT o_custkey FROM orders) SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'open' ELSE 'blocked' END AS expect, CASE WHEN o_custkey IS NOT NULL THEN 'open' ELSE 'blocked' END AS observed,
CASE WHEN (c_nationkey % 2 = 0) = (o_custkey IS NOT NULL) THEN 'OK' ELSE 'MISMATCH' END AS verdict FROM customer LEFT JOIN seen ON c_custkey = o_custkey""")
def expectation_check(spark, d):
    """Customers of even nations are expected to have orders, those of odd ones not."""
    say = lambda c: F.when(c, "open").otherwise("blocked")
    seen = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("seen", F.lit(True))
    out = load(spark, d, "customer").join(seen, "c_custkey", "left").select("c_custkey", say(F.col("c_nationkey") % 2 == 0).alias("expect"), say(F.col("seen").isNotNull()).alias("observed"))
    return out.withColumn("verdict", F.when(F.col("expect") == F.col("observed"), "OK").otherwise("MISMATCH"))


@query("""WITH r AS (SELECT p_brand, sum(p_retailprice) AS ref FROM part GROUP BY 1), u AS (SELECT p_brand, sum(p_retailprice / 100 * l_quantity) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT p_brand, round(amount, 4) AS amount, round(amount / nullif(ref, 0), 6) AS share FROM u JOIN r USING (p_brand)""")
def bom_scale_total(spark, d):
    part = load(spark, d, "part")
    used = load(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum(bom.scaled(F.col("p_retailprice"), F.col("l_quantity"))).alias("amount"))
    ref = part.groupBy("p_brand").agg(F.sum("p_retailprice").alias("ref"))
    return used.join(ref, "p_brand").select("p_brand", F.round("amount", 4).alias("amount"), F.round(bom.share(F.col("amount"), F.col("ref")), 6).alias("share"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice / 100 * l_quantity), 4) AS amount, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def bom_rollup_total(spark, d):
    out = bom.with_totals(load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"), "l_returnflag", "l_linestatus", bom.scaled(F.col("l_extendedprice"), F.col("l_quantity")))
    return out.withColumn("amount", F.round("amount", 4))


@query("""SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY 1""")
def bom_pivot(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_quantity"), 2))


@query("""WITH c AS (SELECT user_id, event_type, ts, event_id, sum(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM events),
w AS (SELECT *, row_number() OVER k AS n, lead(v) OVER k AS v0, lead(ts) OVER k AS t0 FROM c WINDOW k AS (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC))
SELECT user_id, event_type, round((CASE WHEN v >= v0 THEN v - v0 ELSE v END) / nullif((epoch_us(ts) - epoch_us(t0)) / 1e6, 0), 6) AS rate FROM w WHERE n = 1 AND t0 IS NOT NULL""")
def irate_last_two(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counter = timed_events(spark, d).withColumn("v", F.sum("value").over(w))
    out = metrics.irate(counter, ["user_id", "event_type"], "ts", "event_id", "v")
    return out.withColumn("rate", F.round("rate", 6))


@query("SELECT l_returnflag, round(100 - avg(l_discount) / avg(l_tax) * 100, 6) AS ratio FROM lineitem GROUP BY 1")
def ratio_of_means(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(100 - F.avg("l_discount") / F.avg("l_tax") * 100, 6).alias("ratio"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, value, CAST(row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events QUALIFY rank <= 25""")
def topk_per_instant(spark, d):
    e = timed_events(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "value")
    return metrics.top_k(e, ["day"], 25, [F.desc("value"), F.asc("event_id")])


@query("SELECT event_type, count(*) AS n, round(sum(CASE WHEN contains(event_type, 'c') THEN -value ELSE value END), 4) AS signed_sum FROM events WHERE regexp_full_match(event_type, '[a-c].*|view') AND NOT regexp_full_match(event_type, 'c') GROUP BY 1")
def label_matchers(spark, d):
    t = F.col("event_type")
    e = load(spark, d, "events").where(metrics.matches(t, "[a-c].*|view") & ~metrics.matches(t, "c"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.when(t.contains("c"), -F.col("value")).otherwise(F.col("value"))), 4).alias("signed_sum"))


_PATH = "regexp_extract(url, '^[^:]+://([^?#]*)', 1)"


@query(f"""WITH p AS (SELECT string_split({_PATH}, '/') AS l FROM pages), a AS (SELECT unnest(list_transform(range(1, len(l)), lambda i: array_to_string(l[1:i], '/'))) AS dir FROM p) SELECT dir, count(*) AS n FROM a GROUP BY 1""")
def dir_prefix_counts(spark, d):
    return paths.dir_counts(load(spark, d, "pages").select(F.expr(_PATH).alias("path")), "path")


_CASED_PATH = f"CASE WHEN page_id % 3 = 0 THEN upper({_PATH}) ELSE {_PATH} END"
_CANONICAL = """WITH RECURSIVE p AS (SELECT {rows} string_split(%s, '/') AS l FROM pages), a AS (SELECT unnest(list_transform(range(1, len(l)), lambda i: l[1:i])) AS dir FROM p),
c AS (SELECT array_to_string(dir, '/') AS dir, array_to_string(dir[:-2], '/') AS up, dir[-1] AS name, len(dir) AS depth, count(*) AS n FROM a GROUP BY ALL),
t AS (SELECT '' AS dir, '' AS canonical, 0 AS depth UNION ALL
SELECT c.dir, CASE WHEN t.canonical = '' THEN '' ELSE t.canonical || '/' END || first_value(c.name) OVER (PARTITION BY t.canonical, lower(c.name) ORDER BY c.n DESC, c.dir), c.depth FROM c JOIN t ON c.up = t.dir AND c.depth = t.depth + 1)""" % _CASED_PATH


@query(f"{_CANONICAL.format(rows='')} SELECT dir, canonical FROM t WHERE depth > 0")
def path_canonicalise(spark, d):
    """Directories of page paths, every third path upper-cased."""
    return paths.canonical_dirs(load(spark, d, "pages").select(F.expr(_CASED_PATH).alias("path")), "path")


_FILES = f"SELECT DISTINCT {_CASED_PATH} AS path, page_id % 17 AS duration, page_id % 5 AS bitrate, length(html) AS size FROM pages"
_MOVES = f"""{_CANONICAL.format(rows='DISTINCT')}, f AS (SELECT path, max(duration) AS duration, max(bitrate) AS bitrate, max(size) AS size FROM ({_FILES}) GROUP BY 1),
g AS (SELECT f.*, coalesce(t.canonical, '') AS cd, split_part(path, '/', -1) AS name FROM f LEFT JOIN t ON t.dir = regexp_extract(path, '^(.*)/[^/]*$', 1)),
w AS (SELECT *, max(duration) OVER k - min(duration) OVER k AS spread, first_value(name) OVER o AS best, first_value(path) OVER o AS best_path FROM g WINDOW k AS (PARTITION BY cd, lower(name)), o AS (PARTITION BY cd, lower(name) ORDER BY bitrate DESC, size DESC, path)),
m AS (SELECT path, CASE WHEN spread > 10 THEN path WHEN cd = '' THEN best ELSE cd || '/' || best END AS target,
CASE WHEN spread > 10 THEN 'ambiguous' WHEN path <> best_path THEN 'quarantine' WHEN path = CASE WHEN cd = '' THEN best ELSE cd || '/' || best END THEN 'keep' ELSE 'move' END AS decision FROM w)"""


def _files(spark, d):
    rows = load(spark, d, "pages").select(F.expr(_CASED_PATH).alias("path"), (F.col("page_id") % 17).alias("duration"), (F.col("page_id") % 5).alias("bitrate"), F.length("html").alias("size"))
    return rows.groupBy("path").agg(*(F.max(c).alias(c) for c in ("duration", "bitrate", "size")))


@query(f"{_MOVES} SELECT * FROM m")
def tree_plan(spark, d):
    """Keep, move, quarantine or ambiguous for every file of the page tree."""
    return paths.plan_moves(_files(spark, d))


@query(f"{_MOVES} SELECT count(*) FILTER (decision = 'keep') AS n_keep, count(*) FILTER (decision = 'move') AS n_move, count(*) FILTER (decision = 'quarantine') AS n_quarantine, count(*) FILTER (decision = 'ambiguous') AS n_ambiguous, (SELECT count(*) FROM f) AS n_all, count(*) FILTER (decision IN ('keep', 'move', 'quarantine', 'ambiguous')) = (SELECT count(*) FROM f) AS ok FROM m")
def tree_invariant(spark, d):
    files = durable(_files(spark, d), "files")
    return reconcile.reconciled(paths.plan_moves(files), "decision", ["keep", "move", "quarantine", "ambiguous"], files)


_MOVED = "SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS src, regexp_extract(target, '^(.*)/[^/]*$', 1) AS dst, count(*) AS n FROM m WHERE decision = 'move' GROUP BY 1, 2"


@query(f"{_MOVES}, r AS ({_MOVED}) SELECT *, row_number() OVER (ORDER BY n DESC, src, dst) AS place FROM r")
def move_report(spark, d):
    """Moves by source and target directory, most first; ties in byte order."""
    moved = paths.plan_moves(_files(spark, d)).where("decision = 'move'").groupBy(paths.dirname(F.col("path")).alias("src"), paths.dirname(F.col("target")).alias("dst")).agg(F.count("*").alias("n"))
    return order.with_place(moved, F.desc("n"), F.asc("src"), F.asc("dst"))


@query("""SELECT vec_id, len(embedding) AS n, list_bool_or(list_transform(embedding, lambda x: x > 0.2)) AS any_large, len(list_filter(embedding, lambda x: x > 0)) AS n_positive FROM embeddings""")
def array_hof(spark, d):
    e = F.col("embedding")
    n = lambda c: F.size(c).cast("bigint")
    return load(spark, d, "embeddings").select("vec_id", n(e).alias("n"), F.exists(e, lambda x: x > 0.2).alias("any_large"), n(F.filter(e, lambda x: x > 0)).alias("n_positive"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), '>' ORDER BY turn) || '>' AS folded FROM conversations GROUP BY 1")
def right_fold_text(spark, d):
    rows = load(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("turns"))
    fold = T.right_fold(F.col("turns"), F.lit(""), lambda x, acc: F.concat(x["role"], F.lit(":"), x["n"].cast("string"), F.lit(">"), acc))
    return rows.select("conv_id", fold.alias("folded"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'c' || user_id WHEN 'view' THEN 'v' || CAST(round(value) AS BIGINT) ELSE 'o' || event_type END AS said FROM events")
def union_dispatch(spark, d):
    tag = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise(F.lit("other"))
    arms = {"click": F.concat(F.lit("c"), F.col("user_id").cast("string")), "view": F.concat(F.lit("v"), F.round("value").cast("bigint").cast("string")), "other": F.concat(F.lit("o"), F.col("event_type"))}
    return load(spark, d, "events").select("event_id", T.dispatch(tag, arms).alias("said"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line_no, length(unnest(l)) AS n FROM l""")
def line_numbers(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"), F.length("line").cast("bigint").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE event_id > 500")
def cursor_tail(spark, d):
    return tail.after(load(spark, d, "events"), "event_id", 500).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events")
def cursor_replay(spark, d):
    return tail.after(load(spark, d, "events"), "event_id", 1 << 40).select("event_id", "user_id")


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedupe(spark, d):
    events = load(spark, d, "events")
    return tail.drain(spark, f"{d}/events.parquet*", events.schema, ["event_id"], "ts").select("event_id", "user_id", "event_type")


@query("SELECT event_id, CASE WHEN ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY THEN round(value * 2, 6) ELSE round(value, 6) END AS value FROM events")
def late_requery_upsert(spark, d):
    """The last two days are read again with doubled values, which replace the stored ones."""
    e = timed_events(spark, d).select("event_id", "ts", "value").withColumn("run", F.lit(0))
    newest = e.agg(F.max("ts").alias("m"))
    again = e.join(F.broadcast(newest), F.lit(True)).where(F.expr("ts >= m - INTERVAL 2 DAYS")).select("event_id", "ts", (F.col("value") * 2).alias("value"), F.lit(1).alias("run"))
    return tail.upsert_latest(e, again, ["event_id"], [F.desc("run")]).select("event_id", F.round("value", 6).alias("value"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY md5(l_orderkey || '-' || l_linenumber), l_orderkey, l_linenumber LIMIT 100")
def sample_hash_order(spark, d):
    turn = F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return load(spark, d, "lineitem").orderBy(turn, "l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber")


@query("""SELECT r_name, count(*) AS n, round(sum(l_extendedprice / 100 * l_quantity), 2) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def bom_join_chain(spark, d):
    chain = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    chain = chain.join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return chain.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum(bom.scaled(F.col("l_extendedprice"), F.col("l_quantity"))), 2).alias("amount"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_check(spark, d):
    return reconcile.orphans(load(spark, d, "documents").select("doc_id", "lang"), load(spark, d, "labels"), "doc_id")


_FOUND_HASHES = "SELECT doc_id, sha256(CASE WHEN toxic = 1 THEN upper(text) ELSE text END) AS h FROM documents JOIN (SELECT DISTINCT doc_id, toxic FROM labels) USING (doc_id)"
_HASH_VERDICTS = f"SELECT d.doc_id, CASE WHEN h IS NULL OR h = sha256('') THEN 'missing' WHEN h = sha256(text) THEN 'ok' ELSE 'mismatch' END AS verdict FROM documents d LEFT JOIN ({_FOUND_HASHES}) f ON d.doc_id = f.doc_id"


@query(_HASH_VERDICTS)
def hash_verdicts(spark, d):
    """The labelled documents are the other side; toxic ones have arrived in another case."""
    docs = load(spark, d, "documents")
    labels = load(spark, d, "labels").select("doc_id", "toxic").distinct()
    found = docs.join(labels, "doc_id").select("doc_id", F.sha2(F.when(F.col("toxic") == 1, F.upper("text")).otherwise(F.col("text")), 256).alias("hash"))
    return reconcile.hash_verdicts(docs.select("doc_id", F.sha2("text", 256).alias("hash")), found, "doc_id")


@query(f"SELECT count(*) FILTER (verdict = 'ok') AS n_ok, count(*) FILTER (verdict = 'mismatch') AS n_mismatch, count(*) FILTER (verdict = 'missing') AS n_missing, count(*) AS n_total FROM ({_HASH_VERDICTS})")
def verdict_tallies(spark, d):
    return reconcile.tallies(hash_verdicts(spark, d), "verdict", ["ok", "mismatch", "missing"])


@query("""WITH p AS (SELECT page_id, url, string_split(url, '/')[-1] AS name FROM pages), f AS (SELECT name, min(page_id) AS page_id FROM p GROUP BY 1)
SELECT CAST(doc_id AS VARCHAR) AS name, f.page_id, url FROM labels LEFT JOIN f ON f.name = CAST(doc_id AS VARCHAR) LEFT JOIN p ON p.page_id = f.page_id""")
def basename_first_match(spark, d):
    names = load(spark, d, "labels").select(F.col("doc_id").cast("string").alias("name"))
    return reconcile.first_match(names, load(spark, d, "pages").select("page_id", "url"), "name", "url", "page_id")


@query("SELECT c_custkey, coalesce(m, '') AS markers FROM customer LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def markers_per_key(spark, d):
    marks = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return reconcile.with_markers(load(spark, d, "customer").select("c_custkey"), marks, "c_custkey", "o_orderstatus")


@query("""WITH n AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)
SELECT p_brand, min(p_type) = max(p_type) AS alike FROM n WHERE n <= 2 GROUP BY 1 HAVING count(*) = 2""")
def first_two_alike(spark, d):
    return reconcile.first_two_alike(load(spark, d, "part"), ["p_brand"], ["p_partkey"], "p_type")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS segment FROM customer")
def constant_remap(spark, d):
    to = spark.createDataFrame([("BUILDING", "B"), ("MACHINERY", "M")], "c_mktsegment string, new string")
    return load(spark, d, "customer").join(F.broadcast(to), "c_mktsegment", "left").select("c_custkey", F.coalesce("new", "c_mktsegment").alias("segment"))


@query("""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(turn ORDER BY turn) AS t FROM conversations GROUP BY 1)
SELECT conv_id, r[1] AS head, CASE WHEN len(r) = 1 THEN r[1] END AS only_role, nullif(array_to_string(list_filter(t, lambda x: x > 3), ','), '') AS late, CASE WHEN len(r) > 4 THEN true END AS long_talk FROM c""")
def optional_values(spark, d):
    c = load(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("l"))
    late = N.non_empty(F.filter(F.col("l.turn"), lambda x: x > 3))
    return c.select("conv_id", N.head(F.col("l.role")).alias("head"), N.only(F.col("l.role")).alias("only_role"), F.array_join(late.cast("array<string>"), ",").alias("late"), N.present(F.size("l") > 4).alias("long_talk"))


@query("SELECT c_custkey, c_mktsegment AS name, CAST(c_nationkey AS VARCHAR) AS nation, 2 AS n_keys FROM customer")
def key_value_lines(spark, d):
    lines = F.concat(F.lit("name="), F.col("c_name"), F.lit("\nno pair\nnation="), F.col("c_nationkey").cast("string"), F.lit("\nNAME="), F.col("c_mktsegment"))
    m = load(spark, d, "customer").select("c_custkey", N.key_values(lines).alias("m"))
    return m.select("c_custkey", F.try_element_at("m", F.lit("NAME")).alias("name"), F.try_element_at("m", F.lit("NATION")).alias("nation"), F.size("m").alias("n_keys"))


@query("SELECT CAST(json_object('n_name', n_name, 'n_nationkey', n_nationkey, 'n_regionkey', n_regionkey) AS VARCHAR) AS doc FROM nation")
def canonical_json(spark, d):
    n = load(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name")
    return n.select(N.canonical_json(F.struct(*n.columns), n.schema).alias("doc"))


@query("SELECT s_suppkey, s_name || ' in ' || s_nationkey || ': ' || s_name AS said FROM supplier")
def template_fill(spark, d):
    return load(spark, d, "supplier").select("s_suppkey", T.substitute(F.lit("@who@ in @at@: @who@"), {"who": F.col("s_name"), "at": F.col("s_nationkey")}).alias("said"))


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def file_name_time(spark, d):
    name = F.concat(F.lit("IMG "), F.date_format("ts", "yyyy-MM-dd_HH-mm-ss"), F.lit(".jpg"))
    return timed_events(spark, d).select("event_id", T.file_time(name).cast("timestamp_ntz").alias("at"))


@query("SELECT page_id, split_part(url, ':', 1) AS before, substr(url, strpos(url, ':') + 1) AS behind FROM pages")
def split_once(spark, d):
    before, behind = T.split_once(F.col("url"), ":")
    return load(spark, d, "pages").select("page_id", before.alias("before"), behind.alias("behind"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'u' || user_id ELSE event_type END AS filed FROM events")
def event_routing(spark, d):
    return load(spark, d, "events").select("event_id", tail.routed(F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")), "click").alias("filed"))


@query("""SELECT conv_id, turn, l.doc_id AS line, l.doc_id IS NOT NULL AS logged FROM conversations c LEFT JOIN (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1) l ON l.text = c.text""")
def deferred_line_lookup(spark, d):
    log = load(spark, d, "documents").select("text", F.col("doc_id").alias("line"))
    return tail.with_line(load(spark, d, "conversations").select("conv_id", "turn", "text"), log, ["text"], "line").drop("text")


@query("SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN value * 2 ELSE value END AS value FROM events")
def partition_refresh(spark, d):
    """Only one partition answers; its rows replace it, and the others stay."""
    e = load(spark, d, "events").select("event_id", "event_type", "value")
    path = shared_folder(spark)
    tail.replace_partitions(e, path, "event_type")
    tail.replace_partitions(e.where("event_type = 'click'").withColumn("value", F.col("value") * 2), path, "event_type")
    return spark.read.parquet(path).select("event_id", "event_type", "value")
