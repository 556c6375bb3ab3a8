"""Records, lists and scalar functions inside a column."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import nested as N
from lathe.functions import text as T
from lathe.operators import paths
from lathe.plans.registry import query
from lathe.sources import files
from lathe.tables import load

_TURNS = "SELECT conv_id, list(struct_pack(turn := turn, role := role, n := length(text)) ORDER BY turn) AS l FROM conversations GROUP BY 1"


def _turns(spark, d):
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("l"))


@query(f"""SELECT conv_id, array_to_string(list_transform(l, lambda x: x.role || x.n), ',') AS mapped, array_to_string(flatten(list_transform(l, lambda x: [x.role, CAST(x.n AS VARCHAR)])), ',') AS concat_mapped,
array_to_string(list_transform(l, lambda x: x.role) || ['end'], ',') AS appended, CASE WHEN list_contains(list_transform(l, lambda x: x.role), 'assistant') THEN 'assistant' END AS any_of FROM ({_TURNS})""")
def list_functions(spark, d):
    """map, concatMap, append, joinWith, and a value that wins wherever it stands."""
    l = F.col("l")
    mapped = F.transform(l, lambda x: F.concat(x["role"], x["n"].cast("string")))
    every = N.concat_map(l, lambda x: F.array(x["role"], x["n"].cast("string")))
    return _turns(spark, d).select("conv_id", N.join_with(mapped, ",").alias("mapped"), N.join_with(every, ",").alias("concat_mapped"), N.join_with(N.append(F.col("l.role"), F.array(F.lit("end"))), ",").alias("appended"), N.any_of(F.col("l.role"), "assistant").alias("any_of"))


@query(f"SELECT conv_id, u.turn AS turn, u.n AS n FROM (SELECT conv_id, unnest(list_transform(l, lambda x: struct_pack(turn := x.turn, n := x.n))) AS u FROM ({_TURNS})) WHERE u.n > 50")
def nested_projection(spark, d):
    """Fields of records in a list, filtered there, and one row for each."""
    kept = F.filter(F.transform("l", lambda x: N.project(x, "turn", "n")), lambda x: x["n"] > 50)
    return _turns(spark, d).select("conv_id", F.explode(kept).alias("u")).select("conv_id", "u.*")


@query("""SELECT c_custkey, 'customer' AS name, c_nationkey AS nation, c_mktsegment || '!' AS extra, 'name=customer,nation=' || c_nationkey AS listed FROM customer""")
def record_override(spark, d):
    """Override is shallow and right-biased, and may add a field; then the record as a list of keys and values."""
    r = F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    out = load(spark, d, "customer").select("c_custkey", N.override(r, name=F.lit("customer"), extra=F.concat("c_mktsegment", F.lit("!"))).alias("r"))
    listed = F.transform(N.to_map(F.col("r"), ["name", "nation"]), lambda e: F.concat(e["mapKey"], F.lit("="), e["mapValue"]))
    return out.select("c_custkey", "r.name", "r.nation", "r.extra", N.join_with(listed, ",").alias("listed"))


@query("""SELECT c_nationkey, 'ns-' || c_nationkey AS namespace, array_to_string(list_sort(list_distinct(list('vol-' || c_mktsegment))) || ['derived-' || count(*)], ',') AS volumes FROM customer GROUP BY c_nationkey""")
def lifted_entity(spark, d):
    """One entity for many, with what they have and a derived member appended."""
    by = load(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_set(F.concat(F.lit("vol-"), "c_mktsegment"))).alias("v"), F.count("*").alias("n"))
    return by.select("c_nationkey", F.concat(F.lit("ns-"), "c_nationkey").alias("namespace"), N.join_with(N.append(F.col("v"), F.array(F.concat(F.lit("derived-"), "n"))), ",").alias("volumes"))


@query("SELECT '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS doc FROM nation")
def json_map(spark, d):
    return files.json_map(load(spark, d, "nation"), "n_name", "n_nationkey")


_WORDS = "(SELECT c_custkey, c_mktsegment || ' and ' || c_name AS words, c_mktsegment FROM customer)"


@query(f"SELECT c_custkey, list_contains(string_split(words, ' '), c_mktsegment) AS own, list_contains(string_split(words, ' '), substr(c_mktsegment, 1, 4)) AS part FROM {_WORDS}")
def whole_word(spark, d):
    words = F.concat("c_mktsegment", F.lit(" and "), "c_name")
    return load(spark, d, "customer").select("c_custkey", N.has_word(words, F.col("c_mktsegment")).alias("own"), N.has_word(words, F.substring("c_mktsegment", 1, 4)).alias("part"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'id3' WHEN doc_id % 3 = 1 THEN 'comment' ELSE 'none' END AS reader FROM documents""")
def suffix_dispatch(spark, d):
    name = F.concat("source", F.element_at(F.array(F.lit(".MP3"), F.lit(".ogg"), F.lit(".txt")), (F.col("doc_id") % 3 + 1).cast("int")))
    return load(spark, d, "documents").select("doc_id", T.by_suffix(name, {".mp3": F.lit("id3"), ".flac": F.lit("block"), ".ogg": F.lit("comment")}, F.lit("none")).alias("reader"))


@query("SELECT o_orderkey, o_orderkey + 1 AS next FROM orders")
def digits_or_fail(spark, d):
    return load(spark, d, "orders").select("o_orderkey", (T.digits_or_fail(F.col("o_orderkey").cast("string"), "key") + 1).alias("next"))


_REQUEST = """CASE conv_id % 9 WHEN 0 THEN '{"network":"n","target":"t","text":"hi","is_action":true}' WHEN 1 THEN '{"network":"../n","target":"a,b","text":"x' || chr(92) || 'ny"}' WHEN 2 THEN '{"network":"n","target":"t","text":""}'
WHEN 3 THEN '{"network":"n","target":"t"}' WHEN 4 THEN '{"network":"n","target":"t","text":{"a":1}}' WHEN 5 THEN '{"network":"n","target":"t t","text":"' || repeat('x', 401) || '"}' WHEN 6 THEN 'no json' WHEN 7 THEN '{"network":"n","target":"t","text":"a","is_action":"yes"}' ELSE '{"network":"n","target":"t","text":"' || repeat('x', 400) || '"}' END"""


@query("""SELECT conv_id, turn, CASE conv_id % 9 WHEN 1 THEN 'control,target,network' WHEN 2 THEN 'empty' WHEN 3 THEN 'missing' WHEN 4 THEN 'no text' WHEN 5 THEN 'too long,target' WHEN 6 THEN 'no json' WHEN 7 THEN 'action' ELSE '' END AS broken FROM conversations""")
def request_rules(spark, d):
    """Each reason to refuse a request; the SQL states them by hand."""
    rows = load(spark, d, "conversations").select("conv_id", "turn", F.expr(_REQUEST.replace("chr(92)", "char(92)")).alias("request"))
    return rows.select("conv_id", "turn", F.array_join(T.broken_rules(T.request_rules(F.col("request"))), ",").alias("broken"))


@query(r"""SELECT page_id, split_part(url, '/', -1) AS base, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, replace(url, '/', '-') AS flat, url_encode(url) AS encoded, md5(html) AS sum, page_id // 7 AS whole, CAST(page_id AS BIGINT) * 1073741824 AS bytes,
lpad(CAST(page_id AS VARCHAR), CAST(greatest(6, length(CAST(page_id AS VARCHAR))) AS INTEGER), ' ') AS padded FROM pages""")
def scalar_functions(spark, d):
    url = F.col("url")
    return load(spark, d, "pages").select(
        "page_id", paths.basename(url).alias("base"), paths.dirname(url).alias("dir"), F.replace(url, F.lit("/"), F.lit("-")).alias("flat"), T.percent_encoded(url).alias("encoded"), F.md5("html").alias("sum"),
        F.expr("page_id DIV 7").alias("whole"), T.gib_to_bytes(F.col("page_id")).alias("bytes"), T.padded(F.col("page_id"), 6).alias("padded"),
    )


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, strftime(ts, '%Y/%m/%d') AS folder, 'TIT2' AS tag, event_type AS value, CAST(event_id AS VARCHAR) AS field, 'click,view' AS plain, '`a`,`b``c`' AS quoted, event_type AS secret FROM events""")
def text_functions(spark, d):
    """UTC times, folders of a day, tag lines, first fields, carriage returns, quoted names, and Base64 below a JSON path."""
    t, line = F.col("event_type"), F.concat(F.lit("TIT2 (a title): "), F.col("event_type"), F.lit(": more"))
    tag, value = T.tag_value(line)
    doc = F.to_json(F.struct(F.struct(F.base64(F.encode(t, "UTF-8")).alias("tls.crt")).alias("data")))
    ts = F.col("ts").cast("timestamp")
    return load(spark, d, "events").select(
        "event_id", T.utc_iso(ts).alias("at"), T.date_path(ts).alias("folder"), tag.alias("tag"), value.alias("value"), T.first_field(F.concat(F.lit("  "), F.col("event_id").cast("string"), F.lit(" \t x"))).alias("field"),
        T.without_returns(F.lit("click\r,view\r")).alias("plain"), T.quoted_names(F.array(F.lit("a"), F.lit("b`c"))).alias("quoted"), T.json_base64(doc, "$.data['tls.crt']").alias("secret"),
    )
