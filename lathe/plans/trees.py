"""Trees of files and the lines in them: sync plans, scopes, carried state, cards, tail markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import nested as N
from lathe.functions import text as T
from lathe.operators import lines, paths, sync
from lathe.plans.registry import query
from lathe.shared import shared_folder
from lathe.sources import files, vcard
from lathe.tables import load

_FILES = "SELECT o_orderkey, o_orderkey % 40 AS size, o_orderkey % 7 AS stamp FROM orders"
_SYNC = f"""WITH f AS ({_FILES}), s AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'new/' ELSE 'old/' END || o_orderkey AS path, size, stamp FROM f WHERE o_orderkey % 13 <> 0),
t AS (SELECT 'old/' || o_orderkey AS path, size + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS size, stamp FROM f WHERE o_orderkey % 19 <> 0),
b AS (SELECT coalesce(s.path, t.path) AS path, s.path AS sp, t.path AS tp, s.size AS ss, s.stamp AS sm, t.size AS ts, t.stamp AS tm FROM s FULL JOIN t ON s.path = t.path),
n AS (SELECT path, ss AS size, sm AS stamp, row_number() OVER (PARTITION BY ss, sm ORDER BY path) AS r FROM b WHERE tp IS NULL),
g AS (SELECT path, ts AS size, tm AS stamp, row_number() OVER (PARTITION BY ts, tm ORDER BY path) AS r FROM b WHERE sp IS NULL),
p AS (SELECT CASE WHEN ss = ts AND sm = tm THEN 'same' ELSE 'copy' END AS action, path, NULL AS was FROM b WHERE sp IS NOT NULL AND tp IS NOT NULL
UNION ALL SELECT CASE WHEN g.path IS NULL THEN 'copy' ELSE 'rename' END, n.path, g.path FROM n LEFT JOIN g USING (size, stamp, r)
UNION ALL SELECT 'delete', g.path, NULL FROM g LEFT JOIN n USING (size, stamp, r) WHERE n.path IS NULL)"""


def _trees(spark, d):
    f = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).alias("size"), (F.col("o_orderkey") % 7).alias("stamp"))
    k = F.col("o_orderkey")
    source = f.where(k % 13 != 0).select(F.concat(F.when(k % 11 == 0, "new/").otherwise("old/"), k).alias("path"), "size", "stamp")
    target = f.where(k % 19 != 0).select(F.concat(F.lit("old/"), k).alias("path"), (F.col("size") + (k % 17 == 0).cast("int")).alias("size"), "stamp")
    return source, target


@query(f"{_SYNC} SELECT action, path, was, false AS refused FROM p")
def sync_plan(spark, d):
    """Copies, renames and deletes between two trees with many files of equal size and time."""
    return sync.sync_plan(*_trees(spark, d), most_deletes=1 << 40)


@query(f"{_SYNC} SELECT action, count(*) AS n, true AS refused FROM p GROUP BY 1")
def sync_refused(spark, d):
    """More deletions than the cap: the plan says so in every row."""
    return sync.sync_plan(*_trees(spark, d), most_deletes=2).groupBy("action").agg(F.count("*").alias("n"), F.bool_and("refused").alias("refused"))


def _lines(spark, d):
    return load(spark, d, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("line_no"), (F.col("user_id") % 9).alias("indent"), "user_id")


@query("""WITH l AS (SELECT event_type AS file, event_id AS line_no, user_id % 9 AS indent FROM events)
SELECT file, line_no, indent, (SELECT max(b.line_no) FROM l b WHERE b.file = l.file AND b.line_no < l.line_no AND b.indent < l.indent) AS parent FROM l""")
def line_scopes(spark, d):
    """The nearest earlier line of smaller indent, in files that are cut into blocks."""
    return lines.scoped(_lines(spark, d), 1000)


@query("""SELECT event_type AS file, event_id AS line_no, last_value(CASE WHEN user_id % 37 = 5 THEN 's' || event_id END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section FROM events""")
def carried_marks(spark, d):
    """The section each line stands in."""
    mark = F.when(F.col("user_id") % 37 == 5, F.concat(F.lit("s"), "line_no"))
    return lines.carried(_lines(spark, d), mark, "section", 700).select("file", "line_no", "section")


@query("""WITH l AS (SELECT event_type AS file, event_id AS line_no, user_id FROM events), o AS (SELECT file, min(line_no) AS o FROM l WHERE user_id % 50 = 7 GROUP BY 1)
SELECT file, max(line_no) FILTER (user_id % 10 = 0) AS separator, min(line_no) FILTER (user_id % 10 = 1 AND line_no > o) AS target FROM l LEFT JOIN o USING (file) GROUP BY 1""")
def marked_lines(spark, d):
    """The last separator of a file, and the first target line after an opening one."""
    l = _lines(spark, d)
    last = lines.last_marked(l, F.col("user_id") % 10 == 0).withColumnRenamed("line_no", "separator")
    first = lines.first_after(l, F.col("user_id") % 50 == 7, F.col("user_id") % 10 == 1).withColumnRenamed("line_no", "target")
    return first.join(last, "file", "left").select("file", "separator", "target")


@query("""SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 <> 0 THEN repeat(c_mktsegment || ',; \\é' || chr(10), 9) END AS note FROM customer""")
def vcard_round_trip(spark, d):
    """Customers to cards, with long and absent values, and back."""
    path = shared_folder(spark, "cards")
    note = F.when(F.col("c_custkey") % 3 != 0, F.repeat(F.concat("c_mktsegment", F.lit(",; \\é\n")), 9))
    vcard.write_vcards(load(spark, d, "customer"), {"UID": F.col("c_custkey"), "FN": F.col("c_mktsegment"), 'NOTE;TYPE="a:b"': note}, path)
    of = lambda name: vcard.property_of(F.col("fields"), name)
    cards = vcard.read_vcards(spark, path, "*.txt", 500)
    return cards.select(of("UID").cast("long").alias("c_custkey"), of("FN").alias("c_mktsegment"), of("NOTE").alias("note"))


@query("""SELECT n_nationkey || '.sql' AS path, CASE WHEN n_nationkey % 5 = 0 THEN 'empty' WHEN n_nationkey % 3 = 0 THEN 'truncated' ELSE 'complete' END AS verdict, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 100 END AS n_read FROM nation""")
def dump_verdicts(spark, d):
    """Dumps of customers by nation, of which some were cut and some are empty: only their ends are read."""
    path = shared_folder(spark, "dumps")
    k = F.col("n_nationkey")
    rows = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("INSERT "), "c_custkey"))), "\n").alias("body"))
    doc = F.concat_ws("\n", F.repeat(F.lit("-- head"), 20), "body", F.when(k % 3 != 0, F.lit("-- Dump completed")))
    dumps = load(spark, d, "nation").select("n_nationkey").join(rows, "n_nationkey", "left")
    files.write_named(dumps.select(F.concat(k, F.lit(".sql")).alias("name"), F.when(k % 5 == 0, "").otherwise(doc).alias("doc")), path)
    return files.tail_verdicts(spark, path, "Dump completed", "*.sql").select("path", "verdict", "n_read")


_NOTE = "array_to_string(list_filter([CASE WHEN role <> 'user' THEN '\"role\":\"' || role || '\"' END, CASE WHEN turn % 3 = 0 THEN '\"tags\":[\"' || role || '\"]' END], lambda x: x IS NOT NULL), ',')"


@query(f"""WITH m AS (SELECT conv_id, turn, {_NOTE} AS note FROM conversations), p AS (SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN turn % 2 = 0 THEN '"turn":' || turn END, CASE WHEN note <> '' THEN '"note":{{' || note || '}}' END], lambda x: x IS NOT NULL), ',') AS one FROM m)
SELECT conv_id, '[' || string_agg('{{' || one || '}}', ',' ORDER BY turn) FILTER (one <> '') || ']' AS doc FROM p GROUP BY 1""")
def pruned_records(spark, d):
    """Nested records without empty lists and absent fields, on every level."""
    note = F.struct(F.nullif("role", F.lit("user")).alias("role"), F.when(F.col("turn") % 3 == 0, F.array("role")).otherwise(F.array().cast("array<string>")).alias("tags"))
    turns = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct(F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("turn"), note.alias("note")).alias("m")))).alias("ms"))
    members = turns.select("conv_id", F.col("ms.m").alias("members"))
    return members.select("conv_id", F.to_json(N.pruned(F.col("members"), members.schema["members"].dataType)).alias("doc"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM conversations)
SELECT conv_id, n, CAST(place AS INTEGER) AS place, 'long' AS fact, CAST(length(text) AS VARCHAR) AS detail FROM c WHERE length(text) > 200
UNION ALL SELECT conv_id, n, CAST(place AS INTEGER), 'answers', role FROM c WHERE role = 'assistant'""")
def member_facts(spark, d):
    """What is true of the members of nested records, with columns of their parents."""
    c = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ms"), F.count("*").alias("n"))
    facts = {"long": lambda m: F.when(F.length(m["text"]) > 200, F.length(m["text"])), "answers": lambda m: F.when(m["role"] == "assistant", m["role"])}
    return N.member_facts(c, ["conv_id", "n"], "ms", facts)


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = o_orderkey % 3 THEN CASE WHEN o_orderkey % 5 = 0 THEN '.' ELSE CAST(o_orderkey AS VARCHAR) END
WHEN o_orderkey % 5 = 0 THEN '../' || o_custkey % 3 ELSE '../' || o_custkey % 3 || '/' || o_orderkey END AS way FROM orders""")
def relative_paths(spark, d):
    """The way from one folder to a file of another."""
    o = load(spark, d, "orders")
    path = F.concat(F.lit("a/"), F.col("o_custkey") % 3, F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("//./"), "o_orderkey")).otherwise(""))
    return o.select("o_orderkey", paths.relative(path, F.concat(F.lit("./a/"), F.col("o_orderkey") % 3, F.lit("/"))).alias("way"))


@query("""SELECT doc_id, line_no, regexp_extract(line, '^[^ \t]*') AS field FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no FROM documents) WHERE starts_with(line, 'E')""")
def first_fields(spark, d):
    """The first field of lines that begin with a mark."""
    each = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return each.select("doc_id", (F.col("i") + 1).alias("line_no"), T.first_field(F.col("line"), "E").alias("field")).where("field IS NOT NULL")
