"""Files written in one format and read again, and the scalar functions that go with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import nested as N
from lathe.functions import text as T
from lathe.plans.registry import query
from lathe.shared import shared_folder
from lathe.sources import files
from lathe.streaming import tail
from lathe.tables import load


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || '\"q\", ' || chr(10) || ' x' AS c_name, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    """Quotes, commas and line ends inside values survive."""
    path = shared_folder(spark, "csv")
    files.write_csv(load(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit('"q", \n x')).alias("c_name"), "c_mktsegment"), path)
    return files.read_csv(spark, path, ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT n_nationkey, n_name FROM nation")
def json_array_read(spark, d):
    path = shared_folder(spark, "json")
    rows = load(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    rows.write.partitionBy("n_regionkey").text(path)
    return files.read_json_array(spark, path, "n_nationkey bigint, n_name string").select("n_nationkey", "n_name")


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey END AS size, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus || chr(9) || o_orderpriority END AS path FROM orders")
def sizes_read(spark, d):
    """Lines of size and path: cut at the first tab only; a size that isn't all digits is 0, a missing path empty."""
    path, size = shared_folder(spark, "sizes"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("+"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string"))
    line = F.when(F.col("o_orderkey") % 7 == 0, size).otherwise(F.concat_ws("\t", size, "o_orderstatus", "o_orderpriority"))
    files.write_lines(load(spark, d, "orders").select(line.alias("line")), "line", path)
    return files.read_sizes(spark, path)


@query("SELECT p_name AS value FROM part WHERE p_partkey % 3 = 0")
def lines_read(spark, d):
    """Blanks and comments are dropped."""
    path = shared_folder(spark, "lines")
    line = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("  # "), "p_name")).otherwise(F.lit(" \t"))
    files.write_lines(load(spark, d, "part").select(line.alias("line")), "line", path)
    return files.read_lines(spark, path)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS deploy, CAST(s_nationkey AS VARCHAR) AS port FROM supplier")
def fixture_read(spark, d):
    """Columns between spaces; what follows the last one is dropped."""
    path = shared_folder(spark, "fixture")
    files.write_lines(load(spark, d, "supplier").select(F.concat(F.lit(" "), "s_suppkey", F.lit("   "), "s_nationkey", F.lit(" and more")).alias("line")), "line", path)
    return files.read_fixture(spark, path, ["deploy", "port"])


@query('SELECT o_orderstatus AS "table", count(*) AS n FROM orders GROUP BY 1')
def ledger_round_trip(spark, d):
    path = shared_folder(spark, "ledger")
    files.write_ledger(load(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("table")).agg(F.count("*").alias("n")), path)
    return files.read_ledger(spark, path)


@query("SELECT 'lang-' || coalesce(lang, '') AS tag, count(*) AS n_lines, max(n) AS longest FROM (SELECT lang, unnest(list_transform(string_split(replace(text, chr(13), ' '), chr(10)), lambda x: length(x))) AS n FROM documents) GROUP BY 1")
def log_tree(spark, d):
    """A tree of dated logs: physical lines, counted and numbered per file."""
    path = shared_folder(spark, "logs")
    rows = load(spark, d, "documents").select(F.concat(F.lit("lang-"), F.coalesce("lang", F.lit(""))).alias("tag"), F.replace("text", F.lit("\r"), F.lit(" ")).alias("value"))
    rows.write.partitionBy("tag").text(path)
    lines = files.numbered_lines(spark, path).select(F.regexp_extract("file", r"/tag=([^/]+)/", 1).alias("tag"), "file", "line_no", F.length("raw").alias("n"))
    # Numbers run from 1 without gaps: the highest ones add up to the lines.
    last = lines.groupBy("tag", "file").agg(F.max("line_no").alias("last"), F.max("n").alias("n"))
    return last.groupBy("tag").agg(F.sum("last").alias("n_lines"), F.max("n").cast("bigint").alias("longest"))


@query("""SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(row_number() OVER (PARTITION BY event_type, strftime(ts, '%Y-%m-%d'), user_id % 10 ORDER BY event_id) AS INTEGER) AS line_no FROM events""")
def dated_logs(spark, d):
    """A tree of logs by tag, day and target: its tags, days and targets as columns, its physical lines numbered."""
    path = shared_folder(spark, "dated")
    e = load(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("target"), F.struct("event_id", "user_id").alias("order"), F.concat_ws(" ", "user_id", "event_id").alias("line"))
    files.write_logs(e, "event_type", "day", "target", "line", "order", path)
    rows = files.read_logs(spark, path, "*.txt")
    part = lambda i: F.split("raw", " ").getItem(i).cast("long")
    return rows.select(part(0).alias("user_id"), part(1).alias("event_id"), F.col("tag").alias("event_type"), F.col("file_date").cast("string").alias("day"), "line_no")


@query("""SELECT event_id AS id, event_type AS kind, CAST('2024-01-02 03:04:05' AS TIMESTAMP) AS at, true AS intact FROM events WHERE user_id % 7 <> 3
UNION ALL SELECT NULL, NULL, CAST('2024-01-02 03:04:05' AS TIMESTAMP), false FROM (SELECT DISTINCT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 FROM events WHERE user_id % 7 = 3)""")
def telemetry_read(spark, d):
    """Log lines that hold JSON arrays of events; those of some users are cut, which shows."""
    path = shared_folder(spark, "telemetry")
    batches = tail.batches_of(load(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("event_type").alias("kind")), ["user_id"], ["id"])
    body = F.when(F.col("user_id") % 7 == 3, F.substring("body", F.lit(1), F.length("body") - 4)).otherwise(F.col("body"))
    files.write_lines(batches.select(F.concat(F.lit("x client-event at=2024-01-02T03:04:05Z batch="), body).alias("line")), "line", path)
    return files.read_telemetry(spark, path, "id: bigint, kind: string").select("id", "kind", F.col("at").cast("timestamp_ntz").alias("at"), "intact")


@query("SELECT 'r' || r_regionkey AS name, r_name AS value FROM region WHERE r_regionkey <> 2")
def documents_sink(spark, d):
    """One folder for each document; a null one is none."""
    path = shared_folder(spark, "documents")
    doc = F.when(F.col("r_regionkey") != 2, F.col("r_name"))
    files.write_documents(load(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("name"), doc.alias("doc")), "name", "doc", path)
    return spark.read.text(path).select("name", "value")


@query("SELECT 'n=' || n_regionkey AS folder, count(*) AS n FROM (SELECT DISTINCT n_regionkey FROM nation) GROUP BY 1")
def tree_scan(spark, d):
    """Files below a folder, by their relative path and a pattern of names."""
    path = shared_folder(spark, "tree")
    load(spark, d, "nation").select("n_name", F.col("n_regionkey").alias("n")).repartition(1).write.partitionBy("n").parquet(path)
    return files.scan_tree(spark, path, "*.parquet").where("size > 0").groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.count("*").alias("n"))


@query("""SELECT 'first' AS poll, count(*) AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'unread', count(*) FROM events WHERE event_id % 2 = 0
UNION ALL SELECT 'quiet', count(*) FROM events WHERE event_id < 0 UNION ALL SELECT 'new', count(*) FROM events WHERE event_id % 2 = 1""")
def polled_twice(spark, d):
    """A poll that isn't acknowledged comes again; one that finds nothing new says so at its deadline; new rows alone come next."""
    events, folder, state = load(spark, d, "events").select("event_id", "user_id"), shared_folder(spark, "polled"), shared_folder(spark, "poll-state")
    out = []

    def look(name, seen, wait_s=0.0):
        rows, number = tail.poll(spark, folder, events.schema, state, wait_s)
        out.append((name, rows.count()))
        if seen:
            tail.acknowledge(spark, state, number)

    events.where("event_id % 2 = 0").write.parquet(folder)
    look("first", False)
    look("unread", True)
    look("quiet", True, 0.5)
    events.where("event_id % 2 = 1").write.mode("append").parquet(folder)
    look("new", True, 5)
    return spark.createDataFrame(out, "poll string, n long")


@query("""SELECT c_custkey, c_mktsegment AS stripped, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS digits, CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE c_mktsegment END AS filled, c_mktsegment || ' äß€' AS decoded,
round_even(c_custkey * 536870912 / 1073741824.0, 2) AS gib, CAST(round_even(c_custkey / 2.0, 0) AS DOUBLE) AS half_even, chr(64 + CAST(c_custkey % 26 AS INTEGER)) AS up FROM customer""")
def more_scalars(spark, d):
    c, key = F.col("c_mktsegment"), F.col("c_custkey")
    decoded = F.concat(c, F.lit(" äß€"))
    raw = F.when(key % 2 == 0, F.encode(decoded, "UTF-8")).otherwise(F.concat(F.encode(c, "ISO-8859-1"), F.lit(bytearray(b" \xe4\xdf\xa4"))))
    return load(spark, d, "customer").select(
        "c_custkey", T.strip(F.concat(F.lit(" \t\n"), c, F.lit("\r\n "))).alias("stripped"), T.digits_or_zero(F.when(key % 2 == 0, key.cast("string")).otherwise(F.concat(F.lit("-"), key))).alias("digits"),
        N.first_filled(F.when(key % 3 == 0, F.lit("")), F.when(key % 3 == 1, c), F.when(key % 3 == 2, c), default="none").alias("filled"), T.decode_text(raw).alias("decoded"),
        T.gib(key * 536870912).alias("gib"), F.bround(key / 2, 0).alias("half_even"), F.upper(F.char(F.when(key % 26 == 0, 64).otherwise(key % 26 + 96))).alias("up"),
    )
