"""Paged tables and links, over http and as stored pages."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lathe.sources import paged

ROWS = [{"id": i, "name": None if i % 5 == 0 else f"n{i}", "day": f"2024-01-{i % 28 + 1:02d}", "more": {"x": i}} for i in range(2503)]


@pytest.fixture
def server():
    """Pages of ROWS; knows or doesn't know totals, filters by one comparison or ignores it, and fails some requests once."""
    asked, failed = [], set()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            path, _, q = self.path.partition("?")
            q = {k: v[0] for k, v in urllib.parse.parse_qs(q).items()}
            asked.append((path, q))
            if len(asked) % 3 == 0 and self.path not in failed and len(failed) < 5:
                failed.add(self.path)
                self.send_response(503)
                self.end_headers()
                return
            rows = ROWS
            if path == "/links":
                doc = {"list": [{"id": int(k), "links": [{"child": int(k) * 10 + i} for i in range(int(k) % 3)]} for k in q["keys"].split(",")]}
            else:
                if path == "/filtering" and "where" in q:
                    least = next((int(t.strip("()").split(",")[2]) for t in q["where"].split("~and") if ",gte," in t), 0)
                    rows = [r for r in rows if r["id"] >= least]
                at = int(q["offset"])
                doc = {"list": [{k: r[k] for k in q["fields"].split(",")} for r in rows[at : at + int(q["limit"])]]}
                if path != "/blind":
                    doc["pageInfo"] = {"totalRows": len(rows)}
            body = json.dumps(doc).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


QUERY = "?offset={offset}&limit={limit}&fields={fields}&where={where}"


@pytest.mark.parametrize("path", ["/plain", "/blind", "/filtering"])
def test_every_row_beyond_the_first_pages(spark, server, path):
    base, asked = server
    t = paged.table_records(spark, base + path + QUERY, "id long, name string, day date", limit=2, pages=100)
    got = t.where("id >= 17 AND name LIKE '%3%'")
    assert sorted(r.id for r in got.collect()) == [r["id"] for r in ROWS if r["id"] >= 17 and "3" in (r["name"] or "")]
    assert all(q["fields"] == "id,name,day" and "(id,gte,17)" in q["where"] for _, q in asked)
    assert len(asked) > 1200
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,17)" in plan.replace(", ", ",") or "id >= 17" not in plan.split("BatchScan")[0]
    days = paged.table_records(spark, base + path + QUERY, "day date, more struct<x: long>", limit=500).where(F.col("day") == F.lit("2024-01-05").cast("date"))
    assert days.count() == sum(r["day"] == "2024-01-05" for r in ROWS) and days.head().more.x % 28 == 4


def test_links_by_batches_of_parents(spark, server):
    base, asked = server
    parents = spark.createDataFrame([(i,) for i in [*range(0, 40), 7, None, 1005]], "id int")
    got = sorted(map(tuple, paged.linked_records(parents, "id", base + "/links?keys={keys}", "child long", 10).collect()))
    assert got == [(k, k * 10 + i) for k in [*range(40), 1005] for i in range(k % 3)]
    assert len({q["keys"] for _, q in asked}) == 5
    assert paged.linked_records(parents.where("false"), "id", base + "/links?keys={keys}", "child long").collect() == []


def test_stored_pages_give_the_table_back(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderdate")
    url = paged.store_pages(orders, f"file://{tmp_path}/pages", F.asc("o_orderkey"), limit=10)
    t = paged.table_records(spark, url, orders.schema, limit=10, pages=40)
    assert len(list((tmp_path / "pages").glob("*.json"))) == -(-orders.count() // 10) > 1000
    assert t.exceptAll(orders).count() == orders.exceptAll(t).count() == 0
    assert paged.table_records(spark, f"file://{tmp_path}/none/{{page}}.json", "a long").collect() == []
