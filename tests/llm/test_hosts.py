"""Host reputation: addresses, and what the bound decides."""

import duckdb
from pyspark.sql import functions as F

from lathe.llm import host_reputation, queries


def test_addresses_are_their_own_domains(spark):
    names = ["10.0.0.1", "192.168.0.1:80", "[::1]:8080", "1.2.3.example.com", "1.2.3", "999.1.1.1"]
    hosts = spark.createDataFrame([(h,) for h in names], "host string")
    got = {r.host: (r.domain, r.suffix) for r in host_reputation.domain_and_suffix(hosts).collect()}
    assert got == {
        "10.0.0.1": ("10.0.0.1", "address"), "192.168.0.1:80": ("192.168.0.1", "address"), "[::1]:8080": ("[::1]", "address"), "1.2.3.example.com": ("example.com", "com"),
        "1.2.3": ("2.3", "3"), "999.1.1.1": ("999.1.1.1", "address"),
    }


def test_the_bound_blocks_one_and_spares_another_of_its_rate(spark):
    """Two hosts of one bad rate, one with many outcomes and one with few, among good ones: the same in Spark and in SQL."""
    bad = {"many.example.com": (90, 100), "few.example.org": (3, 3), "10.0.0.1": (45, 50), "10.0.0.2": (0, 50)}
    bad |= {f"good{i}.example.{s}": (i % 3, 60) for i in range(8) for s in ("com", "org")}
    pages, labels, n = [], [], 0
    for host, (k, m) in bad.items():
        for i in range(m):
            pages.append((n, f"https://{host}/p/{n}"))
            labels.append((n, 0 if i < k else 1, 0))
            n += 1
    p, q = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    outcomes = p.withColumn("doc_id", F.regexp_extract("url", "/([0-9]+)$", 1).cast("long")).join(q, "doc_id").select("url", (F.col("quality") == 0).alias("bad"))
    got = host_reputation.filter_urls(p, outcomes, queries.URL_RULES)
    said = {(r.host, r.verdict) for r in got.select("host", "verdict").distinct().collect()}
    assert {h for h, v in said if v == "block"} == {"many.example.com", "10.0.0.1"} and ("few.example.org", "allow") in said
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    c.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    want = c.sql(queries.oracle_sql()["op2_host_reputation"])
    rows = lambda cols, data: sorted(tuple(r[cols.index(x)] for x in sorted(cols)) for r in data if r[cols.index("rule")] is None)
    clean = lambda data: [tuple("" if v is None else round(v, 5) if isinstance(v, float) else v for v in r) for r in data]
    assert clean(rows(got.columns, [tuple(r) for r in got.collect()])) == clean(rows(want.columns, want.fetchall()))


def test_each_rule_says_what_the_contract_says(spark):
    """The query's rules, on hosts that the method alone would judge otherwise, in Spark and in SQL."""
    said = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {r: v for v, r in queries.URL_RULES} == said
    urls = {"http://a.com/en/1": "com/en/", "http://example.com/en/70": "example.com/en/7", "http://a.net/de/1": "net/de/", "http://example.net/de/9": "net/de/", "http://w.example.net/de/80": "example.net/de/8", "http://a.org/es/": "org/es/"}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = spark.createDataFrame([(u, True) for u in urls for _ in range(50)], "url string, bad boolean")
    want = [(i, r, said[r]) for i, r in enumerate(urls.values())]
    assert sorted(tuple(x) for x in host_reputation.filter_urls(pages, bad, queries.URL_RULES).select("page_id", "rule", "verdict").collect()) == want
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    assert sorted(c.sql(f"SELECT page_id, rule, verdict FROM ({queries.oracle_sql()['op2_host_reputation']})").fetchall()) == want
