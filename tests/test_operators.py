"""Ties, nulls, repeats and empty inputs of the library's operators."""

import time

import pytest
from pyspark.sql import functions as F

from lathe.functions import nested as N
from lathe.functions import text as T
from lathe.operators import bom, dedup, metrics, order, paths, reconcile
from lathe.sources import files
from lathe.streaming import tail


def test_keep_first_and_conflicts(spark):
    df = spark.createDataFrame([(1, "u", "a", "p"), (2, "u", "a", "p"), (3, "u", "a", "q"), (4, "v", None, "p")], "seq int, url string, user string, pw string")
    assert [r.seq for r in dedup.keep_first(df, ["url", "user"], ["seq"]).orderBy("seq").collect()] == [1, 4]
    assert tuple(dedup.dedup_counters(df, ["url", "user"], "pw").first()) == (4, 3, 1, 1, 0)
    more = spark.createDataFrame([(5, "u ", "a", "  "), (6, "w", "b", None), (7, "w", "b", "")], "seq int, url string, user string, pw string")
    assert tuple(dedup.dedup_counters(df.union(more), ["url", "user"], "pw").first()) == (7, 5, 2, 2, 2)
    assert tuple(dedup.dedup_counters(df.where("false"), ["url", "user"], "pw").first()) == (0, 0, 0, 0, 0)
    assert dedup.keep_first(df.where("false"), ["url"], ["seq"]).count() == 0
    spaces = spark.createDataFrame([("x", "u\t", "p"), ("x", "u", "p"), ("x", "u", "p\n"), ("\u2003x", "\x1cu", "\u00a0p")], "url string, user string, pw string")
    assert tuple(dedup.dedup_counters(spaces, ["url", "user"], "pw").first()) == (4, 1, 3, 0, 0)


def test_survivor_range_is_strict(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 10.0), ("b", 3, 0.0), ("b", 4, 10.0001), ("c", 5, 1.0), ("c", 6, 1.0)], "g string, id int, x double")
    out = {r.id: r.decision for r in dedup.survivor(df, ["g"], [("x", True), ("id", False)], "x", 10.0).collect()}
    assert out == {1: "quarantine", 2: "keep", 3: "ambiguous", 4: "ambiguous", 5: "keep", 6: "quarantine"}
    rows = [(None, 1, 3.0), (None, 2, 9.0), ("t", 3, 5.0), ("t", 4, 5.0), ("n", 5, None), ("n", 6, 1.0), ("e", 7, None)]
    out = dedup.survivor(spark.createDataFrame(rows, "g string, id int, x double"), ["g"], [("x", True)], "x", 10.0, ["id"])
    assert {r.id: r.decision for r in out.collect()} == {1: "quarantine", 2: "keep", 3: "keep", 4: "quarantine", 5: "quarantine", 6: "keep", 7: "keep"}
    twice = dedup.survivor(spark.createDataFrame([("a", 1, 1.0)] * 3, "g string, id int, x double"), ["g"], [("x", True)], "x", 10.0)
    assert sorted(r.decision for r in twice.collect()) == ["keep", "quarantine", "quarantine"]


def test_count_verdicts(spark):
    b = spark.createDataFrame([("lost", 1), ("less", 3), ("more", 1), ("same", 2)], "t string, n long")
    a = spark.createDataFrame([("less", 2), ("more", 5), ("same", 2), ("new", 1)], "t string, n long")
    assert {r.t: r.verdict for r in reconcile.count_verdicts(b, a, "t").collect()} == {"lost": "LOST", "less": "SHRANK", "more": "grew", "same": "same", "new": "new"}
    with pytest.raises(Exception, match="unknown"):
        reconcile.count_verdicts(b, a.withColumn("n", F.lit(None).cast("long")), "t").collect()


def test_irate_reset_and_single_sample(spark):
    df = spark.createDataFrame([("a", 0, 1, 5.0), ("a", 10, 2, 25.0), ("b", 0, 1, 9.0), ("b", 2, 2, 4.0), ("c", 0, 1, 1.0), ("d", 3, 1, 1.0), ("d", 3, 2, 2.0)], "s string, t int, id int, v double")
    df = df.withColumn("t", F.timestamp_seconds("t"))
    assert {r.s: r.rate for r in metrics.irate(df, ["s"], "t", "id", "v").collect()} == {"a": 2.0, "b": 2.0, "d": None}


def test_matches_whole_label(spark):
    df = spark.createDataFrame([("xsda1",), ("sda",), ("md12",)], "d string")
    assert [r.d for r in df.where(metrics.matches(F.col("d"), r"sd[a-z]+|md\d+")).collect()] == ["sda", "md12"]


def test_canonical_dirs(spark):
    df = spark.createDataFrame([("Music/Rock/a",), ("Music/rock/b",), ("music/rock/c",), ("Music/x",), ("top",)], "path string")
    out = {r.dir: r.canonical for r in paths.canonical_dirs(df, "path").collect()}
    assert out == {"Music": "Music", "music": "Music", "Music/Rock": "Music/Rock", "Music/rock": "Music/Rock", "music/rock": "Music/Rock"}
    assert paths.canonical_dirs(df.where("path = 'top'"), "path").count() == 0
    # The spelling of the directory with most files wins, not that of most directories; ties by byte order; deep trees plan alike.
    ties = spark.createDataFrame([("a/x/1",), ("A/X/2",), ("A/X/3",), ("/".join("dD"[i % 2] for i in range(9)) + "/f",)], "path string")
    out = {r.dir: r.canonical for r in paths.canonical_dirs(ties, "path").collect()}
    assert out["a"] == "A" and out["a/x"] == "A/X" and out["d/D/d/D/d/D/d/D/d"] == "d/D/d/D/d/D/d/D/d"
    assert len(paths.canonical_dirs(ties, "path")._jdf.queryExecution().toString()) < 100_000


def test_plan_of_moves(spark):
    rows = [("M/a.mp3", 10, 1, 5), ("m/A.mp3", 12, 2, 4), ("M/b.mp3", 0, 1, 1), ("m/b.mp3", 11, 1, 1), ("M/c.mp3", 1, 1, 1), ("m/d.mp3", 1, 1, 1), ("top", 1, 1, 1), ("M/e", 5, 3, 3), ("m/e", 5, 3, 3)]
    plan = paths.plan_moves(spark.createDataFrame(rows, "path string, duration int, bitrate int, size int"))
    assert {r.path: (r.target, r.decision) for r in plan.collect()} == {
        "M/a.mp3": ("M/A.mp3", "quarantine"), "m/A.mp3": ("M/A.mp3", "move"), "M/b.mp3": ("M/b.mp3", "ambiguous"), "m/b.mp3": ("m/b.mp3", "ambiguous"), "M/c.mp3": ("M/c.mp3", "keep"),
        "m/d.mp3": ("M/d.mp3", "move"), "top": ("top", "keep"), "M/e": ("M/e", "keep"), "m/e": ("M/e", "quarantine"),
    }
    listing = spark.createDataFrame(rows, "path string, duration int, bitrate int, size int")
    parts = ["keep", "move", "quarantine", "ambiguous"]
    assert tuple(reconcile.reconciled(plan, "decision", ["keep", "move"], listing).first()) == (3, 2, 9, False)
    assert reconcile.reconciled(plan, "decision", parts, listing).first().ok
    assert not reconcile.reconciled(plan.where("path <> 'top'"), "decision", parts, listing).first().ok
    more = listing.union(spark.createDataFrame([(None, 1, 1, 1)] * 2, listing.schema))
    assert tuple(reconcile.reconciled(paths.plan_moves(more), "decision", parts, more).first()) == (3, 2, 2, 4, 11, True)


def test_places(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "ab"[i % 2]) for i in range(50)], "i int, k string").repartition(7)
    got = order.with_place(df, order.bytes_order("k"), F.asc("i")).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 51)) and [r.i for r in got] == [3] + [i for i in range(0, 50, 2)] + [i for i in range(1, 50, 2) if i != 3]
    assert order.with_place(df.where("false"), F.asc("i")).count() == 0


def test_strict_join_and_failures(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert reconcile.strict_join(a.where("k = 1"), b, ["k"]).collect()[0].v == "x"
    with pytest.raises(Exception, match="no partner for 2"):
        reconcile.strict_join(a, b, ["k"]).collect()
    assert tuple(reconcile.any_failed(a, F.col("k") > 1).first()) == (True, 1, 2) and tuple(reconcile.any_failed(a.where("false"), F.col("k") > 1).first()) == (False, 0, 0)
    assert reconcile.any_failed(a, F.lit(None).cast("boolean")).first().failed
    twice = spark.createDataFrame([("h", 1.0), ("h", 2.0)], "host string, value double")
    with pytest.raises(Exception, match="several series"):
        metrics.vector_op(twice, twice, ["host"], lambda x, y: x / y).collect()


def test_events(spark, tmp_path):
    body = spark.createDataFrame([("one\ntwo",), ("x" * 9000,), ("ä" * 5000,), (None,)], "b string")
    assert [r[0] for r in body.select(tail.first_request(F.col("b"))).collect()] == ["one", None, None, None]
    e = spark.createDataFrame([("own_public", "friend"), ("public", "friend"), (None, "f")], "kind string, nick0 string")
    assert [(r.is_own, r.nick) for r in tail.own_events(e, "kind", "nick0", F.lit("me")).collect()] == [(True, "me"), (False, "friend"), (False, "f")]
    many = spark.range(120).select((F.col("id") % 2).alias("u"), "id")
    batches = tail.batches_of(many, ["u"], ["id"])
    assert sorted((r.u, r.batch) for r in batches.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)] and tail.unbatched(batches, ["u"], "id: bigint").count() == 120
    files_ = spark.createDataFrame([("a", 1, "s"), ("b", 2, "t")], "path string, size long, stamp string")
    state = f"{tmp_path}/state"
    got = []
    take = lambda changed: got.append(sorted(r.path for r in changed.collect()))
    with pytest.raises(ZeroDivisionError):  # the import fails, so the state stays
        tail.import_changed(files_, state, lambda changed: 1 / 0)
    for listing in (files_, files_, files_.withColumn("stamp", F.lit("t"))):
        tail.import_changed(listing, state, take)
    assert got == [["a", "b"], [], ["a"]]


def test_import_that_dies_after_writing_its_state(spark, tmp_path, monkeypatch):
    listing, state, got = spark.createDataFrame([("a", 1, "s")], "path string, size long, stamp string"), f"{tmp_path}/state", []
    take = lambda changed: got.append(changed.count())
    with monkeypatch.context() as m:
        m.setattr(tail, "_point", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tail.import_changed(listing, state, take)
    tail.import_changed(listing, state, take)
    tail.import_changed(listing, state, take)
    assert got == [1, 1, 0]


def test_poll_waits_and_loses_nothing(spark, tmp_path, monkeypatch):
    folder, state, one = f"{tmp_path}/in", f"{tmp_path}/state", spark.range(3)
    one.where("false").write.parquet(folder)
    began = time.monotonic()
    rows, number = tail.poll(spark, folder, "id long", state, wait_s=1)
    assert rows.count() == 0 and time.monotonic() - began >= 1
    tail.acknowledge(spark, state, number)
    one.write.mode("append").parquet(folder)
    with monkeypatch.context() as m:  # the driver dies after the batch is committed and before it is read
        m.setattr(tail, "_rows_after", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tail.poll(spark, folder, "id long", state)
    rows, number = tail.poll(spark, folder, "id long", state)
    assert rows.count() == 3
    spark.range(3, 5).write.mode("append").parquet(folder)
    rows, number = tail.poll(spark, folder, "id long", state)  # what isn't acknowledged comes with what is new
    assert sorted(r.id for r in rows.collect()) == [0, 1, 2, 3, 4]
    tail.acknowledge(spark, state, number)
    assert tail.poll(spark, folder, "id long", state)[0].count() == 0


def test_upserts_survive_a_batch_that_died(spark, tmp_path, monkeypatch):
    base, schema = f"file://{tmp_path}", "k long, run int"
    stream = lambda: spark.readStream.schema(schema).parquet(f"{base}/in")
    run = lambda: tail.upsert_stream(stream(), ["k"], [F.desc("run")], f"{base}/table", f"{base}/state")
    spark.range(4).select(F.col("id").alias("k"), F.lit(0).alias("run")).write.parquet(f"{base}/in")
    run()
    spark.range(2, 6).select(F.col("id").alias("k"), F.lit(1).alias("run")).write.mode("append").parquet(f"{base}/in")
    with monkeypatch.context() as m:
        m.setattr(tail, "_point", lambda *a: 1 / 0)
        with pytest.raises(Exception, match="division"):
            run()
    assert {r.k: r.run for r in tail.upserted(spark, f"{base}/table", schema).collect()} == {0: 0, 1: 0, 2: 0, 3: 0}
    run()
    assert {r.k: r.run for r in tail.upserted(spark, f"{base}/table", schema).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 1}


def test_late_rows_are_an_error(spark, tmp_path):
    for i, day in enumerate(("2024-01-09", "2024-01-01")):
        spark.createDataFrame([(i, day)], "id int, day string").select("id", F.to_timestamp("day").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    assert tail.drain(spark, f"{tmp_path}/in", schema, ["id"], "ts").count() == 2
    assert tail.drain(spark, f"{tmp_path}/in", schema, ["id"], "ts", "30 days").count() == 2


def test_tree_and_lines(spark, tmp_path):
    (tmp_path / "t" / "deep dir").mkdir(parents=True)
    (tmp_path / "t" / "a+b.txt").write_bytes(b"123")
    (tmp_path / "t" / "deep dir" / "c.log").write_text("\n".join(f"line {i}" for i in range(1, 3001)))
    assert sorted((r.path, r["size"]) for r in files.scan_tree(spark, f"{tmp_path}/t").collect())[0] == ("a+b.txt", 3)
    assert [r.path for r in files.scan_tree(spark, f"{tmp_path}/t", "*.log").collect()] == ["deep dir/c.log"]
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = files.numbered_lines(spark, f"{tmp_path}/t", "*.log").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert sorted((r.line_no, r.raw) for r in lines) == [(i, f"line {i}") for i in range(1, 3001)]
    docs = spark.createDataFrame([("x", "a: 1"), ("y", None)], "name string, doc string")
    files.write_documents(docs, "name", "doc", f"{tmp_path}/docs")
    assert [tuple(r) for r in spark.read.text(f"{tmp_path}/docs").collect()] == [("a: 1", "x")]


def test_scalar_edges(spark):
    one = spark.createDataFrame([("a b*~ä/?", "TIT2 desc: v: w", "plain", "12345678")], "q string, tag string, no string, n string")
    row = one.select(T.percent_encoded(F.col("q")), *T.tag_value(F.col("tag")), T.tag_value(F.col("no"))[1], T.padded(F.col("n"), 4), T.padded(F.lit(7), 4), T.first_field(F.lit(" a\tb")), T.json_base64(F.lit("{}"), "$.a")).first()
    assert tuple(row) == ("a+b%2A~%C3%A4%2F%3F", "TIT2", "v", None, "12345678", "   7", "a", None)
    with pytest.raises(Exception, match="no count: 1x"):
        spark.range(1).select(T.digits_or_fail(F.lit("1x"), "count")).collect()
    sites = ["android://HASH==@com.Foo.bar/", "androidapp://com.foo", " WWW.x.org/a", ""]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in sites], "u string").select(T.site(F.col("u"))).collect()] == ["app:com.foo.bar", "app:com.foo", "x.org", ""]


def test_text_functions(spark):
    row = spark.createDataFrame([("\tÄB \n", "12", "+1", "Http://WWW.x.org:80/a", None)], "a string, b string, c string, u string, n string").select(
        T.ascii_lower(T.strip(F.col("a"))), T.digits_or_zero(F.col("b")), T.digits_or_zero(F.col("c")), T.site(F.col("u")), T.site(F.col("n")), T.strip(F.col("n"))
    ).first()
    assert tuple(row) == ("Äb", 12, 0, "x.org:80", "", "")
    with pytest.raises(Exception, match="unknown tag"):
        spark.range(1).select(T.dispatch(F.lit("z"), {"a": F.lit(1)})).collect()


def test_bom(spark):
    assert tuple(spark.range(1).select(bom.scaled(F.lit(50.0), F.lit(200.0)), bom.share(F.lit(1.0), F.lit(0.0))).first()) == (100.0, None)


def test_sources(spark, tmp_path):
    (tmp_path / "sizes").write_text("12\ta\tb\nx1\tc\n7\n")
    assert {(r.size, r.path) for r in files.read_sizes(spark, f"{tmp_path}/sizes").collect()} == {(12, "a\tb"), (0, "c"), (7, "")}
    log = tmp_path / "net" / "2024" / "01" / "02"
    log.mkdir(parents=True)
    (log / "chan.log").write_text("--- Log opened\n10:00 < a> hi\n")
    rows = files.read_logs(spark, str(tmp_path))
    assert [(r.tag, r.target, r.line_no, r.raw) for r in rows.where("target = 'chan'").orderBy("line_no").collect()] == [("net", "chan", 1, "--- Log opened"), ("net", "chan", 2, "10:00 < a> hi")]
    df = spark.createDataFrame([("a", 'q"x\ny', None)], "n string, p string, z string")
    files.write_csv(df, f"{tmp_path}/csv")
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/csv", ["n", "p", "z"]).collect()] == [("a", 'q"x\ny', None)]


def test_tail(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "seq long")
    assert sorted(r.seq for r in tail.after(df, "seq", 2).collect()) == [3]
    assert tail.after(df, "seq", 3).count() == 0
    assert tail.after(df, "seq", 9).count() == 3
    assert tail.after(df.where("false"), "seq", 9).count() == 0


def test_hash_verdicts_and_tallies(spark):
    h = lambda t: F.sha2(F.lit(t).cast("binary"), 256)
    want = spark.range(4).select(F.col("id").alias("p"), h("a").alias("hash"))
    got = spark.range(3).select(F.col("id").alias("p"), F.when(F.col("id") == 0, h("a")).when(F.col("id") == 1, h("b")).otherwise(h("")).alias("hash"))
    out = reconcile.hash_verdicts(want, got, "p")
    assert {r.p: r.verdict for r in out.collect()} == {0: "ok", 1: "mismatch", 2: "missing", 3: "missing"}
    assert tuple(reconcile.tallies(out, "verdict", ["ok", "mismatch", "missing"]).first()) == (1, 1, 2, 4)
    with pytest.raises(Exception, match="not listed"):
        reconcile.tallies(out, "verdict", ["ok"]).collect()


def test_first_match_needs_the_whole_name(spark):
    names = spark.createDataFrame([("a.mp3",), ("b",)], "name string")
    paths = spark.createDataFrame([(1, "x/aa.mp3"), (3, "y/a.mp3"), (2, "z/q/a.mp3")], "seq int, path string")
    assert {r.name: (r.seq, r.path) for r in reconcile.first_match(names, paths, "name", "path", "seq").collect()} == {"a.mp3": (2, "z/q/a.mp3"), "b": (None, None)}


def test_nested_and_text_values(spark):
    df = spark.createDataFrame([([], "", None, "A=1\nb=x=y\na=2\nplain")], "l array<int>, a string, b string, kv string")
    row = df.select(N.non_empty(F.col("l")), N.head(F.col("l")), N.only(F.col("l")), N.first_filled(F.col("a"), F.col("b"), default="none"), N.key_values(F.col("kv"))).first()
    assert tuple(row) == (None, None, None, "none", {"A": "2", "B": "x=y"})
    assert tuple(spark.range(1).select(*T.split_once(F.lit("a:b:c"), ":"), *T.split_once(F.lit("abc"), ":")).first()) == ("a", "b:c", "abc", None)
    raw = spark.createDataFrame([(bytearray("é€".encode()),), (bytearray(b"\xe9\xa4"),)], "b binary")
    assert [r[0] for r in raw.select(T.decode_text(F.col("b"))).collect()] == ["é€", "é€"]
    assert spark.range(1).select(T.file_time(F.lit("no time.jpg"))).first()[0] is None
    nested = spark.createDataFrame([((2, [(1, 0)]),)], "r struct<b: int, a: array<struct<z: int, y: int>>>")
    assert nested.select(N.canonical_json(F.col("r"), nested.schema["r"].dataType)).first()[0] == '{"a":[{"y":0,"z":1}],"b":2}'


def test_more_sources(spark, tmp_path):
    (tmp_path / "t").write_text("# head\n\nweb  host 80 open  rest\n")
    assert [tuple(r) for r in files.read_fixture(spark, f"{tmp_path}/t", ["deploy", "host", "port", "expect"]).collect()] == [("web", "host", "80", "open")]
    (tmp_path / "j").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in files.read_json_array(spark, f"{tmp_path}/j", "a int").collect()) == [1, 2]
    (tmp_path / "e").write_text('client-event at=2024-01-02T03:04:05Z batch=[{"k":1},{"k":2}]\nother\nclient-event at=x batch=[{"k":3},{"k\nclient-event at=x batch={"k":4}\nclient-event at=x batch=[]\n')
    got = [(r.k, r.intact, r.raw) for r in files.read_telemetry(spark, f"{tmp_path}/e", "k: int").collect()]
    assert sorted(got, key=str) == [(1, True, None), (2, True, None), (None, False, '[{"k":3},{"k'), (None, False, '{"k":4}')]
    ledger = spark.createDataFrame([("a", 3)], "table string, n long")
    files.write_ledger(ledger, f"{tmp_path}/l")
    assert [tuple(r) for r in files.read_ledger(spark, f"{tmp_path}/l").collect()] == [("a", 3)]


def test_merge_of_logins(spark):
    vault = spark.createDataFrame([(["https://www.A.com/x", "b.org"], " Me "), ([], "me"), ([None], None), (["http://c.net"], None)], "uris array<string>, username string")
    rows = [(1, "a.com", "ME", "p"), (2, "https://b.org/login", "me", "p"), (3, "b.org", "you", "p"), (4, "www.b.org", "You\t", "p\n"), (5, "b.org", "you", "q"), (6, None, None, "p"), (7, "c.net", "", "x"), (8, "d.net", None, None), (9, "d.net", "", "")]
    out = dedup.merge_logins(vault, spark.createDataFrame(rows, "seq int, url string, username string, password string"))
    assert {r.seq for r in out.where("skipped").collect()} == {1, 2, 4, 6, 7, 9}
    assert out.columns == ["seq", "url", "username", "password", "skipped"]


def test_busy_share_counts_cpus(spark):
    samples = spark.createDataFrame([("h", c, m) for c in (0, 1, 2) for m in ("idle", "user")] + [("lone", 0, "user")], "host string, cpu int, mode string")
    rates = spark.createDataFrame([("h", 0, "idle", 0.5), ("h", 1, "idle", 0.25), ("h", 2, "idle", None), ("h", 0, "user", 0.1)], "host string, cpu int, mode string, rate double")
    assert [tuple(r) for r in metrics.busy_share(samples, rates, "host", "cpu", "mode", "idle").collect()] == [("h", 75.0)]
    assert {tuple(r) for r in metrics.count_groups(samples, ["host"], ["cpu"]).collect()} == {("h", 3.0), ("lone", 1.0)}


def test_first_field_with_and_without_a_prefix(spark):
    df = spark.createDataFrame([(" \n a\tb",), ("E1 x",), (" E1",), ("",), (" ",), (None,)], "l string")
    assert [tuple(r) for r in df.select(T.first_field(F.col("l")), T.first_field(F.col("l"), "E")).collect()] == [("a", None), ("E1", "E1"), ("E1", None), ("", None), ("", None), (None, None)]
