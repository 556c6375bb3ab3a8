"""Sync plans, state along lines and cards against plain versions; nothing may depend on the size of a block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathe.functions import nested as N
from lathe.functions import text as T
from lathe.operators import lines, paths, sync
from lathe.sources import files, vcard

LIST = "path string, size int, stamp int"


def _plan(source, target):
    """Copies, renames and deletes, one file after the other."""
    s, t = {p: (n, m) for p, n, m in source}, {p: (n, m) for p, n, m in target}
    out, gone = {}, {}
    for p in sorted(set(t) - set(s)):
        gone.setdefault(t[p], []).append(p)
    for p in sorted(s):
        if p in t:
            out[p] = ("same" if s[p] == t[p] and None not in s[p] or s[p] == t[p] else "copy", None)
        elif None not in s[p] and gone.get(s[p]):
            out[p] = ("rename", gone[s[p]].pop(0))
        else:
            out[p] = ("copy", None)
    return out | {p: ("delete", None) for ps in gone.values() for p in ps}


def test_sync_plan_with_many_equal_files(spark):
    g = np.random.default_rng(1)
    both = [[(f"{side}{i}" if i % 3 else f"both{i}", int(g.integers(0, 3)), int(g.integers(0, 2))) for i in range(120)] for side in "st"]
    source, target = both[0] + [("null", None, 1), ("Null", None, 1), ("e", 0, 9)], both[1][:90] + [("null", None, 1), ("nulls", None, 1), ("f", 0, 9)]
    make = lambda rows: spark.createDataFrame(rows, LIST).repartition(3)
    got = sync.sync_plan(make(source), make(target), 0).collect()
    assert {r.path: (r.action, r.was) for r in got} == _plan(source, target)
    assert {r.action for r in got} == {"same", "copy", "rename", "delete"} and all(r.refused for r in got)
    deletes = sum(r.action == "delete" for r in got)
    assert not any(r.refused for r in sync.sync_plan(make(source), make(target), deletes).collect())
    assert [(r.action, r.refused) for r in sync.sync_plan(make(source[:1]), make(target).where("false")).collect()] == [("copy", False)]
    assert sync.sync_plan(make(source).where("false"), make(target).where("false")).collect() == []


def _parents(rows):
    out, stack = {}, {}
    for file, line, indent in rows:
        if indent is None:
            continue
        s = stack.setdefault(file, [])
        while s and s[-1][0] >= indent:
            s.pop()
        out[file, line] = s[-1][1] if s else None
        s.append((indent, line))
    return out


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_lines_are_the_same_for_any_block(spark, size):
    g = np.random.default_rng(size)
    rows = [(f, 3 * i + 1, None if g.random() < 0.1 else int(g.integers(0, 6)) if f != "deep" else i % 40) for f, n in (("a", 160), ("b", 1), ("deep", 90)) for i in range(n)]
    rows += [("down", i, 100 - i) for i in range(30)]
    t = spark.createDataFrame(rows, "file string, line_no int, indent int").repartition(4)
    assert {(r.file, r.line_no): r.parent for r in lines.scoped(t, size).collect()} == _parents(rows)
    want, held = {}, {}
    for f, i, n in rows:
        held[f] = f"m{i}" if n == 2 else held.get(f)
        want[f, i] = held[f]
    mark = F.when(F.col("indent") == 2, F.concat(F.lit("m"), "line_no"))
    assert {(r.file, r.line_no): r.at for r in lines.carried(t, mark, "at", size).collect()} == want


def test_separators_and_targets(spark):
    text = ["---", "path: early", "  - hostPath:", "---", "    path: /x", "    path: /y", "tail"]
    t = spark.createDataFrame([("f", i, s) for i, s in enumerate(text)] + [("g", 0, "path: x"), ("g", 1, "")], "file string, line_no int, raw string")
    opener, target = F.col("raw").rlike("^ *-? *hostPath:"), F.col("raw").rlike("^ *path: ")
    assert [tuple(r) for r in lines.last_marked(t, F.col("raw") == "---").collect()] == [("f", 3)]
    assert {tuple(r) for r in lines.first_after(t, opener, target).collect()} == {("f", 4), ("g", None)}
    assert [r[0] for r in t.orderBy("file", "line_no").select(lines.indent_of(F.col("raw"))).collect()] == [0, 0, 2, 0, 4, 4, 0, 0, None]


CARDS = """noise
BEGIN:VCARD\r
VERSION:3.0\r
FN:Ann\\, the \r
 first \\\\n\r
TEL;TYPE=home;VALUE="a:b;c":+1\r
tel:+2\r
END:VCARD\r
between:x
begin:vcard
FN:
N:B;C\\;D
END:VCARD
BEGIN:VCARD
FN:open
"""


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_cards_of_broken_files(spark, tmp_path, size):
    (tmp_path / "x.vcf").write_bytes(CARDS.encode())
    rows = vcard.read_vcards(spark, str(tmp_path), size=size).orderBy("card").collect()
    assert [r.card for r in rows] == [2, 10, 14]
    first = [(p["name"], p["params"], p["value"]) for p in rows[0].fields]
    assert first == [("VERSION", {}, "3.0"), ("FN", {}, "Ann\\, the first \\\\n"), ("TEL", {"TYPE": "home", "VALUE": "a:b;c"}, "+1"), ("TEL", {}, "+2")]
    assert [(p["name"], p["value"]) for p in rows[1].fields] == [("FN", ""), ("N", "B;C\\;D")] and rows[2].fields[0]["value"] == "open"
    one = spark.range(1).select(vcard.unescaped(F.lit("a\\\\n\\n\\,\\;")).alias("u"), vcard.escaped(F.lit("a\\n\n,;")).alias("e")).head()
    assert (one.u, one.e) == ("a\\n\n,;", "a\\\\n\\n\\,\\;")


def test_cards_are_folded_and_come_back(spark, tmp_path):
    texts = ["short", "x" * 500, "é漢" * 100, "a\nb,c;d\\e\\n", "", " leading and  trailing ", None, "y" * 72, "z" * 73]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, note string")
    vcard.write_vcards(df, {"UID": F.col("id"), "NOTE": F.col("note")}, f"{tmp_path}/out")
    raw = files.numbered_lines(spark, f"{tmp_path}/out", "*.txt")
    assert raw.agg(F.max(F.octet_length("raw"))).head()[0] <= 75
    of = lambda name: vcard.property_of(F.col("fields"), name)
    back = vcard.read_vcards(spark, f"{tmp_path}/out", "*.txt").select(of("UID").cast("int"), of("NOTE")).collect()
    assert sorted(map(tuple, back), key=lambda r: r[0]) == list(enumerate(texts))


def test_ends_of_files(spark, tmp_path):
    for name, body in (("whole.sql", b"x" * 5_000_000 + b"\n-- Dump completed on x\n"), ("cut.sql", b"Dump completed" + b"y" * 300), ("none.sql", b""), ("small.sql", b"Dump completed"), ("other.txt", b"z")):
        (tmp_path / name).write_bytes(body)
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "one.sql").write_bytes(b"")
    got = {r.path: (r.size > 0, r.verdict, r.n_read) for r in files.tail_verdicts(spark, f"file://{tmp_path}", "Dump completed", "*.sql").collect()}
    assert got == {"whole.sql": (True, "complete", 100), "cut.sql": (True, "truncated", 100), "none.sql": (False, "empty", 0), "deep/er/one.sql": (False, "empty", 0), "small.sql": (True, "complete", 14)}


def test_pruned_on_every_level(spark):
    schema = "a struct<x: int, y: array<struct<z: string, w: array<int>>>>, m map<string, array<int>>, k int"
    rows = [((None, [(None, []), ("s", [])]), {"p": [], "q": [1]}, 1), ((None, [(None, [])]), {"p": []}, None), (None, None, 2), ((3, []), {}, None)]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(F.to_json(N.pruned(F.struct(*df.columns), df.schema))).collect()]
    assert got == ['{"a":{"y":[{"z":"s"}]},"m":{"q":[1]},"k":1}', None, '{"k":2}', '{"a":{"x":3}}']


def test_facts_of_members(spark):
    df = spark.createDataFrame([("app", [("v1", True), ("v2", False), (None, True)]), ("bare", []), ("none", None)], "name string, vols array<struct<path: string, host: boolean>>")
    facts = {"host": lambda m: F.when(m["host"], m["path"]), "named": lambda m: F.when(m["path"].isNotNull(), F.lit("yes"))}
    got = {tuple(r) for r in N.member_facts(df, ["name"], "vols", facts).collect()}
    assert got == {("app", 0, "host", "v1"), ("app", 0, "named", "yes"), ("app", 1, "named", "yes")}


def test_relative_paths(spark):
    import os.path

    pairs = [("a/b/c", "a"), ("a/b/c", "a/b/c"), ("a", "a/b"), ("x/y", "a/b"), ("a/b", ""), ("", "a"), ("/m/./n//o", "/m/p"), ("a/bb", "a/b"), (None, "a")]
    df = spark.createDataFrame(pairs, "p string, s string")
    want = [os.path.relpath("/" + p.lstrip("/"), "/" + s.lstrip("/")) if p is not None else None for p, s in pairs]
    got = [r[0] for r in df.select(paths.relative(F.col("p"), F.col("s"))).collect()]
    assert got == want
    lines_ = spark.createDataFrame([("#x a",), ("#x\tb c",), ("y",), (" #x",), (None,), ("#x",)], "l string")
    assert [r[0] for r in lines_.select(T.first_field(F.col("l"), "#x")).collect()] == ["#x", "#x", None, None, None, "#x"]
