from pyspark.sql import functions as F

from lodestone.operators import changes, chunking, graph, rank, search
from lodestone.sources import diff, scan

DIFF = '''diff --git a/a.go b/a.go
index 1..2 100644
--- a/a.go
+++ b/a.go
@@ -1,2 +1,3 @@ func
-x
+y
@@ -9,2 +10,0 @@
-gone
diff --git a/old name.py b/new name.py
similarity index 90%
rename from old name.py
rename to new name.py
diff --git "a/\\303\\251.txt" "b/\\303\\251.txt"
new file mode 100644
--- /dev/null
+++ "b/\\303\\251.txt"
@@ -0,0 +1 @@
+z
diff --git a/x.bin b/x.bin
Binary files a/x.bin and b/x.bin differ
diff --git a/d b/d
deleted file mode 100644
--- a/d
+++ /dev/null
@@ -1,3 +0,0 @@
-x
'''


def test_diff():
    out = diff.parse(DIFF.replace("\n", "\r\n"))
    assert [(c.path, c.kind, c.binary, c.ranges) for c in out] == [
        ("a.go", "modify", False, [(1, 3), (10, 10)]), ("new name.py", "rename", False, []), ("é.txt", "add", False, [(1, 1)]), ("x.bin", "modify", True, []), ("d", "delete", False, []),
    ]
    assert out[1].old_path == "old name.py"
    assert diff.parse("") == []


def test_scan(spark, tmp_path):
    files = {"a.go": b"package a\n", "b.bin": b"x\0y", "c.py": b"\xff\xfe", "d.md": b"\xef\xbb\xbf# T\n", "node_modules/x.js": b"1", "k.pem": b"s", "big.txt": b"x" * 2000}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = {r["path"]: r for r in scan.scan(spark, str(tmp_path), max_bytes=1000).collect()}
    assert set(rows) == {"a.go", "b.bin", "c.py", "d.md", "big.txt"}
    assert [rows[p]["problem"] for p in ("a.go", "b.bin", "c.py", "big.txt")] == [None, "binary_skipped", "invalid_utf8", "file_too_large"]
    assert (rows["d.md"]["text"], rows["d.md"]["offset"], rows["d.md"]["language"]) == ("# T\n", 3, "markdown")
    assert "k.pem" in {r["path"] for r in scan.scan(spark, str(tmp_path), include=("*.pem",)).collect()}


def test_windows_cover_every_line(spark):
    texts = {"one": "a", "empty": "", "end": "a\nb\n", "crlf": "a\r\nb\r\nc", "long": "\n".join(map(str, range(57)))}
    df = spark.createDataFrame([(p, "text", t) for p, t in texts.items()], "path string, language string, content string")
    seen = {}
    for r in chunking.windows(df, 20, 5).orderBy("path", "start_line").collect():
        seen.setdefault(r["path"], []).append((r["start_line"], r["end_line"]))
    assert seen == {"one": [(1, 1)], "empty": [(1, 1)], "end": [(1, 2)], "crlf": [(1, 3)], "long": [(1, 20), (16, 35), (31, 50), (46, 57)]}


def test_sections(spark):
    df = spark.createDataFrame([("p", "intro\n# A\nx\n## B\n"), ("q", "none"), ("r", "# Z")], "path string, content string")
    rows = sorted(tuple(r) for r in chunking.sections(df).collect())
    assert rows == [("p", 0, 1, 1, ""), ("p", 1, 2, 3, "A"), ("p", 2, 4, 4, "B"), ("q", 0, 1, 1, ""), ("r", 0, 1, 1, "Z")]


def symbols(spark, rows):
    return spark.createDataFrame(rows, "handle string, path string, language string, kind string, name string, qualified_name string, parent_handle string, start_line long, end_line long, confidence double")


def test_linking_needs_one_best_target(spark):
    s = symbols(spark, [
        ("a", "a.c", "c", "function", "run", "m.run", None, 1, 2, 1.0), ("b", "b.cpp", "cpp", "function", "Run", "n.Run", None, 1, 2, 1.0), ("c", "c.go", "go", "function", "run", "g.run", None, 1, 2, 1.0),
        ("v1", "v.vb", "vbnet", "sub", "Go", "V.Go", None, 1, 2, 1.0), ("d1", "x.js", "javascript", "type", "T", "x.T", None, 1, 2, 1.0), ("d2", "y.ts", "typescript", "type", "T", "y.T", None, 1, 2, 1.0),
    ])
    edges = spark.createDataFrame([("b", None, "run", "calls", 0.3), ("v1", None, "GO", "calls", 0.3), ("c", None, "T", "calls", 0.3), ("d1", None, "T", "calls", 0.3), ("d1", None, "y.T", "calls", 0.3), ("c", None, "m.run", "imports", 0.3)], "from_handle string, to_handle string, unresolved_to string, kind string, confidence double")
    got = {(r["from_handle"], r["unresolved_to"]): r["to_handle"] for r in graph.link(edges, s).collect()}
    assert got == {("b", "run"): "a", ("v1", "GO"): "v1", ("d1", "y.T"): "d2", ("c", "m.run"): "a"}


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "from_handle string, to_handle string")
    seeds = spark.createDataFrame([("c",)], "node string")
    assert sorted(r[0] for r in graph.incoming_closure(seeds, e).collect()) == ["a", "b", "c"]


def test_merged_intervals(spark):
    r = spark.createDataFrame([("p", 1, 5), ("p", 2, 3), ("p", 6, 7), ("p", 9, 9), ("q", 1, 1)], "path string, first long, last long")
    assert sorted(tuple(x) for x in changes.merge_intervals(r).select("path", "first", "last").collect()) == [("p", 1, 7), ("p", 9, 9), ("q", 1, 1)]


def test_fusion_counts_every_list(spark):
    lists = spark.createDataFrame([(1, "relation", 1, "x"), (1, "relation", 1, "x"), (1, "fts", 1, "y"), (1, "nonsense", 1, "z")], "query_id long, retriever string, rank int, handle string")
    rows = {r["handle"]: r for r in rank.fuse(lists.filter("retriever <> 'nonsense'")).collect()}
    assert rows["x"]["position"] == 1 and rows["x"]["hits"] == 2


def test_contained_spans_go(spark):
    rows = spark.createDataFrame([(1, "p", "a", 1, 9, 1), (1, "p", "b", 2, 3, 2), (1, "p", "c", 8, 12, 3), (1, "q", "d", 2, 3, 4), (2, "p", "b", 2, 3, 1)], "query_id long, path string, handle string, start_line long, end_line long, position long")
    assert sorted((r["query_id"], r["handle"]) for r in rank.without_contained(rows).collect()) == [(1, "a"), (1, "c"), (1, "d"), (2, "b")]


def test_empty_corpus(spark):
    f = spark.createDataFrame([], "path string, language string, content string")
    t = spark.createDataFrame([(1, "a")], "query_id long, term string")
    assert search.bm25(f, t).count() == 0 and chunking.windows(f).count() == 0


def test_name_search(spark):
    s = symbols(spark, [("a", "a", "go", "function", "Foo", "p.Foo", None, 1, 2, 1.0), ("b", "b", "go", "function", "foo", "q.foo", None, 1, 2, 0.5), ("c", "c", "go", "class-outline", "FOO", "r.FOO", None, 1, 2, 1.0)])
    v = spark.createDataFrame([(1, 0, "foo")], "query_id long, value_pos int, value string")
    assert [r["handle"] for r in search.exact(s, v).orderBy("rank").collect()] == ["a", "b", "c"]
    v = v.withColumn("value", F.lit("q.foo"))
    assert [r["handle"] for r in search.qualified(s, v).collect()] == ["b"]
    assert search.prefix(s, v.withColumn("value", F.lit("f"))).count() == 3
