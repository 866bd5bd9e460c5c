"""From questions to answers, beyond what the oracles cover: modes, scope, limits, abstention, linking, languages, the index."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import language
from lodestone.functions import text as T
from lodestone.operators import graph, linking, relations, search
from lodestone.plans import answer
from lodestone.sources import index, manifests

CHUNKS = "handle string, path string, language string, kind string, name string, qualified_name string, signature string, start_line long, end_line long, content string, confidence double, parent_handle string"
EDGES = "from_handle string, to_handle string, unresolved_to string, kind string, confidence double"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        ("h1", "src/a.go", "go", "function", "Load_File", "app.Load_File", "func Load_File()", 1, 9, "func Load_File() { read() }", 1.0, None),
        ("h2", "src/b.go", "go", "function", "Main", "app.Main", "func Main()", 1, 9, "func Main() { Load_File() }", 1.0, None),
        ("h3", "src/a_test.go", "go", "test", "TestLoad", "app.TestLoad", "func TestLoad()", 1, 9, "func TestLoad() { Load_File() }", 1.0, None),
        ("h4", "doc/readme.md", "markdown", "heading", "Loading", "Loading", "# Loading", 1, 9, "Load_File loads a file", 0.5, None),
    ]
    chunks = spark.createDataFrame(rows, CHUNKS).withColumns({"content_hash": F.sha2("content", 256), "tokens": T.estimate_tokens(F.col("content"))})
    edges = spark.createDataFrame([("h2", None, "pkg.Load_File", "calls", 0.4), ("h3", "h1", None, "tests", 0.9)], EDGES)
    return chunks, edges


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_callers_come_by_relation(spark, corpus):
    ranked, stages = answer.search_detailed(asked(spark, "who calls Load_File", " "), *corpus)
    rows = {r["handle"]: r for r in ranked.collect()}
    assert {r["query_id"] for r in rows.values()} == {0} and rows["h2"]["relation"] == "callers" and rows["h2"]["position"] == 1
    assert any(x["code"] == "relation-callers" for x in rows["h2"]["reasons"]) and not rows["h2"]["resolved"]
    assert stages["anchors"].collect()[0]["anchor_handle"] == "h1"
    packet = answer.packets(ranked).collect()
    assert {p["role"] for p in packet} >= {"target", "caller"} and all(p["violations"] == 0 for p in packet)
    assert answer.bundles(ranked).count() > 0


def test_modes_scope_and_limits(spark, corpus):
    q = asked(spark, "who calls Load_File")
    _, text_only = answer.search_detailed(q, *corpus, mode="fts-only")
    assert {r["retriever"] for r in text_only["lists"].collect()} == {"fts"}
    _, plain = answer.search_detailed(q, *corpus, mode="no-relations")
    assert "relation" not in {r["retriever"] for r in plain["lists"].collect()}
    with pytest.raises(ValueError):
        answer.search_detailed(q, *corpus, mode="other")
    inside, _ = answer.search_detailed(q, *corpus, paths=["src/b.go"])
    assert [r["handle"] for r in inside.collect()] == ["h2"] and inside.collect()[0]["relation"] == "callers"
    changed = spark.createDataFrame([("src/a.go", 2, 3)], "path string, first long, last long")
    only, _ = answer.search_detailed(q, *corpus, changed=changed, changed_only=True)
    assert [(r["handle"], r["changed"]) for r in only.collect()] == [("h1", True)]
    one, _ = answer.search_detailed(q, *corpus, limit=1)
    assert one.count() == 1 and answer.clamp_limit(9999) == 500 and answer.clamp_limit(0) == 200


def test_no_identity_means_no_evidence(spark, corpus):
    ranked, _ = answer.search_detailed(asked(spark, "zebra loads"), *corpus)
    assert answer.packets(ranked).count() == 0


def test_relations_by_name(spark):
    assert relations.supported("callers") and not relations.supported("friends")
    d = spark.createDataFrame([("a.b::c->d",), ("plain",), ("x.y.z",)], "t string")
    got = {r[0]: (r[1], r[2]) for r in d.select("t", relations.tails(F.col("t")), relations.middles(F.col("t"))).collect()}
    assert got["a.b::c->d"][0] == ["b::c->d", "c->d", "d"] and got["plain"] == ([], []) and got["x.y.z"][1] == ["y"]


def test_outlines_stand_for_their_symbol(spark):
    chunks = spark.createDataFrame([("s1", "template-outline", 1), ("s1", "block", 2), ("s2", "block", 3)], "symbol_handle string, kind string, n int")
    found = spark.createDataFrame([("s1",), ("s2",)], "handle string")
    assert sorted(r["n"] for r in relations.without_shadowed(found, chunks).collect()) == [1, 3]


def test_scopes_of_any_depth(spark):
    rows = [(f"s{i}", f"s{i - 1}" if i else None) for i in range(13)]
    up = graph.ancestors(spark.createDataFrame(rows, "handle string, parent_handle string"))
    assert sorted(r["level"] for r in up.filter("handle = 's12'").collect()) == list(range(1, 13))
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "handle string, parent_handle string")
    assert graph.ancestors(loop).count() == 2


def test_short_path_hints(spark):
    files = spark.createDataFrame([("a/go.mod",), ("b/x.c",)], "path string")
    hints = spark.createDataFrame([(1, "go"), (2, "c"), (3, "")], "query_id long, value string")
    assert {(r["query_id"], r["path"]) for r in search.path(files, hints).collect()} == {(1, "a/go.mod"), (2, "b/x.c")}


def test_paths(spark):
    d = spark.createDataFrame([("src/x/a.py", "../y/b"), ("src/x/a.py", "..mod.sub"), ("a.rs", "crate::net::io::Read")], "importer string, target string")
    keys = [set(r[0]) for r in d.select(linking.target_keys(F.col("importer"), F.col("target"))).collect()]
    assert "is:src/y/b" in keys[0] and "is:src/mod/sub" in keys[1] and "end:/net/io" in keys[2]


def test_overrides():
    assert language.override_problems({"": "go", "/a": "go", "../b": "go", "ok/*": "klingon", "x/*.y": "lua"}) == ["empty pattern", "../b: leaves the root", "/a: not relative", "ok/*: unknown language klingon"]
    assert language.specificity("lib/*/7.go") == 9


def test_json_with_comments():
    text = '// c\n{"a": "x // not, ]", /* y */ "b": [1, 2,],}'
    assert manifests.json.loads(manifests.plain_json(text)) == {"a": "x // not, ]", "b": [1, 2]}
    assert manifests.facts_of("a/Cargo.toml", "[package\n")[1] == "metadata_toml_invalid" and manifests.facts_of("x.txt", "")[0] == []


def test_index_gate_and_recovery(spark, tmp_path):
    own = index.Index(spark, str(tmp_path / "ix"))
    with pytest.raises(index.StaleIndex):
        own.read("files")
    f = spark.createDataFrame([("a", "go", "1", 1), ("b", "go", "2", 2)], index.TABLES["files"])
    none = {t: spark.createDataFrame([], index.TABLES[t]) for t in ("symbols", "relations", "chunks")}
    first = own.apply(f, none, "v1", linked=False).collect()[0]
    assert (first["added"], first["full"], first["reason"]) == (2, True, "no_index") and own.problem() == "linking_pending"
    own.finish_linking()
    assert own.read("files").count() == 2 and own.reindex_reason("v1") == "" and own.reindex_reason("v2") == "settings_changed" and own.reindex_reason("v1", True) == "requested"
    # a run that died before the pointer moved leaves the old version in place
    f.limit(1).write.parquet(str(tmp_path / "ix" / "v=2" / "files"))
    assert own.read("files").count() == 2
    gone = own.delete_file("a").collect()[0]
    assert (gone["deleted"], gone["unchanged"], gone["version"]) == (1, 1, 2) and [r["path"] for r in own.read("files").collect()] == ["b"]
    own.replace_file(spark.createDataFrame([("b", "go", "3", 9)], index.TABLES["files"]), none)
    assert own.read("files").collect()[0]["sha256"] == "3" and own.read("runs").count() == 3
