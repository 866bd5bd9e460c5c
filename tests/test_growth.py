"""No operator lists all pairs of a frequent name: the widest step stays in proportion to the rows."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import changes, measures, relations, scopes, search


def widest(df) -> int:
    """The most rows that any step of the plan has put out."""
    df.collect()

    def most(node) -> int:
        rows = node.metrics().get("numOutputRows")
        own = [rows.get().value()] if rows.isDefined() else [0]
        kind = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        children = node.children()
        return max(own + [most(x) for x in inner + [children.apply(i) for i in range(children.size())]])

    return most(df._jdf.queryExecution().executedPlan())


def alike(spark, n: int):
    """Symbols of four names, each with n / 4 of them."""
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("s:"), i.cast("string")).alias("handle"), F.concat(F.lit("p/"), (i % 3).cast("string")).alias("path"), F.lit("javascript").alias("language"), F.lit("type").alias("kind"),
        F.concat(F.lit("name"), (i % 4).cast("string")).alias("name"), F.concat(F.lit("a"), (i % 20).cast("string"), F.lit(".name"), (i % 4).cast("string")).alias("qualified_name"),
        F.lit(None).cast("string").alias("parent_handle"), i.alias("start_line"), (i + 9).alias("end_line"), F.lit(0.5).alias("confidence"),
    )


def test_search_ranks_a_value_once(spark):
    """Each of 400 questions asks for two names of 500 symbols each; by pairs that were 400,000 rows, now 50 a value."""
    symbols = alike(spark, 2000)
    values = spark.range(400).select(F.col("id").alias("query_id"), F.posexplode(F.array(F.concat(F.lit("NAME"), (F.col("id") % 4).cast("string")), F.lit("name1"))).alias("value_pos", "value"))
    for f, v in ((search.exact, values), (search.prefix, values.withColumn("value", F.when(F.col("value_pos") == 0, F.col("value")).otherwise("a1")))):
        found = f(symbols, v, 50)
        assert widest(found) <= 400 * 2 * 50
        rows = {}
        for r in found.collect():
            rows.setdefault(r["query_id"], []).append((r["rank"], int(r["handle"][2:])))
        own = {i: sorted(range(2000), key=lambda k: (k % 3, k)) for i in range(4)}
        assert len(rows) == 400
        for q, got in rows.items():
            want = [k for k in own[q % 4] if k % 4 == q % 4][:50]
            assert [k for _, k in sorted(got)] == want


def test_search_goes_on_with_the_next_value(spark):
    """A symbol found by the first value is passed over in the second, and doesn't count twice; the limit holds for both."""
    symbols = alike(spark, 40).withColumn("name", F.when(F.col("start_line") < 3, "few").otherwise(F.col("name")))
    values = spark.createDataFrame([(1, 0, "FEW"), (1, 1, "f"), (1, 2, "name1")], "query_id long, value_pos int, value string")
    got = [int(r["handle"][2:]) for r in search.prefix(symbols, values, 5).orderBy("rank").collect()]
    assert got == [0, 1, 2] + sorted((k for k in range(3, 40) if k % 4 == 1), key=lambda k: (k % 3, k))[:2]


def test_anchor_lookup_meets_a_name_once(spark):
    """300 cases ask for names of 1,000 symbols each: by pairs more than 70,000 rows. Repeated cases have all their symbols."""
    symbols = alike(spark, 3000).withColumn("name", F.when(F.col("start_line") < 3, "name9").otherwise(F.col("name"))).withColumn("kind", F.when(F.col("start_line") == 2, F.lit(None)).otherwise(F.col("kind")))
    i = F.col("id")
    wanted = spark.range(300).select(i.alias("case_id"), F.concat(F.lit("p/"), (i % 3).cast("string")).alias("path"), F.when(i < 3, "name9").when(i == 3, "none").otherwise("name1").alias("name"), F.when(i != 1, "type").alias("kind"))
    again = spark.createDataFrame([(0, "p/0", "name9", "type"), (1, "p/0", "name9", None), (3, "p/1", "name9", "type")], wanted.schema)
    found = measures.anchor_lookup(symbols, wanted.unionByName(again))
    assert widest(found) <= 3000
    got = {r["case_id"]: (r["handle"], r["status"]) for r in found.collect()}
    assert len(got) == 300 and [got[k] for k in range(4)] == [("s:0", "found"), (None, "ambiguous"), (None, "missing"), ("s:1", "found")]
    assert {got[k] for k in range(4, 300)} == {(None, "ambiguous")}


def test_lexical_callers_count_a_name_once(spark):
    """400 edges name parts of which 500 each share a name: by pairs 200,000 rows. The counts are those of the pairs."""
    symbols = alike(spark, 2000).unionByName(alike(spark, 50).select(F.concat(F.lit("from:"), F.col("start_line").cast("string")).alias("handle"), "path", F.when(F.col("start_line") == 7, "go").otherwise("typescript").alias("language"), F.lit("function").alias("kind"), F.lit("f").alias("name"), F.lit("f").alias("qualified_name"), "parent_handle", "start_line", "end_line", "confidence"))
    # one handle has two names, one has a qualified name that doesn't end in its name
    symbols = symbols.unionByName(symbols.filter("handle = 's:5'").withColumn("name", F.lit("other"))).withColumn("qualified_name", F.when(F.col("handle") == "s:6", "x.odd").otherwise(F.col("qualified_name")))
    i = F.col("id")
    target = F.when(i % 5 == 0, F.concat(F.lit("a"), (i % 20).cast("string"), F.lit(".name"), (i % 4).cast("string"))).when(i % 5 == 1, "name1").when(i % 5 == 2, "x.odd").when(i % 5 == 3, "b::other").otherwise("name2x")
    edges = spark.range(400).select(F.concat(F.lit("from:"), (i % 50).cast("string")).alias("from_handle"), F.lit(None).cast("string").alias("to_handle"), target.alias("unresolved_to"), F.lit("calls").alias("kind"), (i / 400).alias("confidence"))
    anchors = symbols.filter("kind = 'type'").select(F.lit(0).cast("long").alias("query_id"), F.col("handle").alias("anchor_handle"))
    found = relations.lexical_callers(anchors, edges, symbols)
    assert widest(found) <= 5000
    pairs = relations.hits(anchors, edges, symbols, "callers").filter("direction = 'incoming' and not resolved")
    want = pairs.groupBy("anchor_handle").agg(F.countDistinct("handle").alias("callers"), F.max("confidence").alias("confidence"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert len({r["callers"] for r in found.collect()}) > 2


def shuffled(df) -> int:
    """The most rows that any shuffle of the plan has written."""
    df.collect()

    def most(node) -> int:
        kind, children = node.getClass().getSimpleName(), node.children()
        rows = node.metrics().get("shuffleRecordsWritten")
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        return max([rows.get().value() if rows.isDefined() else 0] + [most(x) for x in inner + [children.apply(i) for i in range(children.size())]])

    return most(df._jdf.queryExecution().executedPlan())


def written(df) -> int:
    """The rows that all shuffles of the plan have written."""
    df.collect()

    def total(node) -> int:
        kind, children = node.getClass().getSimpleName(), node.children()
        rows = node.metrics().get("shuffleRecordsWritten")
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        return (rows.get().value() if rows.isDefined() else 0) + sum(total(x) for x in inner + [children.apply(i) for i in range(children.size())])

    return total(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("language", ["php", "cpp", "csharp"])
def test_scopes_shuffle_no_pairs(spark, language):
    """500 calls mean 100 symbols each: the 50,000 rows come out, but none of them is shuffled; calls that repeat count once."""
    sep = {"php": "\\", "cpp": "::", "csharp": "."}[language]
    i = F.col("id")
    row = lambda n, handle, kind, name, parent: spark.range(n).select(F.concat(F.lit(handle), i.cast("string")).alias("handle"), F.lit("p").alias("path"), F.lit(language).alias("language"), F.lit(kind).alias("kind"), F.lit(name.split(sep)[-1]).alias("name"), F.lit(name).alias("qualified_name"), F.lit(parent).cast("string").alias("parent_handle"))
    kind = "method" if language == "csharp" else "function"
    symbols = row(1, "t", "class" if language == "csharp" else "namespace", f"N{sep}T", None).unionByName(row(100, "m", kind, f"N{sep}T{sep}run", "t0")).unionByName(row(100, "o", kind, f"N{sep}T{sep}other", "t0"))
    call = lambda n, target: spark.range(n).select(i.alias("call_id"), F.lit("m0").alias("from_handle"), F.lit(target).alias("target"))
    calls = call(500, "run").unionByName(call(3, "run")).unionByName(call(2, "other"))
    found = getattr(scopes, language)(calls, symbols)
    assert shuffled(found) <= 2000
    rows = [(r["call_id"], r["to_handle"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(c, f"m{k}") for c in range(500) for k in range(100)} | {(c, f"o{k}") for c in range(2) for k in range(100)}


@pytest.mark.parametrize("few", [True, False])
def test_csharp_calls_are_dealt_once(spark, monkeypatch, few):
    """5,000 calls of 14 kinds made 31,255 shuffled rows; where callers are few, nearly all are shuffled by call and by task only.
    Where nothing is few enough to travel, the rows are the same."""
    i = F.col("id")
    row = lambda n, handle, kind, name, qualified, parent, path="p": spark.range(n).select(F.concat(F.lit(handle), i.cast("string")).alias("handle"), F.lit(path).alias("path"), F.lit("csharp").alias("language"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(qualified).alias("qualified_name"), F.lit(parent).cast("string").alias("parent_handle"))
    # a type in a type, a method with a function in a function, partial declarations, and functions outside types
    symbols = row(1, "t", "class", "T", "A.T", None).unionByName(row(1, "u", "class", "U", "A.T.U", "t0")).unionByName(row(3, "m", "method", "M", "A.T.U.M", "u0")).unionByName(row(2, "n", "method", "N", "A.T.N", "t0"))
    symbols = symbols.unionByName(row(1, "f", "local-function", "F", "A.T.U.M.F", "m0")).unionByName(row(1, "g", "local-function", "G", "A.T.U.M.F.G", "f0")).unionByName(row(2, "x", "function", "X", "X", None)).unionByName(row(1, "y", "function", "X", "X", None, "q"))
    asks = [("m0", "M"), ("m0", "this.M"), ("m1", "T.N"), ("m1", "U.M"), ("g0", "F"), ("g0", "M"), ("m1", "F"), ("m0", "base.M"), ("m2", "other.M"), ("x0", "X"), ("x0", "A.T.N"), ("none", "A.T.N"), ("u0", "M"), ("m0", " global::T.N ")]
    want = [["m0", "m1", "m2"]] * 2 + [["n0", "n1"], ["m0", "m1", "m2"], ["f0"], ["m0", "m1", "m2"], [], [], [], ["x0", "x1"], ["n0", "n1"], [], ["m0", "m1", "m2"], ["n0", "n1"]]
    number = (i % len(asks)).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(a[k]) for a in asks]), number + 1)
    calls = spark.range(5000).select(i.alias("call_id"), pick(0).alias("from_handle"), pick(1).alias("target"))
    real, rows = scopes.stored, []

    def seen(df):
        rows.append(written(df))
        return real(df)

    monkeypatch.setattr(scopes, "stored", seen)
    if not few:
        monkeypatch.setattr(scopes, "FEW_SCOPES", 0)
        monkeypatch.setattr(scopes, "FEW_MEMBERS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = scopes.csharp(calls, symbols)
        rows.append(written(found))
        got = sorted((r["call_id"], r["to_handle"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted((c, h) for c in range(5000) for h in want[c % len(asks)])
    assert not few or sum(rows) <= 3 * 5000


def test_ranges_that_repeat_merge_alike(spark):
    """Ranges with equal ends, in any number, are one: the ties of the two windows don't fall apart."""
    once = spark.createDataFrame([("a", 1, 3), ("a", 5, 7), ("a", 9, 12), ("b", 2, 2)], "path string, first long, last long")
    many = once.crossJoin(spark.range(200)).select("path", "first", "last").repartition(7)
    for gap, want in ((0, [("a", 1, 3), ("a", 5, 7), ("a", 9, 12), ("b", 2, 2)]), (1, [("a", 1, 12), ("b", 2, 2)])):
        assert sorted(tuple(r) for r in changes.merge_intervals(many, gap).select("path", "first", "last").collect()) == want


@pytest.mark.parametrize("gap", [0, 3])
def test_merging_orders_no_equal_ranges(spark, gap):
    """A range that 20,000 changes repeat is ordered once: 20,400 rows were shuffled and sorted, ties left to either window."""
    i = F.col("id")
    ranges = spark.range(20400).select(F.lit("a").alias("path"), F.when(i < 400, i % 40 * 9).otherwise(7).alias("first"), F.when(i < 400, i % 40 * 9 + i % 5).otherwise(11).alias("last")).repartition(5)
    found = changes.merge_intervals(ranges, gap)
    assert written(found.select("path", "first", "last")) <= 20400 + 5 * 41 + 41  # those of the test's own repartition, each task's, and all once
    lines = sorted({n for r in ranges.distinct().collect() for n in range(r["first"], r["last"] + 1)})
    starts = [n for k, n in enumerate(lines) if not k or n > lines[k - 1] + 1 + gap]
    ends = [n for k, n in enumerate(lines) if k + 1 == len(lines) or lines[k + 1] > n + 1 + gap]
    assert sorted((r["first"], r["last"]) for r in found.collect()) == list(zip(starts, ends, strict=True))
