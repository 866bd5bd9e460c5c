"""Registered queries over the measures of packets, each beside its SQL. Lines of orders stand for packet items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import measures as M
from lodestone.plans.catalog import AFTER, perturbed, query
from lodestone.sources import views
from lodestone.sources.views import FILES, SYMBOLS, table

#: Order of roles in what is shown, in general and by intent.
SHOWN = {
    "": "target implementation definition declaration type caller callee test import reference config template change dependent context documentation".split(),
    "callers": "target caller implementation test type import reference dependent context documentation".split(),
    "callees": "target callee type import implementation test reference context documentation".split(),
    "tests": "target test implementation type config context documentation".split(),
    "imports": "target import export dependent implementation type config context documentation".split(),
    "exports": "target import export dependent implementation type config context documentation".split(),
    "references": "target reference type implementation dependent test context documentation".split(),
    "impact": "change target dependent caller reference test implementation type config context documentation".split(),
    "template": "target template import implementation caller test config context documentation".split(),
}
ROLES = ("target", "implementation", "caller", "test", "context", "type", "config")

ITEMS = "items AS (SELECT CAST(l_orderkey AS BIGINT) AS case_id, 'p' || CAST(l_suppkey % 2 AS VARCHAR) AS profile, 'p/' || CAST(l_partkey % 50 AS VARCHAR) AS path, 's' || CAST(l_suppkey % 4 AS VARCHAR) AS symbol, l_returnflag AS kind, list_value('target', 'implementation', 'caller', 'test', 'context', 'type', 'config')[CAST(l_partkey % 7 AS INTEGER) + 1] AS role, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE l_returnflag || '\"' || CAST(l_partkey % 5 AS VARCHAR) || chr(10) || 'é' END AS text, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position FROM lineitem)"
EXPECTED = "expected AS (SELECT CAST(l_orderkey AS BIGINT) AS case_id, 'p/' || CAST((l_partkey + l_linenumber % 3) % 50 AS VARCHAR) AS path, CASE WHEN l_linenumber % 4 > 0 THEN 's' || CAST((l_suppkey + l_linenumber) % 4 AS VARCHAR) END AS symbol, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS kind, CASE WHEN l_linenumber % 3 = 0 THEN 'caller' WHEN l_linenumber % 3 = 1 THEN 'test' END AS role FROM lineitem)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    s = lambda c: c.cast("string")
    nth = F.row_number().over(Window.partitionBy("l_orderkey", F.col("l_suppkey") % 2).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("l_partkey") % 7 + 1).cast("int"))
    text = F.when(F.col("l_partkey") % 9 == 0, "").otherwise(F.concat("l_returnflag", F.lit('"'), s(F.col("l_partkey") % 5), F.lit("\né")))
    return t.select(
        F.col("l_orderkey").cast("long").alias("case_id"), F.concat(F.lit("p"), s(F.col("l_suppkey") % 2)).alias("profile"), F.concat(F.lit("p/"), s(F.col("l_partkey") % 50)).alias("path"), F.concat(F.lit("s"), s(F.col("l_suppkey") % 4)).alias("symbol"),
        F.col("l_returnflag").alias("kind"), role.alias("role"), text.alias("text"), nth.cast("long").alias("position"),
    )


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    s = lambda c: c.cast("string")
    n = F.col("l_linenumber")
    return t.select(
        F.col("l_orderkey").cast("long").alias("case_id"), F.concat(F.lit("p/"), s((F.col("l_partkey") + n % 3) % 50)).alias("path"), F.when(n % 4 > 0, F.concat(F.lit("s"), s((F.col("l_suppkey") + n) % 4))).alias("symbol"),
        F.when(n % 2 == 0, F.col("l_returnflag")).alias("kind"), F.when(n % 3 == 0, "caller").when(n % 3 == 1, "test").alias("role"),
    )


PATHS = "w AS (SELECT case_id, path, count(*) AS wanted FROM expected GROUP BY 1, 2), h AS (SELECT case_id, profile, path, count(*) AS there FROM items GROUP BY 1, 2, 3), found AS (SELECT c.case_id, c.profile, (SELECT sum(wanted) FROM w WHERE w.case_id = c.case_id)::BIGINT AS expected, coalesce((SELECT sum(least(wanted, there)) FROM w JOIN h ON w.case_id = h.case_id AND w.path = h.path WHERE h.case_id = c.case_id AND h.profile = c.profile), 0)::BIGINT AS matched FROM (SELECT DISTINCT case_id, profile FROM items) c)"


@query(f"WITH {ITEMS}, {EXPECTED}, {PATHS} SELECT * FROM found")
def packet_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.matched_paths(items(spark, sf_dir), expected(spark, sf_dir))


@query(f"""WITH {ITEMS}, {EXPECTED}, w AS (SELECT case_id, path, symbol, kind, role, count(*) AS wanted FROM expected GROUP BY ALL), m AS (SELECT i.case_id, i.profile, w.path, w.symbol, w.kind, w.role, wanted, count(*) AS there FROM items i JOIN w ON i.case_id = w.case_id AND i.path = w.path AND i.symbol = w.symbol AND (w.kind IS NULL OR w.kind = i.kind) AND (w.role IS NULL OR w.role = i.role) GROUP BY ALL),
f AS (SELECT case_id, profile, sum(least(wanted, there)) AS matched FROM m GROUP BY 1, 2), t AS (SELECT case_id, sum(wanted) AS expected FROM w GROUP BY 1)
SELECT c.case_id, c.profile, expected::BIGINT AS expected, coalesce(matched, 0)::BIGINT AS matched FROM (SELECT DISTINCT case_id, profile FROM items) c JOIN t USING (case_id) LEFT JOIN f ON f.case_id = c.case_id AND f.profile = c.profile""")
def packet_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.matched_symbols(items(spark, sf_dir), expected(spark, sf_dir))


RANKED = "ranks AS (SELECT i.case_id, i.profile, coalesce(min(CASE WHEN EXISTS (SELECT 1 FROM expected e WHERE e.case_id = i.case_id AND e.path = i.path AND (e.symbol IS NULL OR e.symbol = i.symbol)) THEN position END), 0)::BIGINT AS target_rank FROM items i GROUP BY 1, 2)"


@query(f"WITH {ITEMS}, {EXPECTED}, {RANKED} SELECT *, CASE WHEN target_rank > 0 THEN 1.0::DOUBLE / target_rank ELSE 0 END AS reciprocal_rank FROM ranks")
def packet_target_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.target_rank(items(spark, sf_dir), expected(spark, sf_dir))


@query(f"WITH {ITEMS}, {EXPECTED}, e AS (SELECT DISTINCT case_id, path, symbol, role FROM expected WHERE role IS NOT NULL) SELECT i.case_id, i.profile, round(avg(CASE WHEN i.role = e.role THEN 1.0 ELSE 0.0 END), 9) AS role_accuracy FROM items i JOIN e ON i.case_id = e.case_id AND i.path = e.path AND i.symbol = e.symbol GROUP BY 1, 2")
def packet_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.role_accuracy(items(spark, sf_dir), expected(spark, sf_dir)).withColumn("role_accuracy", F.round("role_accuracy", 9))


@query(f"WITH {ITEMS}, n AS (SELECT *, octet_length(encode(text)) AS size, row_number() OVER (PARTITION BY case_id, profile, text ORDER BY position) AS nth FROM items WHERE text <> '') SELECT case_id, profile, sum(size)::BIGINT AS source_bytes, sum(CASE WHEN nth > 1 THEN size ELSE 0 END)::BIGINT AS duplicate_bytes, round(sum(CASE WHEN nth > 1 THEN size ELSE 0 END) / sum(size)::DOUBLE, 9) AS duplicate_ratio FROM n GROUP BY 1, 2")
def packet_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.duplicate_sources(items(spark, sf_dir), "case_id", "profile").withColumn("duplicate_ratio", F.round("duplicate_ratio", 9))


@query(f"WITH {ITEMS} SELECT case_id, profile, sum(octet_length(encode(CAST(to_json(text) AS VARCHAR))))::BIGINT AS content_bytes, count(*) AS items FROM items GROUP BY 1, 2")
def packet_wire_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.packet_bytes(items(spark, sf_dir), "case_id", "profile")


@query(f"""WITH {ITEMS}, {EXPECTED}, {PATHS}, {RANKED}, r AS (SELECT f.case_id, f.profile, target_rank, CASE WHEN expected = 0 THEN 1.0 ELSE matched / expected::DOUBLE END AS recall FROM found f JOIN ranks k ON f.case_id = k.case_id AND f.profile = k.profile)
SELECT case_id, profile, array_to_string(list_filter([CASE WHEN case_id % 7 = 0 THEN 'intent_mismatch' END, CASE WHEN target_rank = 0 THEN 'target_not_selected' END, CASE WHEN target_rank > 5 THEN 'target_below_5' END, CASE WHEN recall < 1 THEN 'required_path_missing' END, CASE WHEN case_id % 3 = 0 THEN 'forbidden_selected' END, CASE WHEN case_id % 11 = 0 THEN 'nondeterministic_output' END, CASE WHEN case_id % 13 = 0 THEN 'known_handle_resent' END], lambda x: x IS NOT NULL), ',') AS codes FROM r""")
def failure_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = items(spark, sf_dir), expected(spark, sf_dir)
    r = M.matched_paths(i, e).join(M.target_rank(i, e), ["case_id", "profile"])
    every = lambda n: (F.col("case_id") % n == 0).cast("int")
    one, none = F.lit(1), F.lit(0)
    codes = M.failure_codes({
        "intent_correct": 1 - every(7), "target_rank": F.col("target_rank"), "path_recall": M.ratio(F.col("matched"), F.col("expected")), "symbol_recall": one, "violations": every(3), "relations_valid": one, "role_accuracy": one, "budget_ok": one,
        "deterministic": 1 - every(11), "missing_anchors": none, "expansions_missing": none, "resent": every(13),
    })
    return r.select("case_id", "profile", F.array_join(codes, ",").alias("codes"))


@query(f"WITH {ITEMS}, {EXPECTED} SELECT i.case_id, i.path, profile AS retriever, min(position) AS first_position, count(*) AS hits FROM items i JOIN (SELECT DISTINCT case_id, path FROM expected) e ON i.case_id = e.case_id AND i.path = e.path GROUP BY 1, 2, 3")
def retriever_path_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = items(spark, sf_dir).withColumnRenamed("profile", "retriever")
    return M.path_hits(lists, expected(spark, sf_dir))


@query("""WITH l AS (SELECT CAST(l_orderkey AS BIGINT) AS case_id, CAST(l_linenumber AS BIGINT) AS label, l_partkey % 5 > 0 AS indexed, l_partkey % 7 > 0 AS linked, l_suppkey % 3 = 0 AS retrieved, l_suppkey % 4 AS path_hits, CASE WHEN l_partkey % 6 = 0 THEN 3 ELSE 0 END AS ranked, CASE WHEN l_partkey % 12 = 0 THEN 2 ELSE 0 END AS packed, l_linenumber % 2 = 0 AS path_only, l_extendedprice AS x FROM lineitem)
SELECT case_id, label, x, CASE WHEN NOT indexed THEN 'label_not_indexed' WHEN packed > 0 THEN 'packed' WHEN ranked > 0 THEN 'packing_dropped' WHEN NOT linked THEN 'linking_unresolved' WHEN retrieved THEN 'ranking_dropped' WHEN NOT path_only AND path_hits > 0 THEN 'symbol_match_missing' ELSE 'path_scope_missing' END AS diagnostic,
CASE WHEN NOT indexed THEN 'label_not_indexed' WHEN packed > 0 THEN 'selected_in_packet' WHEN ranked > 0 THEN 'omitted_by_packer' WHEN NOT linked THEN 'relation_unresolved' WHEN retrieved THEN 'removed_before_rank' WHEN NOT path_only AND path_hits > 0 THEN 'expected_path_retrieved_identity_missing' ELSE 'expected_path_not_retrieved' END AS reason FROM l""")
def diagnosis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    labels = t.select(
        F.col("l_orderkey").cast("long").alias("case_id"), F.col("l_linenumber").cast("long").alias("label"), F.col("l_extendedprice").alias("x"), (p % 5 > 0).alias("indexed"), (p % 7 > 0).alias("linked"), (s % 3 == 0).alias("retrieved"), (s % 4).alias("path_hits"),
        F.when(p % 6 == 0, 3).otherwise(0).alias("ranked_position"), F.when(p % 12 == 0, 2).otherwise(0).alias("packed_position"), (F.col("l_linenumber") % 2 == 0).alias("path_only"),
    )
    return M.diagnosis(labels).select("case_id", "label", "x", "diagnostic", "reason")


@query(f"""WITH {ITEMS}, {EXPECTED}, {PATHS}, r AS (SELECT f.profile, f.case_id, (SELECT count(DISTINCT path) FROM expected e WHERE e.case_id = f.case_id) AS paths, matched / expected::DOUBLE AS recall, (SELECT count(*) * 100 FROM items i WHERE i.case_id = f.case_id AND i.profile = f.profile) AS wire, CASE WHEN f.case_id % 2 = 0 THEN 700 ELSE 0 END AS cumulative FROM found f)
SELECT profile, sum(CASE WHEN recall <= 0 THEN 0 WHEN recall >= 1 THEN paths ELSE floor(paths * recall + 0.5) END)::BIGINT AS useful, sum(CASE WHEN cumulative > 0 THEN cumulative ELSE wire END)::BIGINT AS tokens,
round(sum(CASE WHEN recall <= 0 THEN 0 WHEN recall >= 1 THEN paths ELSE floor(paths * recall + 0.5) END) * 1000 / sum(CASE WHEN cumulative > 0 THEN cumulative ELSE wire END)::DOUBLE, 6) AS per_1000 FROM r GROUP BY profile""")
def evidence_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = items(spark, sf_dir), expected(spark, sf_dir)
    paths = e.groupBy("case_id").agg(F.countDistinct("path").alias("paths"))
    wire = i.groupBy("case_id", "profile").agg((F.count(F.lit(1)) * 100).alias("wire_tokens"))
    r = M.matched_paths(i, e).join(paths, "case_id").join(wire, ["case_id", "profile"])
    r = r.withColumns({"path_recall": M.ratio(F.col("matched"), F.col("expected")), "symbols": F.lit(0), "symbol_recall": F.lit(0.0), "cumulative_tokens": F.when(F.col("case_id") % 2 == 0, 700).otherwise(0)})
    return M.efficiency(r, "profile").withColumn("per_1000", F.round("per_1000", 6))


@query("""WITH r AS (SELECT l_returnflag AS profile, CAST(l_extendedprice AS DOUBLE) AS wire, CAST(l_extendedprice * (1 - l_discount) AS DOUBLE) AS evidence FROM lineitem), o AS (SELECT *, CASE WHEN wire > 0 THEN greatest(0.0, least(1.0, (wire - evidence) / wire)) ELSE 0.0 END AS overhead FROM r)
SELECT profile, round(avg(overhead) FILTER (WHERE wire >= 1200), 9) AS overhead, count(*) FILTER (WHERE wire >= 1200) AS n FROM o GROUP BY profile""")
def evidence_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overhead of packets, over those of at least 1200 tokens."""
    wire = F.col("l_extendedprice").cast("double")
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("profile"), wire.alias("wire"), M.overhead(wire, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double")).alias("overhead"))
    return M.conditional_mean(r, "overhead", "wire", 1200, "profile").withColumn("overhead", F.round("overhead", 9))


@query("""WITH b AS (SELECT CAST(o_orderkey AS BIGINT) AS case_id, 1000 + o_custkey % 100 AS wire, 100 + o_custkey % 10 AS millis FROM orders WHERE o_orderkey % 9 <> 0), c AS (SELECT CAST(o_orderkey AS BIGINT) AS case_id, 1000 + o_orderkey % 300 AS wire, 100 + o_orderkey % 50 AS millis FROM orders WHERE o_orderkey % 8 <> 0)
SELECT coalesce(b.case_id, c.case_id) AS case_id, CASE WHEN b.case_id IS NULL THEN 'missing_baseline' WHEN c.case_id IS NULL THEN 'missing_candidate' WHEN c.wire > b.wire * 1.1::DOUBLE THEN 'wire_regressed' WHEN c.millis > b.millis * 1.2::DOUBLE THEN 'time_warning' ELSE 'ok' END AS status FROM b FULL JOIN c ON b.case_id = c.case_id""")
def report_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("case_id", F.col("o_orderkey").cast("long"))
    b = o.filter("o_orderkey % 9 <> 0").select("case_id", (1000 + F.col("o_custkey") % 100).alias("wire_tokens"), (100 + F.col("o_custkey") % 10).alias("millis"))
    c = o.filter("o_orderkey % 8 <> 0").select("case_id", (1000 + F.col("o_orderkey") % 300).alias("wire_tokens"), (100 + F.col("o_orderkey") % 50).alias("millis"))
    return M.gates(b, c, ["case_id"]).select("case_id", "status")


HANDLES = "first AS (SELECT case_id, path AS handle, sum(octet_length(encode(text)))::BIGINT + 1 AS tokens FROM items WHERE profile = 'p0' GROUP BY 1, 2), second AS (SELECT case_id, path AS handle, sum(octet_length(encode(text)))::BIGINT + 1 AS tokens FROM items WHERE profile = 'p1' GROUP BY 1, 2)"


@query(f"WITH {ITEMS}, {HANDLES} SELECT a.case_id, count(*) AS known, count(s.handle) AS resent, round(coalesce((SELECT sum(tokens) FROM second t WHERE t.case_id = a.case_id), 0) / sum(a.tokens)::DOUBLE, 9) AS delta_ratio FROM first a LEFT JOIN second s ON s.case_id = a.case_id AND s.handle = a.handle GROUP BY a.case_id")
def known_resent(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda p: items(spark, sf_dir).filter(F.col("profile") == p).groupBy("case_id", F.col("path").alias("handle")).agg((F.sum(F.octet_length("text")) + 1).alias("tokens"))
    return M.resent(of("p0"), of("p1"), "case_id").withColumn("delta_ratio", F.round("delta_ratio", 9))


@query(f"WITH {ITEMS} SELECT DISTINCT case_id FROM items WHERE role = 'config' AND case_id % 2 = 0")
def nondeterministic_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose second run differs: here, where the role of some items changed."""
    first = items(spark, sf_dir)
    second = first.withColumn("role", F.when((F.col("role") == "config") & (F.col("case_id") % 2 == 0), "type").otherwise(F.col("role")))
    return M.nondeterministic(first, second, "case_id")


@query("""WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS case_id, CASE c_custkey % 6 WHEN 0 THEN [] WHEN 1 THEN ['/abs'] WHEN 2 THEN ['a/../b'] ELSE ['a', 'b' || CAST(c_custkey % 4 AS VARCHAR)] END::VARCHAR[] AS required, CASE WHEN c_custkey % 5 = 0 THEN ['b0', 'b1'] ELSE [] END::VARCHAR[] AS forbidden, CASE WHEN c_custkey % 7 = 0 THEN ['target', 'hero'] ELSE ['caller'] END AS roles FROM customer)
SELECT case_id, unnest(list_filter([CASE WHEN len(list_filter(list_concat(required, forbidden), lambda p: starts_with(p, '/') OR contains(p, '..'))) > 0 THEN 'path_not_relative' END, CASE WHEN list_has_any(required, forbidden) THEN 'required_and_forbidden' END, CASE WHEN list_contains(roles, 'hero') THEN 'unknown_role' END, CASE WHEN len(required) = 0 THEN 'nothing_required' END], lambda x: x IS NOT NULL)) AS problem FROM c""")
def suite_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    required = F.when(k % 6 == 0, none).when(k % 6 == 1, F.array(F.lit("/abs"))).when(k % 6 == 2, F.array(F.lit("a/../b"))).otherwise(F.array(F.lit("a"), F.concat(F.lit("b"), (k % 4).cast("string"))))
    forbidden = F.when(k % 5 == 0, F.array(F.lit("b0"), F.lit("b1"))).otherwise(none)
    roles = F.when(k % 7 == 0, F.array(F.lit("target"), F.lit("hero"))).otherwise(F.array(F.lit("caller")))
    return M.suite_problems(table(spark, sf_dir, "customer").select(k.cast("long").alias("case_id"), required.alias("required"), forbidden.alias("forbidden"), roles.alias("roles")))


@query(f"""WITH {SYMBOLS}, w AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS case_id, 'part/' || CAST(l_partkey % 100 AS VARCHAR) || '.src' AS path, CASE WHEN l_linenumber % 3 = 0 THEN 'nothing' ELSE p_name END AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'type' END AS kind FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT DISTINCT * FROM w), m AS (SELECT d.case_id, count(DISTINCT s.handle) AS n, min(s.handle) AS h FROM d LEFT JOIN symbols s ON s.path = d.path AND s.name = d.name AND (d.kind IS NULL OR s.kind = d.kind) GROUP BY 1) SELECT case_id, CASE WHEN n = 1 THEN h END AS handle, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status FROM m""")
def anchor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    wanted = t.select((F.col("l_orderkey") * 10 + n).cast("long").alias("case_id"), F.concat(F.lit("part/"), (F.col("l_partkey") % 100).cast("string"), F.lit(".src")).alias("path"), F.when(n % 3 == 0, "nothing").otherwise(F.col("p_name")).alias("name"), F.when(n % 2 == 0, "type").alias("kind"))
    return M.anchor_lookup(views.symbols(spark, sf_dir), wanted)


@query(f"WITH {FILES}, {AFTER} SELECT f.path, CASE WHEN l.path IS NULL THEN 'missing' ELSE 'changed' END AS state FROM files f LEFT JOIN later l ON f.path = l.path WHERE l.path IS NULL OR l.sha256 <> f.sha256")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir)
    return M.freshness(f, perturbed(f))


_PLACE = " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(SHOWN["callers"]))


@query(f"WITH {ITEMS} SELECT case_id, profile, position, row_number() OVER (PARTITION BY case_id, profile ORDER BY CASE role {_PLACE} ELSE {len(SHOWN['callers'])} END, position) AS shown FROM items")
def presentation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as shown for a question about callers."""
    order = {r: i for i, r in enumerate(SHOWN["callers"])}
    return M.presentation(items(spark, sf_dir), order).select("case_id", "profile", "position", "shown")
