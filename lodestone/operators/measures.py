"""Quality of packets: matches by multiset, roles, failure codes, diagnosis, efficiency, byte accounting, gates between reports.

Packets are tables of items: ``case_id, profile, position, path, symbol, kind, role, text``; expectations are
``case_id, path, symbol`` with ``kind`` and ``role`` that may be null for any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.store import stored, travelling

#: Gates of a comparison, as shares of the baseline.
WIRE_GATE, TIME_WARNING = 0.10, 0.20
#: Failure codes in order, with the column that says whether each holds.
FAILURES = (
    "intent_mismatch", "target_not_selected", "target_below_5", "required_path_missing", "required_symbol_missing", "forbidden_selected", "relation_invalid", "role_mismatch",
    "budget_exceeded", "nondeterministic_output", "expansion_anchor_missing", "expansion_required_missing", "known_handle_resent",
)
#: Names that no output may have.
FORBIDDEN_KEYS = ("absolute_path", "database_path", "embedding", "raw_score")


def ratio(part: Column, whole: Column) -> Column:
    """1 for nothing expected."""
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def proportional(total: Column, recall: Column) -> Column:
    """``total * recall``, rounded half up, within 0 and ``total``."""
    return F.when((total <= 0) | (recall <= 0), 0).when(recall >= 1, total).otherwise(F.floor(total * recall + 0.5)).cast("long")


def matched_paths(items: DataFrame, expected: DataFrame) -> DataFrame:
    """``case_id, profile, expected, matched``: each expected path takes one item of its own; the n-th takes the n-th.

    Numbering both sides pairs them off without looking at pairs: as many match as the smaller count of each path.
    """
    wanted = expected.groupBy("case_id", "path").agg(F.count(F.lit(1)).alias("wanted"))
    there = items.groupBy("case_id", "profile", "path").agg(F.count(F.lit(1)).alias("there"))
    met = wanted.join(there, ["case_id", "path"]).groupBy("case_id", "profile").agg(F.sum(F.least("wanted", "there")).alias("matched"))
    total = wanted.groupBy("case_id").agg(F.sum("wanted").alias("expected"))
    every = items.select("case_id", "profile").distinct().join(total, "case_id")
    return every.join(met, ["case_id", "profile"], "left").select("case_id", "profile", "expected", F.coalesce("matched", F.lit(0)).alias("matched"))


def matched_symbols(items: DataFrame, expected: DataFrame) -> DataFrame:
    """As ``matched_paths``, by path and symbol; the kind and role that an expectation names must agree."""
    keys = ("case_id", "path", "symbol", "kind", "role")
    wanted = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("wanted")).withColumnsRenamed({"kind": "want_kind", "role": "want_role"})
    met = items.join(wanted, ["case_id", "path", "symbol"]).filter((F.col("want_kind").isNull() | (F.col("want_kind") == F.col("kind"))) & (F.col("want_role").isNull() | (F.col("want_role") == F.col("role"))))
    there = met.groupBy("case_id", "profile", "path", "symbol", "want_kind", "want_role", "wanted").agg(F.count(F.lit(1)).alias("there"))
    found = there.groupBy("case_id", "profile").agg(F.sum(F.least("wanted", "there")).alias("matched"))
    total = wanted.groupBy("case_id").agg(F.sum("wanted").alias("expected"))
    every = items.select("case_id", "profile").distinct().join(total, "case_id")
    return every.join(found, ["case_id", "profile"], "left").select("case_id", "profile", "expected", F.coalesce("matched", F.lit(0)).alias("matched"))


def target_rank(items: DataFrame, expected: DataFrame) -> DataFrame:
    """``case_id, profile, target_rank, reciprocal_rank``: the first item at an expected path with its symbol, if it names one; 0 and 0 if none."""
    wanted = expected.select("case_id", "path", F.col("symbol").alias("want")).distinct()
    met = items.join(wanted, ["case_id", "path"]).filter(F.col("want").isNull() | (F.col("want") == F.col("symbol")))
    first = met.groupBy("case_id", "profile").agg(F.min("position").alias("r"))
    every = items.select("case_id", "profile").distinct().join(first, ["case_id", "profile"], "left")
    return every.select("case_id", "profile", F.coalesce("r", F.lit(0)).cast("long").alias("target_rank"), F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("reciprocal_rank"))


def role_accuracy(items: DataFrame, expected: DataFrame) -> DataFrame:
    """``case_id, profile, role_accuracy``: of the items at an expected path and symbol with a role, the share with that role."""
    wanted = expected.filter("role is not null").select("case_id", "path", "symbol", F.col("role").alias("want")).distinct()
    met = items.join(wanted, ["case_id", "path", "symbol"])
    return met.groupBy("case_id", "profile").agg(F.avg(F.when(F.col("role") == F.col("want"), 1.0).otherwise(0.0)).alias("role_accuracy"))


def duplicate_sources(items: DataFrame, *groups: str) -> DataFrame:
    """``groups, source_bytes, duplicate_bytes, duplicate_ratio``: bytes of texts that an earlier item of the packet has already."""
    once = items.filter("text <> ''").groupBy(*groups, "text").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.octet_length("text"))
    sums = once.groupBy(*groups).agg(F.sum(F.col("size") * F.col("n")).alias("source_bytes"), F.sum(F.col("size") * (F.col("n") - 1)).alias("duplicate_bytes"))
    return sums.withColumn("duplicate_ratio", F.col("duplicate_bytes") / F.col("source_bytes"))


def serialized_bytes(value: Column) -> Column:
    """Bytes of a string as a JSON value, quotes and escapes included."""
    return F.octet_length(F.to_json(F.struct(value.alias("v")))) - 6


def packet_bytes(items: DataFrame, *groups: str) -> DataFrame:
    """``groups, content_bytes, items``: what the texts take on the wire."""
    return items.groupBy(*groups).agg(F.sum(serialized_bytes(F.col("text"))).cast("long").alias("content_bytes"), F.count(F.lit(1)).alias("items"))


def overhead(wire: Column, evidence: Column) -> Column:
    """Share of the wire tokens that isn't evidence, within 0 and 1."""
    return F.when(wire > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (wire - evidence) / wire))).otherwise(0.0)


def failure_codes(r: dict[str, Column]) -> Column:
    """Codes that hold, in order; ``r``: intent_correct, target_rank, path_recall, symbol_recall, violations, relations_valid,
    role_accuracy, budget_ok, deterministic, missing_anchors, expansions_missing, resent."""
    holds = {
        "intent_mismatch": r["intent_correct"] == 0, "target_not_selected": r["target_rank"] == 0, "target_below_5": r["target_rank"] > 5, "required_path_missing": r["path_recall"] < 1,
        "required_symbol_missing": r["symbol_recall"] < 1, "forbidden_selected": r["violations"] > 0, "relation_invalid": r["relations_valid"] == 0, "role_mismatch": r["role_accuracy"] < 1,
        "budget_exceeded": r["budget_ok"] == 0, "nondeterministic_output": r["deterministic"] == 0, "expansion_anchor_missing": r["missing_anchors"] > 0, "expansion_required_missing": r["expansions_missing"] > 0, "known_handle_resent": r["resent"] > 0,
    }
    return F.array_compact(F.array(*[F.when(holds[code], code) for code in FAILURES]))


def diagnosis(labels: DataFrame) -> DataFrame:
    """``labels`` with ``diagnostic, reason``; labels: ``indexed, linked, retrieved, path_hits, ranked_position, packed_position, path_only``.

    The furthest stage that a label reached decides; one that was never retrieved is told apart by whether its path was.
    """
    rules = (
        (~F.col("indexed"), "label_not_indexed", "label_not_indexed"), (F.col("packed_position") > 0, "packed", "selected_in_packet"), (F.col("ranked_position") > 0, "packing_dropped", "omitted_by_packer"),
        (~F.col("linked"), "linking_unresolved", "relation_unresolved"), (F.col("retrieved"), "ranking_dropped", "removed_before_rank"),
        (~F.col("path_only") & (F.col("path_hits") > 0), "symbol_match_missing", "expected_path_retrieved_identity_missing"),
    )
    chosen = reduce(lambda out, r: out.when(r[0], F.struct(F.lit(r[1]).alias("d"), F.lit(r[2]).alias("r"))), rules[1:], F.when(rules[0][0], F.struct(F.lit(rules[0][1]).alias("d"), F.lit(rules[0][2]).alias("r"))))
    last = F.struct(F.lit("path_scope_missing").alias("d"), F.lit("expected_path_not_retrieved").alias("r"))
    return labels.select("*", chosen.otherwise(last).alias("_told")).select(*labels.columns, F.col("_told.d").alias("diagnostic"), F.col("_told.r").alias("reason"))


def path_hits(lists: DataFrame, expected: DataFrame) -> DataFrame:
    """``case_id, path, retriever, first_position, hits``: where and how often each list holds an expected path."""
    return lists.join(expected.select("case_id", "path").distinct(), ["case_id", "path"]).groupBy("case_id", "path", "retriever").agg(F.min("position").alias("first_position"), F.count(F.lit(1)).alias("hits"))


def efficiency(results: DataFrame, *groups: str) -> DataFrame:
    """``groups, useful, tokens, per_1000``; results: ``paths, path_recall, symbols, symbol_recall, wire_tokens, cumulative_tokens``.

    Labels found, by the rounded share of the distinct ones, for every thousand tokens on the wire.
    """
    useful = proportional(F.col("paths"), F.col("path_recall")) + proportional(F.col("symbols"), F.col("symbol_recall"))
    tokens = F.when(F.col("cumulative_tokens") > 0, F.col("cumulative_tokens")).otherwise(F.col("wire_tokens"))
    sums = results.groupBy(*groups).agg(F.sum(useful).alias("useful"), F.sum(tokens).alias("tokens"))
    return sums.withColumn("per_1000", F.when(F.col("tokens") > 0, F.col("useful") * 1000 / F.col("tokens")).otherwise(0.0))


def conditional_mean(results: DataFrame, value: str, size: str, least: int, *groups: str) -> DataFrame:
    """``groups, value, n``: the mean over the results whose ``size`` is at least so large (small packets are mostly frame)."""
    big = F.when(F.col(size) >= least, F.col(value))
    return results.groupBy(*groups).agg(F.avg(big).alias(value), F.count(big).alias("n"))


def gates(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, status``: ``wire_tokens`` more than a tenth above the baseline fail, ``millis`` more than a fifth above warn.

    Rows of one side only fail the comparison.
    """
    b = baseline.select(*keys, F.col("wire_tokens").alias("b_wire"), F.col("millis").alias("b_millis"))
    c = candidate.select(*keys, F.col("wire_tokens").alias("c_wire"), F.col("millis").alias("c_millis"))
    both = b.join(c, keys, "full_outer")
    status = (
        F.when(F.col("b_wire").isNull(), "missing_baseline").when(F.col("c_wire").isNull(), "missing_candidate")
        .when(F.col("c_wire") > F.col("b_wire") * (1 + WIRE_GATE), "wire_regressed").when(F.col("c_millis") > F.col("b_millis") * (1 + TIME_WARNING), "time_warning").otherwise("ok")
    )
    return both.withColumn("status", status)


def resent(first: DataFrame, second: DataFrame, *groups: str) -> DataFrame:
    """``groups, known, resent, delta_ratio``: handles of the first packet, those that the second sends again, and its size against the first's."""
    a = first.groupBy(*groups).agg(F.count(F.lit(1)).alias("known"), F.sum("tokens").alias("a_tokens"))
    b = second.groupBy(*groups).agg(F.sum("tokens").alias("b_tokens"))
    again = second.join(first.select(*groups, "handle"), [*groups, "handle"], "left_semi").groupBy(*groups).agg(F.count(F.lit(1)).alias("resent"))
    out = a.join(b, list(groups), "left").join(again, list(groups), "left")
    return out.select(*groups, "known", F.coalesce("resent", F.lit(0)).alias("resent"), F.when(F.col("a_tokens") > 0, F.coalesce("b_tokens", F.lit(0)) / F.col("a_tokens")).otherwise(0.0).alias("delta_ratio"))


def nondeterministic(first: DataFrame, second: DataFrame, *groups: str) -> DataFrame:
    """Groups whose rows differ between two runs, by a hash of all columns that doesn't depend on their order."""
    columns = sorted(set(first.columns) - set(groups))
    digest = lambda df, name: df.groupBy(*groups).agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    both = digest(first, "a").join(digest(second, "b"), list(groups), "full_outer")
    return both.filter(~(F.col("a").eqNullSafe(F.col("b")) & F.col("n_a").eqNullSafe(F.col("n_b")))).select(*groups)


def suite_problems(cases: DataFrame) -> DataFrame:
    """``case_id, problem`` of cases ``case_id, required, forbidden, roles`` (arrays of paths and of roles)."""
    roles = ("target", "implementation", "definition", "declaration", "type", "caller", "callee", "test", "import", "export", "reference", "dependent", "change", "config", "template", "documentation", "context")
    every = F.concat("required", "forbidden")
    escapes = F.exists(every, lambda p: p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)") | p.rlike(r"^[A-Za-z]:") | p.contains("\\") | (p == ""))
    found = F.array(
        F.when(escapes, "path_not_relative"), F.when(F.arrays_overlap("required", "forbidden"), "required_and_forbidden"),
        F.when(F.exists("roles", lambda r: ~r.isin(*roles)), "unknown_role"), F.when(F.size("required") == 0, "nothing_required"),
    )
    return cases.select("case_id", F.explode(F.array_compact(found)).alias("problem"))


#: Distinct paths and names that are broadcast.
FEW_NAMES = 100_000


def anchor_lookup(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """``case_id, handle, status``: the one symbol with a path, a name and, if given, a kind; ``missing`` or ``ambiguous`` otherwise.

    Cases meet one row for each path, name and kind, which says whether it is one symbol, so a name that very many symbols
    have costs a case no more than any other. Cases that repeat have all their rows' symbols.
    """
    w = wanted.select("case_id", "path", "name", F.col("kind").alias("want_kind"))
    asked = travelling(stored(w.select("path", "name").distinct()), FEW_NAMES)
    s = stored(symbols.select("path", "name", "kind", "handle").join(asked, ["path", "name"], "left_semi").groupBy("path", "name", "kind").agg(F.min("handle").alias("lo"), F.max("handle").alias("hi")))
    any_kind = s.groupBy("path", "name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("path", "name", F.lit(None).cast("string").alias("want_kind"), "lo", "hi")
    of_kind = s.filter("kind is not null").select("path", "name", F.col("kind").alias("want_kind"), "lo", "hi")
    each = stored(any_kind.unionByName(of_kind))
    # numbers stand for the handles: they are compared without sorting the cases
    number = stored(each.filter("lo = hi").select(F.col("lo").alias("handle")).distinct().withColumn("number", F.monotonically_increasing_id()))
    numbered = each.join(number, (F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("handle")), "left").select("path", "name", F.col("want_kind").alias("kind"), "number", (F.col("lo") < F.col("hi")).alias("many"))
    targets = travelling(stored(numbered), FEW_NAMES)
    met = w.join(targets, (w["path"] == targets["path"]) & (w["name"] == targets["name"]) & w["want_kind"].eqNullSafe(targets["kind"]), "left")
    n = met.groupBy("case_id").agg(F.min("number").alias("number"), F.max("number").alias("last"), F.max(F.coalesce("many", F.lit(False))).alias("many"))
    status = F.when(F.col("many") | (F.col("number") < F.col("last")), "ambiguous").when(F.col("number").isNull(), "missing").otherwise("found")
    judged = n.select("case_id", status.alias("status"), F.when(status == "found", F.col("number")).alias("number"))
    return judged.join(travelling(number, FEW_NAMES), "number", "left").select("case_id", "handle", "status")


def freshness(indexed: DataFrame, now: DataFrame) -> DataFrame:
    """``path, state`` of indexed files that differ from the working tree: ``changed`` or ``missing``; others are fresh."""
    both = indexed.select("path", F.col("sha256").alias("old")).join(now.select("path", F.col("sha256").alias("new")), "path", "left")
    return both.filter(F.col("new").isNull() | (F.col("new") != F.col("old"))).select("path", F.when(F.col("new").isNull(), "missing").otherwise("changed").alias("state"))


def presentation(items: DataFrame, order: dict[str, int]) -> DataFrame:
    """Items with ``shown``: by the priority of their role, then by position; unknown roles come last."""
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("role")), F.lit(len(order)))
    return items.withColumn("shown", F.row_number().over(Window.partitionBy("case_id", "profile").orderBy(place, "position")).cast("long"))
