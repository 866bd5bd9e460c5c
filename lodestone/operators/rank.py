"""Fusion of ranked lists, re-ranking with named reasons, and de-duplication."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import is_documentation, is_outline, is_reference_kind, is_test

from .search import FUSED_LIMIT

#: Retriever weights and the constant of reciprocal-rank fusion.
WEIGHTS = {"qualified": 2.00, "symbol": 1.80, "relation": 1.60, "prefix": 1.20, "fts": 1.00, "path": 0.90}
RRF_K = 60
#: Weights of reasons, and of a relation under each intent.
FUSION, EXACT, PREFIX, NATURAL_PREFIX, LEXICAL, LEXICAL_MAX, PATH, PATH_MAX = 1000, 100, 70, 24, 8, 40, 4, 20
CHANGED, TEST, NON_TEST, DOCUMENTATION, REFERENCE_KIND, LARGE_SPAN, LARGE_TOKENS = 15, 15, -60, -40, 280, -10, 4000
RELATION_WEIGHTS = {
    "definition": {"callers": 30, "callees": 30, "tests": 40, "imports": 40, "exports": 40, "references": 40},
    "callers": {"callers": 500, "tests": 180, "callees": 60, "imports": 40, "exports": 40, "references": 60},
    "callees": {"callees": 500, "callers": 60, "tests": 60, "imports": 40, "exports": 40, "references": 60},
    "tests": {"tests": 500, "callers": 160, "callees": 60, "imports": 40, "exports": 40, "references": 60},
    "imports": {"imports": 500, "exports": 420, "callers": 60, "callees": 40, "tests": 40, "references": 60},
    "exports": {"exports": 500, "imports": 420, "callers": 40, "callees": 40, "tests": 40, "references": 60},
    "references": {"references": 500, "callers": 60, "callees": 60, "tests": 60, "imports": 40, "exports": 40},
    "impact": {"callers": 400, "tests": 400, "references": 400, "callees": 160, "imports": 120, "exports": 120},
}


def retriever_weight() -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), F.col("retriever"))


def fuse(lists: DataFrame, key: str = "handle", limit: int = FUSED_LIMIT, order: tuple = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, key, fused, hits, position`` of ``query_id, retriever, rank, key``; every contribution counts.

    ``carry`` names columns that depend on the key, kept for ``order``, which decides between equal scores and counts.

    Scores are sums of scaled integers, so that their order does not depend on the order of addition.
    """
    part = F.floor(retriever_weight() / (RRF_K + F.col("rank")) * 1e9 + 0.5).cast("long")
    summed = lists.groupBy("query_id", key).agg(F.sum(part).alias("fused"), F.count(F.lit(1)).alias("hits"), *[F.max(c).alias(c) for c in carry])
    place = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.desc("hits"), *order, key)
    return summed.withColumn("position", F.row_number().over(place).cast("long")).filter(F.col("position") <= limit)


def matched(text: Column, terms: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def symbol_reason(symbol: Column, signature: Column, terms: Column, identifiers: Column) -> tuple[Column, Column]:
    """Weights of symbol-exact and symbol-prefix; the first term in word order that triggers the latter sets it."""
    long = F.filter(terms, lambda t: F.length(t) >= 3)
    is_id = lambda t: F.array_contains(identifiers, t)
    exact = F.exists(long, lambda t: (symbol == t) & is_id(t))
    holds = lambda t: F.contains(symbol, t) | ((F.length(t) > 3) & t.endswith("s") & (symbol == F.substring(t, F.lit(1), F.length(t) - 1)))
    near = F.filter(long, lambda t: ~((symbol == t) & is_id(t)) & (symbol != "") & (is_id(t) | (signature != "")) & holds(t))
    first = F.get(near, F.lit(0))
    return F.when(exact, EXACT), F.when(first.isNotNull(), F.when(is_id(first), PREFIX).otherwise(NATURAL_PREFIX))


def reasons(c: dict[str, Column]) -> list[tuple[str | Column, Column]]:
    """Named weights in the order in which they are reported; null where a reason doesn't apply.

    ``c``: symbol, signature, path, content, kind, language, terms, identifiers, fused (0 to 1), changed, relation, intent,
    tokens, test_intent, reference_intent.
    """
    doc = is_documentation(c["kind"], c["language"])
    exact, prefix = symbol_reason(F.lower(c["symbol"]), c["signature"], c["terms"], c["identifiers"])
    on_path = matched(F.lower(c["path"]), c["terms"])
    lexical = matched(F.lower(F.concat_ws(" ", c["content"], c["signature"], c["path"])), c["terms"])
    pairs = [F.lit(x) for intent, ws in RELATION_WEIGHTS.items() for relation, w in ws.items() for x in (f"{intent}/{relation}", w)]
    relation = F.try_element_at(F.create_map(*pairs), F.concat_ws("/", c["intent"], c["relation"]))
    testish = (c["kind"] == "test") | c["symbol"].startswith("Test")
    return [
        ("retrieval-fusion", F.when(c["fused"] > 0, c["fused"] * FUSION)),
        ("symbol-exact", F.when(~doc, exact)),
        ("symbol-prefix", F.when(~doc, prefix)),
        ("path", F.when(on_path > 0, F.least(on_path * PATH, F.lit(PATH_MAX)))),
        ("lexical", F.when(lexical > 0, F.least(lexical * LEXICAL, F.lit(LEXICAL_MAX)))),
        ("test-pair", F.when(c["test_intent"] & testish, TEST)),
        ("test-context-penalty", F.when(~c["test_intent"] & is_test(c["kind"], c["symbol"], c["path"]), NON_TEST)),
        ("changed-file", F.when(c["changed"], CHANGED)),
        ("documentation-penalty", F.when(doc, DOCUMENTATION)),
        (F.concat(F.lit("relation-"), c["relation"]), F.when(relation > 0, relation)),
        ("reference-kind", F.when(c["reference_intent"] & is_reference_kind(c["kind"]), REFERENCE_KIND)),
        ("large-span", F.when(c["tokens"] > LARGE_TOKENS, LARGE_SPAN)),
    ]


def with_score(rows: DataFrame, c: dict[str, Column]) -> DataFrame:
    """Adds ``reasons`` (code, weight) and ``score``."""
    named = reasons(c)
    each = F.array(*[F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), w.cast("double").alias("weight")) for code, w in named])
    kept = rows.withColumn("reasons", F.filter(each, lambda x: x["weight"].isNotNull()))
    return kept.withColumn("score", F.aggregate("reasons", F.lit(0.0), lambda s, x: s + x["weight"]))


def ranked_order() -> tuple:
    """Score, confidence, short spans, path, line, handle; null confidence counts as 0."""
    return (F.desc("score"), F.desc(F.coalesce("confidence", F.lit(0.0))), F.col("end_line") - F.col("start_line"), F.col("path"), F.col("start_line"), F.col("handle"))


def fused_order() -> tuple:
    """What decides between candidates of equal fused score and as many lists, before the handle."""
    return ranked_order()[1:-1]


def final_rank(rows: DataFrame, limit: int | None = None, changed_first: bool = False) -> DataFrame:
    """Adds ``position`` by ``ranked_order`` (changed candidates before all others, if asked for), cut at ``limit``."""
    order = ((F.desc("changed"),) if changed_first else ()) + ranked_order()
    out = rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
    return out.filter(F.col("position") <= limit) if limit else out


def drop_outlines(rows: DataFrame) -> DataFrame:
    """Without outlines of paths that have a specific candidate, unless by relation or exact symbol."""
    specific = F.bool_or(~is_outline(F.col("kind"))).over(Window.partitionBy("query_id", "path"))
    own = F.exists("reasons", lambda x: x["code"] == "symbol-exact") | F.coalesce(F.col("relation") != "", F.lit(False))
    return rows.withColumn("specific", specific).filter(~(is_outline(F.col("kind")) & F.col("specific") & ~own)).drop("specific")


def first_of_content(rows: DataFrame, *order) -> DataFrame:
    """One candidate for each path and content hash; an empty hash never repeats."""
    place = F.row_number().over(Window.partitionBy("query_id", "path", "content_hash").orderBy(*order))
    return rows.withColumn("nth", place).filter((F.col("nth") == 1) | (F.col("content_hash") == "")).drop("nth")


def without_contained(rows: DataFrame) -> DataFrame:
    """Greedy: a candidate whose span holds, or lies in, that of an accepted one of its path goes.

    Order-dependent, so one question's candidates (the windows of at most the fused cap of files) are taken together.
    """

    def accept(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        spans: dict[str, list[tuple[int, int]]] = {}
        keep = []
        for path, a, b in zip(pdf["path"], pdf["start_line"], pdf["end_line"]):
            real = a > 0 and b >= a
            clash = real and any((x <= a and y >= b) or (a <= x and b >= y) for x, y in spans.get(path, ()))
            keep.append(not clash)
            if not clash and real:
                spans.setdefault(path, []).append((a, b))
        return pdf[keep]

    return rows.groupBy("query_id").applyInPandas(accept, rows.schema)
