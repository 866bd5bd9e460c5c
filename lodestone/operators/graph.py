"""The edge list: linking by name, one-hop expansion, impact, closure, scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import fold_name, languages_compatible
from lodestone.sources.store import stored

#: Relations an anchor can be expanded by, as (edge kind, direction).
EXPANSIONS = {"callers": ("calls", "incoming"), "callees": ("calls", "outgoing"), "tests": ("tests", "incoming"), "imports": ("imports", "both"), "exports": ("exports", "both"), "references": ("references", "incoming"), "parent": ("contains", "incoming"), "children": ("contains", "outgoing"), "neighbors": (None, "both")}
IMPACT = ("tests", "calls", "imports", "exports", "references")
QUALIFIED, NAME = 0, 1


def link(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """``from_handle, kind, unresolved_to, confidence, to_handle, tier`` of the edges that have exactly one best target.

    Candidates meet the distinct (target, language, kind) combinations on the folded name, so a target that a third of all
    edges name is resolved once. The best tier (qualified before plain name) must hold one symbol only.
    """
    edges = relations.filter("to_handle is null and unresolved_to is not null").select("from_handle", "kind", "unresolved_to", "confidence")
    wanted = edges.join(symbols.select(F.col("handle").alias("from_handle"), F.col("language").alias("from_language")), "from_handle")
    asked = wanted.select("unresolved_to", "from_language", "kind").distinct()
    named = symbols.select(F.col("handle").alias("to_handle"), F.col("language").alias("to_language"), F.col("kind").alias("to_kind"), F.explode(F.array(
        F.struct(F.lit(QUALIFIED).alias("tier"), F.col("qualified_name").alias("target")), F.struct(F.lit(NAME).alias("tier"), F.col("name").alias("target")))).alias("n")).select("to_handle", "to_language", "to_kind", "n.tier", "n.target")
    named = named.withColumn("key", F.lower("target"))
    met = asked.withColumn("key", F.lower("unresolved_to")).join(named, "key")
    fits = languages_compatible(F.col("from_language"), F.col("to_language"), F.col("kind")) & (
        fold_name(F.col("to_language"), F.col("to_kind"), F.col("target")) == fold_name(F.col("to_language"), F.col("to_kind"), F.col("unresolved_to"))
    )
    per_tier = met.filter(fits).groupBy("unresolved_to", "from_language", "kind", "tier").agg(F.min("to_handle").alias("to_handle"), F.max("to_handle").alias("last"))
    best = per_tier.groupBy("unresolved_to", "from_language", "kind").agg(F.min_by(F.struct("to_handle", "last", "tier"), "tier").alias("b"))
    unique = best.filter("b.to_handle = b.last").select("unresolved_to", "from_language", "kind", F.col("b.to_handle").alias("to_handle"), F.col("b.tier").cast("long").alias("tier"))
    return wanted.join(unique, ["unresolved_to", "from_language", "kind"]).select("from_handle", "kind", "unresolved_to", "confidence", "to_handle", "tier")


def resolved(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct edges with a target: those stored, and those linked; confidence is the largest of equal edges."""
    both = relations.filter("to_handle is not null").select("from_handle", "to_handle", "kind", "confidence").unionByName(link(relations, symbols).select("from_handle", "to_handle", "kind", "confidence"))
    return both.groupBy("from_handle", "to_handle", "kind").agg(F.max("confidence").alias("confidence"))


def expand(anchors: DataFrame, edges: DataFrame, relation: str) -> DataFrame:
    """``anchor_handle, handle, direction, confidence``: one hop from ``anchors(anchor_handle)`` by a relation."""
    if relation == "self":
        return anchors.select("anchor_handle", F.col("anchor_handle").alias("handle"), F.lit("related").alias("direction"), F.lit(1.0).alias("confidence"))
    if relation not in EXPANSIONS:
        return expand(anchors, edges, "self").limit(0)
    kind, direction = EXPANSIONS[relation]
    own = edges.filter(F.col("kind") == kind) if kind else edges
    out = []
    if direction in ("incoming", "both"):
        out.append(anchors.join(own, F.col("anchor_handle") == F.col("to_handle")).select("anchor_handle", F.col("from_handle").alias("handle"), F.lit("incoming").alias("direction"), "confidence"))
    if direction in ("outgoing", "both"):
        out.append(anchors.join(own, F.col("anchor_handle") == F.col("from_handle")).select("anchor_handle", F.col("to_handle").alias("handle"), F.lit("outgoing").alias("direction"), "confidence"))
    both = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return both.distinct()


def impact(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """``handle, kind, anchor_handle, confidence``: one incoming hop from ``changed(handle)``, the strongest reason of each."""
    anchors = changed.select(F.col("handle").alias("anchor_handle")).distinct()
    hops = anchors.join(edges.filter(F.col("kind").isin(*IMPACT)), F.col("anchor_handle") == F.col("to_handle")).select(F.col("from_handle").alias("handle"), "kind", "anchor_handle", "confidence")
    # the least of each handle, combined before the shuffle: a handle may be met through very many anchors
    best = hops.groupBy("handle").agg(F.min(F.struct((F.col("kind") != "tests").alias("later"), (-F.col("confidence")).alias("unsure"), "anchor_handle", "kind")).alias("b"))
    found = best.select("handle", "b.kind", "b.anchor_handle", (-F.col("b.unsure")).alias("confidence"))
    return found.join(anchors.select(F.col("anchor_handle").alias("handle")), "handle", "left_anti")


def incoming_closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Every ``node`` from which a seed can be reached (seeds included), by rounds of new nodes only; cycles end.

    The edges are written once; each round reads them and writes its new nodes.
    """
    back = stored(edges.select(F.col("from_handle").alias("next"), F.col("to_handle").alias("node")).distinct())
    reach = front = stored(seeds.select("node").distinct())
    while True:
        front = stored(back.join(front, "node").select(F.col("next").alias("node")).distinct().join(reach, "node", "left_anti"))
        if front.isEmpty():
            return reach
        reach = reach.union(front)


def ancestors(symbols: DataFrame) -> DataFrame:
    """``handle, level, ancestor``: all enclosing scopes, the nearest at level 1, however deep they are.

    Levels double: what is known up to level n is joined with itself, so a scope at depth d takes log d rounds, each written
    to the shared folder. A parent that is its own ancestor ends where it comes back to itself.
    """
    known = stored(symbols.filter("parent_handle is not null").select("handle", F.lit(1).alias("level"), F.col("parent_handle").alias("ancestor")))
    reach = 1
    while True:
        far = known.filter(F.col("level") == reach).select("handle", F.col("ancestor").alias("at"))
        on = known.select(F.col("handle").alias("at"), F.col("level").alias("more"), F.col("ancestor").alias("above"))
        found = far.join(on, "at").filter("above <> handle").select("handle", (F.lit(reach) + F.col("more")).alias("level"), F.col("above").alias("ancestor"))
        found = stored(found.groupBy("handle", "ancestor").agg(F.min("level").alias("level")).join(known, ["handle", "ancestor"], "left_anti").select("handle", "level", "ancestor"))
        if found.isEmpty():
            return known
        known = known.union(found)
        reach *= 2
