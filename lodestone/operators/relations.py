"""Relation hits with provenance: resolved edges, and those that only name their target, for any number of anchors at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import fold_name, languages_compatible
from lodestone.sources.store import stored

#: The ten relations, as (edge kind, resolved incoming, resolved outgoing, how edges name their targets).
RELATIONS = {
    "callers": ("calls", True, False, "call"), "callees": ("calls", False, True, "call"), "tests": ("tests", True, True, "call"),
    "imports": ("imports", True, True, "import"), "exports": ("exports", True, True, "import"), "references": ("references", True, True, "import"),
    "parent": ("contains", True, False, None), "children": ("contains", False, True, None), "neighbors": (None, True, True, None), "self": (None, False, False, None),
}
SEPARATORS = r"\.|::|->"


def supported(relation: str) -> bool:
    return relation in RELATIONS


def tails(target: Column) -> Column:
    """What follows each separator of a target (``.``, ``::``, ``->``)."""
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(target), F.lit(1))), lambda i: F.substring(target, i, F.lit(1)).isin(".", ":", ">"))
    whole = lambda i: (F.substring(target, i, F.lit(1)) == ".") | F.substring(target, i - 1, F.lit(2)).isin("::", "->")
    return F.transform(F.filter(ends, whole), lambda i: F.substring(target, i + 1, F.length(target)))


def middles(target: Column) -> Column:
    """Segments of a target with ``.`` on both sides, or ``::`` on both sides."""
    inner = lambda parts: F.when(F.size(parts) > 2, F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.concat(inner(F.split(target, r"\.")), inner(F.split(target, "::")))


def typed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("t"), v.alias("k")))


def edge_keys(how: str, target: Column) -> Column:
    """Equi-join keys of what an edge names; lower case, so that names which differ by case only meet and are told apart later."""
    low = F.lower(target)
    whole, parts = F.array(low), tails(low) if how == "call" else F.concat(F.filter(tails(low), lambda x: F.concat(F.lit("."), x) == F.substring(low, F.length(low) - F.length(x), F.length(x) + 1)), middles(low))
    return F.array_distinct(F.filter(F.concat(typed("whole", whole), typed("part", parts)), lambda x: x["k"] != ""))


def symbol_keys(how: str) -> Column:
    """Keys of a symbol that edges may name: name and qualified name; for imports also its path and the path's suffixes."""
    name, qualified = F.lower("name"), F.lower("qualified_name")
    whole = F.array(name, qualified)
    if how == "import":
        parts = F.split(F.lower("path"), "/")
        whole = F.concat(whole, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    return F.array_distinct(F.concat(typed("whole", whole), typed("part", F.array(name))))


def named(how: str, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``edges`` (with ``unresolved_to, kind, from_language``) joined with the ``targets`` that they name.

    targets: ``target, name, qualified_name, path, target_language, target_kind``.
    """
    e = edges.withColumn("key", F.explode(edge_keys(how, F.col("unresolved_to"))))
    t = targets.withColumn("key", F.explode(symbol_keys(how)))
    met = e.join(t, "key")
    if how == "call":
        fold = lambda c: fold_name(F.col("target_language"), F.col("target_kind"), c)
        u, name = fold(F.col("unresolved_to")), fold(F.col("name"))
        ends = F.lit(False)
        for sep in (".", "::", "->"):
            ends |= u.endswith(F.concat(F.lit(sep), name))
        met = met.filter(((u == name) | (u == fold(F.col("qualified_name"))) | ends) & languages_compatible(F.col("from_language"), F.col("target_language"), F.col("kind")))
    return met.drop("key", "name", "qualified_name", "path", "target_language", "target_kind")


def hits(anchors: DataFrame, relations: DataFrame, symbols: DataFrame, relation: str) -> DataFrame:
    """``query_id, anchor_handle, handle, relation, direction, confidence, resolved``: one hop from each question's anchors.

    anchors: ``query_id, anchor_handle``; relations: ``from_handle, to_handle, unresolved_to, kind, confidence``, where linked
    edges have their target. An edge without one is met through the keys of the name that it has, both ways.
    """
    shape = lambda df, handle, direction, resolved: df.select("query_id", "anchor_handle", F.col(handle).alias("handle"), F.lit(relation).alias("relation"), F.lit(direction).alias("direction"), "confidence", F.lit(resolved).alias("resolved"))
    if relation not in RELATIONS:
        return shape(anchors.withColumn("confidence", F.lit(0.0)), "anchor_handle", "related", True).limit(0)
    kind, incoming, outgoing, how = RELATIONS[relation]
    if relation == "self":
        return shape(anchors.withColumn("confidence", F.lit(1.0)), "anchor_handle", "related", True).distinct()
    own = relations.filter(F.col("kind") == kind) if kind else relations
    done = own.filter("to_handle is not null")
    out = []
    if incoming:
        out.append(shape(anchors.join(done, F.col("anchor_handle") == F.col("to_handle")), "from_handle", "incoming", True))
    if outgoing:
        out.append(shape(anchors.join(done, F.col("anchor_handle") == F.col("from_handle")), "to_handle", "outgoing", True))
    if how:
        open_edges = own.filter("to_handle is null and unresolved_to is not null")
        origin = symbols.select(F.col("handle").alias("from_handle"), F.col("language").alias("from_language"))
        target = symbols.select(F.col("handle").alias("target"), "name", "qualified_name", "path", F.col("language").alias("target_language"), F.col("kind").alias("target_kind"))
        if incoming:
            asked = target.join(anchors.select(F.col("anchor_handle").alias("target")).distinct(), "target", "left_semi")
            met = named(how, open_edges.join(origin, "from_handle"), asked).select(F.col("target").alias("anchor_handle"), "from_handle", "confidence")
            out.append(shape(anchors.join(met, "anchor_handle"), "from_handle", "incoming", False))
        if outgoing:
            mine = open_edges.join(anchors.select(F.col("anchor_handle").alias("from_handle")).distinct(), "from_handle", "left_semi").join(origin, "from_handle")
            met = named(how, mine, target).select(F.col("from_handle").alias("anchor_handle"), "target", "confidence")
            out.append(shape(anchors.join(met, "anchor_handle"), "target", "outgoing", False))
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    return both.distinct()


def lexical_callers(anchors: DataFrame, relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """``anchor_handle, callers, confidence``: how many handles have an unlinked call that names each anchor, as ``hits`` finds
    them, and the highest confidence.

    Distinct targets meet distinct names, and the edges of a name are counted once for all symbols that have it. A qualified
    name that ends in the symbol's name adds nothing to what the name finds, so it makes no name of its own.
    """
    kind, _, _, how = RELATIONS["callers"]
    origin = symbols.select(F.col("handle").alias("from_handle"), F.col("language").alias("from_language"))
    own = relations.filter((F.col("kind") == kind) & F.col("to_handle").isNull() & F.col("unresolved_to").isNotNull())
    edges = own.join(origin, "from_handle").select("from_handle", "from_language", "unresolved_to", "kind", "confidence")
    parts = ("name", "qualified_name", "target_language", "target_kind")
    name, qualified = (fold_name(F.col("language"), F.col("kind"), F.col(c)) for c in ("name", "qualified_name"))
    within = (qualified == name) | qualified.endswith(F.concat(F.lit("."), name)) | qualified.endswith(F.concat(F.lit("::"), name)) | qualified.endswith(F.concat(F.lit("->"), name))
    asked = symbols.join(anchors.select(F.col("anchor_handle").alias("handle")).distinct(), "handle", "left_semi")
    named_as = asked.select(F.col("handle").alias("anchor_handle"), "name", F.when(within, F.col("name")).otherwise(F.col("qualified_name")).alias("qualified_name"), F.col("language").alias("target_language"), F.col("kind").alias("target_kind"))
    names = stored(named_as.select(*parts).distinct().withColumn("target", F.monotonically_increasing_id()))
    targets = edges.select("unresolved_to", "from_language", "kind").distinct()
    met = stored(named(how, targets, names.withColumn("path", F.lit(""))).select("target", "unresolved_to", "from_language").distinct())
    same = F.lit(True)
    for c in parts:
        same &= named_as[c].eqNullSafe(names[c])
    # a handle that repeats under several names has the edges of all of them
    several = stored(named_as.join(names, same).groupBy("anchor_handle").agg(F.sort_array(F.collect_set("target")).alias("targets")))
    groups = several.select("targets").distinct().select("targets", F.explode("targets").alias("target"))
    counted = groups.join(met, "target").select("targets", "unresolved_to", "from_language").distinct().join(edges, ["unresolved_to", "from_language"])
    counts = counted.groupBy("targets").agg(F.countDistinct("from_handle").alias("callers"), F.max("confidence").alias("confidence"))
    return several.join(counts, "targets").select("anchor_handle", "callers", "confidence")


def strongest(found: DataFrame, *keys: str) -> DataFrame:
    """One context for each of ``keys``: resolved before lexical, the higher confidence, a direction before none, then by name."""
    order = F.struct(
        (~F.col("resolved")).alias("a"), (-F.col("confidence")).alias("b"), (F.col("direction") == "related").alias("c"), F.col("direction").alias("d"), F.col("relation").alias("e"), F.col("anchor_handle").alias("f"),
    )
    best = found.groupBy(*keys).agg(F.min(order).alias("o"))
    return best.select(*keys, F.col("o.e").alias("relation"), F.col("o.d").alias("direction"), F.col("o.f").alias("anchor_handle"), (-F.col("o.b")).alias("confidence"), (~F.col("o.a")).alias("resolved"))


def hit_order(found: DataFrame) -> DataFrame:
    """Adds ``place``: hits of a question by kind, confidence, path, line, handle, anchor, direction, resolved first."""
    order = ("relation", F.desc("confidence"), "path", "start_line", "handle", "anchor_handle", "direction", F.desc("resolved"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))


def without_shadowed(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of a symbol that has a template outline give way to it; ``found`` has ``handle`` of symbols, chunks ``symbol_handle, kind``."""
    outlines = chunks.filter("kind = 'template-outline'").select("symbol_handle").distinct()
    own = found.join(chunks, F.col("handle") == F.col("symbol_handle"))
    return own.filter("kind = 'template-outline'").unionByName(own.filter("kind <> 'template-outline'").join(outlines, "symbol_handle", "left_anti").select(*own.columns))


def linked(relations: DataFrame, links: DataFrame) -> DataFrame:
    """The relations with the targets that linking found: ``links`` as ``graph.link`` returns them."""
    found = links.select("from_handle", "kind", "unresolved_to", F.col("to_handle").alias("found")).distinct()
    open_edges = relations.filter("to_handle is null").join(found, ["from_handle", "kind", "unresolved_to"], "left")
    now = open_edges.select("from_handle", F.col("found").alias("to_handle"), "unresolved_to", "kind", "confidence")
    return relations.filter("to_handle is not null").select(*now.columns).unionByName(now)
