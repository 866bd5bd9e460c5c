"""Retrievers over symbols and files. All take a table of questions, so that one job answers a batch of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import is_outline
from lodestone.sources.store import stored, travelling

#: Caps of the retrievers' lists and of the fused list.
SYMBOL_LIMIT, PATH_LIMIT, TEXT_LIMIT, FUSED_LIMIT = 50, 50, 100, 400
#: BM25's parameters, and the least idf.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TOKEN = r"[\p{L}\p{N}]+"
#: Asked terms that are broadcast.
FEW_TERMS = 10_000
#: Distinct values of symbols that are broadcast.
FEW_VALUES = 100_000


def ranked(rows: DataFrame, limit: int, *order) -> DataFrame:
    """The first ``limit`` rows of each question, numbered from 1; the window's rank limit is pushed below the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= limit)


def symbol_order():
    return (F.col("value_pos"), is_outline(F.col("kind")), F.desc("confidence"), F.col("end_line") - F.col("start_line"), F.col("path"), F.col("start_line"), F.col("handle"))


def once(hits: DataFrame) -> DataFrame:
    """A symbol found through several values counts for the first."""
    first = Window.partitionBy("query_id", "handle").orderBy("value_pos", "tier")
    return hits.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def per_value(values: DataFrame, symbols: DataFrame, meets, tier, limit: int) -> DataFrame:
    """The first ``limit`` symbols of each question, for values with their key ``k``; symbols meet keys by ``meets``.

    Symbols are ranked once per distinct key, however many questions ask for it. The first ``limit`` of a key are enough: a
    question passes over no more of them than it has from earlier values.
    """
    hits = travelling(values.select("k").distinct(), FEW_VALUES).join(symbols, meets).withColumn("tier", tier)
    order = (F.col("tier"), *symbol_order()[1:])
    nth = F.row_number().over(Window.partitionBy("k", "handle").orderBy(*order))
    one = hits.withColumn("nth", nth).filter("nth = 1").drop("nth")
    best = one.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(*order))).filter(F.col("place") <= limit)
    # one shuffle serves both windows, of a question's symbols and of a question
    found = values.join(best.select("k", "tier", "place", *symbols.columns), "k").drop("k").repartition("query_id")
    return ranked(once(found), limit, "value_pos", "place").drop("place")


def exact(symbols: DataFrame, values: DataFrame, limit: int = SYMBOL_LIMIT) -> DataFrame:
    """values: ``query_id, value_pos, value``. Names equal without case."""
    return per_value(values.withColumn("k", F.lower("value")), symbols, F.col("k") == F.lower("name"), F.lit(0), limit)


def qualified(symbols: DataFrame, values: DataFrame, limit: int = SYMBOL_LIMIT) -> DataFrame:
    """Qualified names; a hit with the same case suppresses those without, value by value."""
    hits = values.join(symbols, F.lower("value") == F.lower("qualified_name")).withColumn("tier", F.when(F.col("value") == F.col("qualified_name"), 0).otherwise(1))
    best = hits.withColumn("best", F.min("tier").over(Window.partitionBy("query_id", "value_pos"))).filter("tier = best").drop("best")
    return ranked(once(best), limit, *symbol_order())


def prefix(symbols: DataFrame, values: DataFrame, limit: int = SYMBOL_LIMIT) -> DataFrame:
    """Names or qualified names that begin with a value.

    A symbol's keys are the beginnings of its names of just those lengths that some value has (a short list, read first), so
    both sides meet on whole values: no pair is lost, and none is compared that doesn't match.
    """
    v = values.withColumn("k", F.lower("value")).filter("k <> ''")
    sizes = sorted(r[0] for r in v.select(F.length("k")).distinct().collect())  # names are short: some dozens at most
    low = (F.lower("name"), F.lower("qualified_name"))
    keys = F.array(*[F.when(F.length(c) >= n, F.substring(c, 1, n)) for n in sizes for c in low]) if sizes else F.array().cast("array<string>")
    s = symbols.withColumn("own_k", F.explode(F.array_distinct(F.array_compact(keys))))
    return per_value(v, s, F.col("k") == F.col("own_k"), F.when(F.lower("name") == F.col("k"), 0).otherwise(1), limit).drop("own_k")


def path(files: DataFrame, hints: DataFrame, limit: int = PATH_LIMIT) -> DataFrame:
    """Paths equal to a hint, ending in it, below it, or holding it, in that order; hints: ``query_id, value``.

    Hints share their first trigram with every path that holds them (shorter ones are a gram themselves): that is the join
    key, and a path has only grams of the lengths that hints have.
    """
    size = F.least(F.length("value"), F.lit(3))
    h = hints.withColumn("low", F.lower("value")).filter("value <> ''").withColumn("n", size).withColumn("k", F.substring(F.col("low"), F.lit(1), F.col("n")))
    sizes = sorted(r[0] for r in h.select("n").distinct().collect())  # 1 to 3
    f = files.select("path", F.lower("path").alias("p"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("p") - (n - 1), F.lit(1))), lambda i: F.substring(F.col("p"), i, F.lit(n)))
    keys = F.array_distinct(F.concat(*[grams(n) for n in sizes])) if sizes else F.array().cast("array<string>")
    hits = h.join(f.withColumn("k", F.explode(keys)), "k").filter(F.col("p").contains(F.col("low")))
    place = F.when(F.col("p") == F.col("low"), 0).when(F.col("p").endswith(F.concat(F.lit("/"), "low")), 1).when(F.col("p").startswith(F.concat("low", F.lit("/"))), 2).otherwise(3)
    best = hits.groupBy("query_id", "path").agg(F.min(place).alias("place"))
    return ranked(best, limit, "place", "path")


def bm25(files: DataFrame, terms: DataFrame, limit: int = TEXT_LIMIT, key: str = "path", text: str = "content") -> DataFrame:
    """``query_id, key, score, rank``; terms: ``query_id, term`` in lower case, distinct.

    The texts are read once. Where the asked terms are few enough to travel (checked), tokens meet them right where they are
    exploded, before anything is shuffled. Every document also has one row for the empty term, which carries its length into
    the corpus statistics.
    """
    asked = terms.select("term").distinct()
    few = asked.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    wanted = asked.union(asked.sparkSession.createDataFrame([("",)], "term string"))
    tokens = files.select(key, F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)).alias("tokens"))
    each = tokens.select(key, F.size("tokens").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("term"))
    rows = each.join(F.broadcast(wanted) if few else wanted, "term", "left_semi").groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    found = stored(rows)
    whole = found.filter("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).first()
    n, mean = whole["n"], whole["mean"] or 0.0
    found = found.filter("term <> ''")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = found.join(df.select("term", F.when(idf > 0, idf).otherwise(LEAST_IDF).alias("idf")), "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(max(mean, 1e-9))))
    scores = weighted.join(terms, "term").groupBy("query_id", key).agg(F.sum(part).alias("raw"))
    return ranked(scores.select("query_id", key, F.floor(F.col("raw") * 1e6 + 0.5).cast("long").alias("score")), limit, F.desc("score"), key)
