"""The engine's entities over the driver's tables: files, symbols, relations, changes, cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ``path, language, content, sha256, size_bytes``."""
    d = table(spark, sf_dir, "documents")
    content = F.coalesce("text", F.lit(""))
    return d.select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.col("lang").alias("language"), content.alias("content"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size_bytes"),
    )


FILES = "files AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, lang AS language, coalesce(text, '') AS content, sha256(coalesce(text, '')) AS sha256, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size_bytes FROM documents)"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema's rows as symbols: ``handle, path, language, kind, name, qualified_name, parent_handle, start_line, end_line, confidence``."""
    t = lambda n: table(spark, sf_dir, n)
    r, n, c, s, p, o = (t(x) for x in ("region", "nation", "customer", "supplier", "part", "orders"))
    text = lambda x: F.col(x).cast("string")

    def of(df: DataFrame, prefix: str, key: str, language: str, kind: str, name: str, qualified, parent, confidence: float) -> DataFrame:
        return df.select(
            F.concat(F.lit(prefix + ":"), text(key)).alias("handle"), F.concat(F.lit(prefix + "/"), (F.col(key) % 100).cast("string"), F.lit(".src")).alias("path"),
            F.lit(language).alias("language"), F.lit(kind).alias("kind"), F.col(name).alias("name"), qualified.alias("qualified_name"), parent.alias("parent_handle"),
            (F.col(key) * 10 + 1).cast("long").alias("start_line"), (F.col(key) * 10 + 9).cast("long").alias("end_line"), F.lit(confidence).alias("confidence"),
        )

    nested = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    parent = lambda prefix, key: F.concat(F.lit(prefix + ":"), text(key))
    parts = [
        of(r, "region", "r_regionkey", "go", "package", "r_name", F.col("r_name"), F.lit(None).cast("string"), 1.0),
        of(nested, "nation", "n_nationkey", "cpp", "namespace", "n_name", F.concat_ws(".", "r_name", "n_name"), parent("region", "n_regionkey"), 0.95),
        of(c.join(n, c["c_nationkey"] == n["n_nationkey"]), "customer", "c_custkey", "csharp", "class", "c_name", F.concat_ws(".", "n_name", "c_name"), parent("nation", "c_nationkey"), 0.9),
        of(s.join(n, s["s_nationkey"] == n["n_nationkey"]), "supplier", "s_suppkey", "typescript", "interface", "s_name", F.concat_ws(".", "n_name", "s_name"), parent("nation", "s_nationkey"), 0.9),
        of(p, "part", "p_partkey", "javascript", "type", "p_name", F.concat_ws(".", "p_brand", "p_name"), F.lit(None).cast("string"), 0.85),
        of(o.withColumn("o_name", F.concat(F.lit("Order"), text("o_orderkey"))).join(c, o["o_custkey"] == c["c_custkey"]), "order", "o_orderkey", "javascript", "method", "o_name", F.concat_ws(".", "c_name", "o_name"), parent("customer", "o_custkey"), 0.8),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _symbol_sql(rows: str, prefix: str, key: str, language: str, kind: str, name: str, qualified: str, parent: str, confidence: float) -> str:
    return f"SELECT '{prefix}:' || CAST({key} AS VARCHAR) AS handle, '{prefix}/' || CAST({key} % 100 AS VARCHAR) || '.src' AS path, '{language}' AS language, '{kind}' AS kind, {name} AS name, {qualified} AS qualified_name, {parent} AS parent_handle, CAST({key} * 10 + 1 AS BIGINT) AS start_line, CAST({key} * 10 + 9 AS BIGINT) AS end_line, CAST({confidence} AS DOUBLE) AS confidence FROM {rows}"


SYMBOLS = "symbols AS (" + " UNION ALL ".join([
    _symbol_sql("region", "region", "r_regionkey", "go", "package", "r_name", "r_name", "NULL", 1.0),
    _symbol_sql("nation JOIN region ON n_regionkey = r_regionkey", "nation", "n_nationkey", "cpp", "namespace", "n_name", "r_name || '.' || n_name", "'region:' || CAST(n_regionkey AS VARCHAR)", 0.95),
    _symbol_sql("customer JOIN nation ON c_nationkey = n_nationkey", "customer", "c_custkey", "csharp", "class", "c_name", "n_name || '.' || c_name", "'nation:' || CAST(c_nationkey AS VARCHAR)", 0.9),
    _symbol_sql("supplier JOIN nation ON s_nationkey = n_nationkey", "supplier", "s_suppkey", "typescript", "interface", "s_name", "n_name || '.' || s_name", "'nation:' || CAST(s_nationkey AS VARCHAR)", 0.9),
    _symbol_sql("part", "part", "p_partkey", "javascript", "type", "p_name", "p_brand || '.' || p_name", "NULL", 0.85),
    _symbol_sql("orders JOIN customer ON o_custkey = c_custkey", "order", "o_orderkey", "javascript", "method", "'Order' || CAST(o_orderkey AS VARCHAR)", "c_name || '.Order' || CAST(o_orderkey AS VARCHAR)", "'customer:' || CAST(o_custkey AS VARCHAR)", 0.8),
]) + ")"


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges ``from_handle, to_handle, unresolved_to, kind, confidence``: contains resolved; all others by name.

    Orders call or test parts and refer to suppliers, suppliers call the parts they deliver, customers import their nation,
    suppliers export theirs.
    """
    s = symbols(spark, sf_dir)
    contains = s.filter("parent_handle is not null").select(F.col("parent_handle").alias("from_handle"), F.col("handle").alias("to_handle"), F.lit(None).cast("string").alias("unresolved_to"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))
    lines = table(spark, sf_dir, "lineitem")
    origin = F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("from_handle")
    certain = F.round(1 - F.col("l_discount"), 2).alias("confidence")
    none = F.lit(None).cast("string")
    calls = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        origin, none.alias("to_handle"), F.concat_ws(".", "p_brand", "p_name").alias("unresolved_to"), F.when(F.col("l_orderkey") % 7 == 0, "tests").otherwise("calls").alias("kind"), certain
    )
    references = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(origin, none.alias("to_handle"), F.col("s_name").alias("unresolved_to"), F.lit("references").alias("kind"), certain)
    supplied = lines.select("l_suppkey", "l_partkey").distinct().join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    named = lambda x, conf: (none.alias("to_handle"), x.alias("unresolved_to"), conf)
    delivers = supplied.select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("from_handle"), *named(F.concat_ws(".", "p_brand", "p_name"), F.lit("calls").alias("kind")), F.lit(0.45).alias("confidence"))
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    imports = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("from_handle"), *named(F.col("n_name"), F.lit("imports").alias("kind")), F.lit(0.9).alias("confidence"))
    exports = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("from_handle"), *named(F.concat_ws(".", "r_name", "n_name"), F.lit("exports").alias("kind")), F.lit(0.8).alias("confidence"))
    out = contains
    for x in (calls, references, delivers, imports, exports):
        out = out.unionByName(x)
    return out


RELATIONS = (
    "relations AS (SELECT parent_handle AS from_handle, handle AS to_handle, CAST(NULL AS VARCHAR) AS unresolved_to, 'contains' AS kind, CAST(1 AS DOUBLE) AS confidence FROM symbols WHERE parent_handle IS NOT NULL "
    "UNION ALL SELECT 'order:' || CAST(l_orderkey AS VARCHAR), NULL, p_brand || '.' || p_name, CASE WHEN l_orderkey % 7 = 0 THEN 'tests' ELSE 'calls' END, round(1 - l_discount, 2) FROM lineitem JOIN part ON l_partkey = p_partkey "
    "UNION ALL SELECT 'order:' || CAST(l_orderkey AS VARCHAR), NULL, s_name, 'references', round(1 - l_discount, 2) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey "
    "UNION ALL SELECT 'supplier:' || CAST(l_suppkey AS VARCHAR), NULL, p_brand || '.' || p_name, 'calls', 0.45 FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey "
    "UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), NULL, n_name, 'imports', 0.9 FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR), NULL, r_name || '.' || n_name, 'exports', 0.8 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changed line ranges: ``path, first, last, change`` of the files' paths."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) % 60 + 1
    f = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "doc_id")
    return e.join(f, e["user_id"] == f["doc_id"]).select("path", k.cast("long").alias("first"), (k + F.floor(F.least(F.abs("value"), F.lit(20.0)))).cast("long").alias("last"), F.col("event_type").alias("change"))


CHANGES = (
    "changes AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, k AS first, k + CAST(floor(least(abs(value), 20.0)) AS BIGINT) AS last, event_type AS change "
    "FROM (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 60 + 1 AS k FROM events) e JOIN documents ON user_id = doc_id)"
)
