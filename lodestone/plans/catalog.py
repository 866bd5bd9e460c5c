"""The engine's registered queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import changes as C
from lodestone.operators import chunking, evaluate, evidence, graph, rank, search
from lodestone.plans import planner
from lodestone.sources import diff, scan, views
from lodestone.sources.store import shared_folder, stored
from lodestone.sources.views import CHANGES, FILES, RELATIONS, SYMBOLS, table
from lodestone.streaming import apply

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
SEGMENT = r"[\p{L}\p{N}]+"


# ------------------------------------------------------------------ corpus


@query(f"WITH {FILES} SELECT path, language, sha256, size_bytes FROM files UNION ALL SELECT 'pages/' || CAST(page_id AS VARCHAR) || '.tpl', 'template', sha256(coalesce(html, '')), CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) FROM pages")
def scan_files_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".tpl"))
    pages = table(spark, sf_dir, "pages").select(path.alias("path"), T.extension_language(path).alias("language"), F.sha2(html, 256).alias("sha256"), F.octet_length(html).cast("long").alias("size_bytes"))
    return views.files(spark, sf_dir).select("path", "language", "sha256", "size_bytes").unionByName(pages)


@query(f"WITH {FILES} SELECT path FROM files WHERE NOT (regexp_matches(path, '^src1[^/]*/de/[^/]*$') OR regexp_matches(path, '^src2(/.*)?$'))")
def exclude_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).filter(~scan.excluded(F.col("path"), exclude=("src1*/de/*", "src2"))).select("path")


@query(f"""WITH {FILES}, n AS (SELECT path, content, CAST(len(regexp_extract_all(content, '[\\x00-\\x7E]')) AS DOUBLE) AS a, CAST(length(content) AS DOUBLE) AS l,
  len(regexp_extract_all(regexp_replace(content, '_', '', 'g'), '[\\p{{P}}\\p{{S}}]')) AS p, len(regexp_extract_all(content, '[\\p{{L}}\\p{{Nd}}_]+')) AS i FROM files)
SELECT path, CASE WHEN content = '' THEN 0 ELSE CAST(ceil((a / 4.0 + (l - a) / 1.8 + p / 8.0 + i / 3.0 + 4) * 1.12) AS BIGINT) END AS tokens FROM n""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).select("path", T.estimate_tokens(F.col("content")).alias("tokens"))


LINES = r"lined AS (SELECT path, language, string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)) AS lines FROM files), each AS (SELECT path, language, unnest(generate_series(1, len(lines))) AS line, trim(regexp_replace(unnest(lines), '\s+', ' ', 'g')) AS signature FROM lined)"


@query(f"""WITH {FILES}, {LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY path, language, signature ORDER BY line) - 1 AS nth FROM each)
SELECT path, CAST(line AS BIGINT) AS line, CAST(nth AS BIGINT) AS occurrence, 'sym_' || substr(translate(base64(unhex(sha256(chr(0) || path || chr(0) || language || chr(0) || 'line' || chr(0) || signature || CASE WHEN nth > 0 THEN chr(0) || CAST(nth AS VARCHAR) ELSE '' END))), '+/', '-_'), 1, 16) AS handle FROM n""")
def stable_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a symbol; lines of one file that are alike are told apart by their occurrence."""
    lines = views.files(spark, sf_dir).select("path", "language", F.posexplode(chunking.lines_of(F.col("content"))).alias("at", "text"))
    s = lines.select("path", "language", (F.col("at") + 1).cast("long").alias("line"), T.normalize_signature(F.col("text")).alias("signature"))
    nth = (F.row_number().over(Window.partitionBy("path", "language", "signature").orderBy("line")) - 1).cast("long")
    numbered = s.withColumn("occurrence", nth)
    fields = (F.col("path"), F.col("language"), F.lit("line"), F.col("signature"))
    handle = F.when(F.col("occurrence") > 0, T.stable_handle("sym", *fields, F.col("occurrence"))).otherwise(T.stable_handle("sym", *fields))
    return numbered.select("path", "line", "occurrence", handle.alias("handle"))


WINDOWS = r"""lined AS (SELECT path, language, string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)) AS lines FROM files),
windows AS (SELECT path, language, CAST(f AS BIGINT) + 1 AS start_line, CAST(least(f + 20, len(lines)) AS BIGINT) AS end_line, array_to_string(list_slice(lines, f + 1, f + 20), chr(10)) AS content
FROM (SELECT *, unnest(generate_series(0, CASE WHEN len(lines) <= 20 THEN 0 ELSE CAST(ceil((len(lines) - 20) / 15.0) AS BIGINT) * 15 END, 15)) AS f FROM lined))"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.windows(views.files(spark, sf_dir), 20, 5)


@query(f"WITH {FILES}, {WINDOWS} SELECT path, language, start_line, end_line, content, 'chunk_' || substr(translate(base64(unhex(sha256(chr(0) || path || chr(0) || CAST(start_line AS VARCHAR) || chr(0) || content))), '+/', '-_'), 1, 16) AS handle FROM windows")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir)


@query(rf"""WITH {FILES}, lined AS (SELECT path, string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)) AS lines FROM files),
n AS (SELECT path, CAST(len(lines) AS BIGINT) AS n, unnest(generate_series(1, len(lines))) AS i, unnest(lines) AS line FROM lined),
s AS (SELECT path, n, i, CASE WHEN regexp_matches(line, '^\S+\.$') THEN line ELSE '' END AS title FROM n WHERE i = 1 OR regexp_matches(line, '^\S+\.$'))
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS BIGINT) AS section, CAST(i AS BIGINT) AS start_line, coalesce(lead(i) OVER (PARTITION BY path ORDER BY i) - 1, n) AS end_line, trim(title) AS title FROM s""")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sections(views.files(spark, sf_dir), r"^\S+\.$")


@query(f"WITH {FILES} SELECT sha256, min(path) AS path, count(*) AS copies FROM files GROUP BY sha256")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).groupBy("sha256").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))


@query(f"""WITH {FILES}, rows AS (SELECT sha256(path || chr(0) || sha256) AS h FROM files)
SELECT substr(sha256({" || ':' || ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 8 * i}, 8))::UBIGINT AS HUGEINT)) AS VARCHAR)" for i in range(8))}), 1, 16) AS revision, count(*) AS files FROM rows""")
def corpus_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of paths and hashes that doesn't depend on their order: eight sums of the rows' hashes, so that no task
    gathers more than a number."""
    h = F.sha2(F.concat("path", F.chr(F.lit(0)), "sha256"), 256)
    words = views.files(spark, sf_dir).select(*[F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)").alias(f"w{i}") for i in range(8)])
    sums = words.agg(*[F.sum(f"w{i}").cast("string").alias(f"w{i}") for i in range(8)], F.count(F.lit(1)).alias("files"))
    return sums.select(F.substring(F.sha2(F.concat_ws(":", *[f"w{i}" for i in range(8)]), 256), 1, 16).alias("revision"), "files")


@query(r"""WITH names AS (SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS handle, p_brand || '_' || p_name AS name FROM part UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), c_name || 'HTTPServer2Go' FROM customer)
SELECT handle, array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(name, '([\p{Ll}\p{Nd}])(\p{Lu})', '\1|\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1|\2', 'g'), '[_:./\\|-]+'), lambda x: x <> ''), '|') AS parts FROM names""")
def identifier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("handle"), F.concat_ws("_", "p_brand", "p_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("handle"), F.concat("c_name", F.lit("HTTPServer2Go")).alias("name"))
    return p.unionByName(c).select("handle", F.array_join(T.split_identifier(F.col("name")), "|").alias("parts"))


@query(r"""WITH f AS (SELECT doc_id, source, lang, CAST(doc_id AS VARCHAR) AS d FROM documents), k AS (SELECT unnest([source || '/' || lang || '/' || d || '.txt', lang || '/' || d || '.txt', d || '.txt', source || '/' || lang || '/' || d, lang || '/' || d, d, source, source || '/' || lang]) AS lookup_key FROM f)
SELECT lookup_key, count(*) AS paths FROM k GROUP BY lookup_key""")
def lookup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = views.files(spark, sf_dir).select(F.explode(T.path_keys(F.col("path"))).alias("lookup_key"))
    return keys.groupBy("lookup_key").agg(F.count(F.lit(1)).alias("paths"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS n FROM {t}" for t in ("documents", "pages", "labels", "benchmark", "conversations", "embeddings", "events", "orders", "lineitem")))
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("entity"), "n") for t in ("documents", "pages", "labels", "benchmark", "conversations", "embeddings", "events", "orders", "lineitem")]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


# ------------------------------------------------------------------ search


def symbol_values(spark: SparkSession, sf_dir: str, qualified: bool = False) -> DataFrame:
    """Every supplier asks for its own name in capitals, and for the part with its number."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "part"), F.col("s_suppkey") == F.col("p_partkey"))
    one = F.concat_ws(".", "n_name", "s_name") if qualified else F.upper("s_name")
    two = F.upper(F.concat_ws(".", "p_brand", "p_name")) if qualified else F.col("p_name")
    return s.select(F.col("s_suppkey").cast("long").alias("query_id"), F.posexplode(F.array(one, two)).alias("value_pos", "value"))


def _values(a: str, b: str) -> str:
    rows = "supplier JOIN nation ON s_nationkey = n_nationkey JOIN part ON s_suppkey = p_partkey"
    return f"vals AS (SELECT CAST(s_suppkey AS BIGINT) AS query_id, 0 AS value_pos, {a} AS value FROM {rows} UNION ALL SELECT CAST(s_suppkey AS BIGINT), 1, {b} FROM {rows})"


SYMBOL_ORDER = "(kind LIKE '%-outline' OR kind = 'test-suite'), confidence DESC, end_line - start_line, path, start_line, handle"
ONE = "one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, handle ORDER BY value_pos, tier) = 1)"
RANKED = "SELECT query_id, handle, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {}) AS r FROM one) WHERE r <= 50"


@query(f"WITH {SYMBOLS}, {_values('upper(s_name)', 'p_name')}, hits AS (SELECT query_id, value_pos, 0 AS tier, s.* FROM vals JOIN symbols s ON lower(value) = lower(name)), {ONE} {RANKED.format('value_pos, ' + SYMBOL_ORDER)}")
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact(views.symbols(spark, sf_dir), symbol_values(spark, sf_dir)).select("query_id", "handle", "rank")


@query(f"""WITH {SYMBOLS}, {_values("n_name || '.' || s_name", "upper(p_brand || '.' || p_name)")}, every AS (SELECT query_id, value_pos, CASE WHEN value = qualified_name THEN 0 ELSE 1 END AS tier, s.* FROM vals JOIN symbols s ON lower(value) = lower(qualified_name)),
hits AS (SELECT * FROM every QUALIFY tier = min(tier) OVER (PARTITION BY query_id, value_pos)), {ONE} {RANKED.format('value_pos, ' + SYMBOL_ORDER)}""")
def search_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.qualified(views.symbols(spark, sf_dir), symbol_values(spark, sf_dir, True)).select("query_id", "handle", "rank")


@query(f"""WITH {SYMBOLS}, {_values('left(upper(s_name), 11)', 'left(p_name, 4)')}, hits AS (SELECT query_id, value_pos, CASE WHEN lower(name) = lower(value) THEN 0 ELSE 1 END AS tier, s.* FROM vals JOIN symbols s ON starts_with(lower(name), lower(value)) OR starts_with(lower(qualified_name), lower(value))),
{ONE} {RANKED.format('value_pos, tier, ' + SYMBOL_ORDER)}""")
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = symbol_values(spark, sf_dir).withColumn("value", F.when(F.col("value_pos") == 0, F.substring("value", 1, 11)).otherwise(F.substring("value", 1, 4)))
    return search.prefix(views.symbols(spark, sf_dir), v).select("query_id", "handle", "rank")


HINTS = "hints AS (SELECT CAST(item_id AS BIGINT) AS query_id, CASE item_id % 3 WHEN 0 THEN 'SRC' || CAST(item_id % 20 AS VARCHAR) || '/en' WHEN 1 THEN '/de/' || CAST(item_id AS VARCHAR) ELSE CAST(item_id AS VARCHAR) || '.txt' END AS value FROM benchmark)"


@query(f"""WITH {FILES}, {HINTS}, hits AS (SELECT query_id, path, min(CASE WHEN lower(path) = lower(value) THEN 0 WHEN ends_with(lower(path), '/' || lower(value)) THEN 1 WHEN starts_with(lower(path), lower(value) || '/') THEN 2 ELSE 3 END) AS place FROM hints JOIN files ON contains(lower(path), lower(value)) GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY place, path) AS rank FROM hits) WHERE rank <= 50""")
def search_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.path(views.files(spark, sf_dir), path_hints(spark, sf_dir)).select("query_id", "path", "rank")


def path_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id").cast("string")
    k = F.col("item_id") % 3
    value = F.when(k == 0, F.concat(F.lit("SRC"), (F.col("item_id") % 20).cast("string"), F.lit("/en"))).when(k == 1, F.concat(F.lit("/de/"), i)).otherwise(F.concat(i, F.lit(".txt")))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), value.alias("value"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, terms``: the distinct tokens of every benchmark item in order, as many as the planner asks for."""
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(search.TOKEN), F.lit(0))), 1, planner.MAX_FTS_TERMS)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), words.alias("terms"))


def asked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", F.explode("terms").alias("term"))


UNIQ = f"uniq AS (SELECT query_id, list_slice(list_filter(raw, lambda x, i: list_position(raw, x) = i), 1, 32) AS terms FROM (SELECT CAST(item_id AS BIGINT) AS query_id, {TOKENS.format('text')} AS raw FROM benchmark))"
ASKED = f"{UNIQ}, asked AS (SELECT query_id, unnest(terms) AS term FROM uniq)"


def _bm25(files: str = "files") -> str:
    return f"""tok AS (SELECT path, {TOKENS.format('content')} AS t FROM {files}), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(len(t)) / CAST(count(*) AS DOUBLE) AS mean FROM tok),
post AS (SELECT path, dl, term, count(*) AS tf FROM (SELECT path, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT query_id, path, CAST(floor(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) * 1e6 + 0.5) AS BIGINT) AS score
FROM asked JOIN post USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY 1, 2), fts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM sc) WHERE rank <= 100)"""


def text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(views.files(spark, sf_dir), asked_terms(spark, sf_dir))


@query(f"WITH {FILES}, {ASKED}, {_bm25()} SELECT query_id, path, score, rank FROM fts")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_hits(spark, sf_dir).select("query_id", "path", "score", "rank")


@query(f"WITH {FILES}, {CHANGES}, {ASKED}, scoped AS (SELECT * FROM files WHERE (path LIKE 'src1/%' OR path LIKE 'src3/en/%') OR path IN (SELECT path FROM changes)), {_bm25('scoped')} SELECT query_id, path, score, rank FROM fts")
def scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope comes before the cap: changed files, and those under two prefixes."""
    changed = views.changes(spark, sf_dir).select(F.col("path").alias("changed_path")).distinct()
    f = views.files(spark, sf_dir)
    marked = f.join(changed, F.col("path") == F.col("changed_path"), "left")
    scoped = marked.filter(F.col("path").startswith("src1/") | F.col("path").startswith("src3/en/") | F.col("changed_path").isNotNull()).select(*f.columns)
    return search.bm25(scoped, asked_terms(spark, sf_dir)).select("query_id", "path", "score", "rank")


# ------------------------------------------------------------------ fusion and ranking


def first_word(content):
    return F.coalesce(F.regexp_extract(F.lower(content), search.TOKEN, 0), F.lit(""))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text, path and first-word lists of every question."""
    f = views.files(spark, sf_dir)
    fts = text_hits(spark, sf_dir).select("query_id", F.lit("fts").alias("retriever"), "rank", F.col("path").alias("handle"))
    by_path = search.path(f, path_hints(spark, sf_dir)).select("query_id", F.lit("path").alias("retriever"), "rank", F.col("path").alias("handle"))
    named = f.select(F.col("path").alias("handle"), first_word(F.col("content")).alias("name"))
    first = asked_terms(spark, sf_dir).join(named, F.col("term") == F.col("name"))
    by_name = search.ranked(first, search.SYMBOL_LIMIT, "handle").select("query_id", F.lit("symbol").alias("retriever"), "rank", "handle")
    return fts.unionByName(by_path).unionByName(by_name)


LISTS = f"""{FILES}, {ASKED}, {_bm25()}, {HINTS}, ph AS (SELECT query_id, path, min(CASE WHEN lower(path) = lower(value) THEN 0 WHEN ends_with(lower(path), '/' || lower(value)) THEN 1 WHEN starts_with(lower(path), lower(value) || '/') THEN 2 ELSE 3 END) AS place FROM hints JOIN files ON contains(lower(path), lower(value)) GROUP BY 1, 2),
lists AS (SELECT query_id, 'fts' AS retriever, rank, path AS handle FROM fts UNION ALL SELECT * FROM (SELECT query_id, 'path', row_number() OVER (PARTITION BY query_id ORDER BY place, path) AS rank, path FROM ph) WHERE rank <= 50
UNION ALL SELECT * FROM (SELECT query_id, 'symbol', row_number() OVER (PARTITION BY query_id ORDER BY path) AS rank, path FROM asked JOIN files ON term = regexp_extract(lower(content), '{SEGMENT}')) WHERE rank <= 50),
part AS (SELECT query_id, handle, sum(CAST(floor(CASE retriever WHEN 'symbol' THEN 1.8 WHEN 'fts' THEN 1.0 ELSE 0.9 END::DOUBLE / (60 + rank) * 1e9 + 0.5) AS BIGINT))::BIGINT AS fused, count(*) AS hits FROM lists GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, hits DESC, handle) AS position FROM part) WHERE position <= 400)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.fuse(lists(spark, sf_dir))


@query(f"WITH {LISTS} SELECT query_id, handle, fused, hits, position FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every question with their reasons; content joins only what fusion kept."""
    f = views.files(spark, sf_dir).select(F.col("path").alias("handle"), "path", "language", "content", F.col("sha256").alias("content_hash"), T.estimate_tokens(F.col("content")).alias("tokens"))
    rows = fused(spark, sf_dir).join(f, "handle").join(questions(spark, sf_dir), "query_id")
    rows = rows.withColumn("symbol", first_word(F.col("content"))).withColumn("kind", F.when(F.length("content") % 5 == 0, "class-outline").when(F.length("content") % 5 == 1, "interface").otherwise("method"))
    rows = rows.withColumn("relation", F.when(F.col("query_id") % 4 == 0, "references").otherwise("")).withColumn("signature", F.substring("content", 1, 40))
    c = {k: F.col(k) for k in ("symbol", "signature", "path", "content", "kind", "language", "terms", "relation", "tokens")}
    c |= {"identifiers": F.slice("terms", 1, 2), "fused": F.col("fused") / 1e9, "changed": F.col("hits") > 1, "intent": F.lit("callers"), "test_intent": F.lit(False), "reference_intent": F.col("query_id") % 2 == 0}
    return rank.with_score(rows, c)


SCORED = f"""{LISTS},
c AS (SELECT f.*, path, language, content, sha256 AS content_hash, terms, regexp_extract(lower(content), '{SEGMENT}') AS symbol, left(content, 40) AS signature, CASE length(content) % 5 WHEN 0 THEN 'class-outline' WHEN 1 THEN 'interface' ELSE 'method' END AS kind, CASE WHEN query_id % 4 = 0 THEN 'references' ELSE '' END AS relation FROM fused f JOIN files ON handle = path JOIN uniq USING (query_id)),
n AS (SELECT *, list_filter(terms, lambda x: length(x) >= 3) AS long, list_slice(terms, 1, 2) AS ids, len(list_filter(terms, lambda x: contains(lower(path), x))) AS on_path, len(list_filter(terms, lambda x: contains(lower(concat_ws(' ', content, signature, path)), x))) AS lex FROM c),
m AS (SELECT *, len(list_filter(long, lambda x: x = symbol AND list_contains(ids, x))) > 0 AS exact, list_filter(long, lambda x: NOT (x = symbol AND list_contains(ids, x)) AND symbol <> '' AND (list_contains(ids, x) OR signature <> '') AND (contains(symbol, x) OR (length(x) > 3 AND ends_with(x, 's') AND symbol = left(x, length(x) - 1)))) AS near,
CASE WHEN content = '' THEN 0 ELSE ceil((len(regexp_extract_all(content, '[\\x00-\\x7E]'))::DOUBLE / 4.0 + (length(content) - len(regexp_extract_all(content, '[\\x00-\\x7E]')))::DOUBLE / 1.8 + len(regexp_extract_all(regexp_replace(content, '_', '', 'g'), '[\\p{{P}}\\p{{S}}]')) / 8.0 + len(regexp_extract_all(content, '[\\p{{L}}\\p{{Nd}}_]+')) / 3.0 + 4) * 1.12) END AS tokens FROM n),
scored AS (SELECT *, fused / 1e6 + CASE WHEN exact THEN 100 ELSE 0 END + CASE WHEN len(near) > 0 THEN CASE WHEN list_contains(ids, near[1]) THEN 70 ELSE 24 END ELSE 0 END + least(on_path * 4, 20) + least(lex * 8, 40) + CASE WHEN hits > 1 THEN 15 ELSE 0 END + CASE WHEN relation = 'references' THEN 60 ELSE 0 END + CASE WHEN query_id % 2 = 0 AND kind = 'interface' THEN 280 ELSE 0 END - CASE WHEN tokens > 4000 THEN 10 ELSE 0 END AS score FROM m)"""


@query(f"WITH {SCORED} SELECT query_id, handle, CAST(round(score * 1000) AS BIGINT) AS score_milli, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, handle) AS position FROM scored")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumns({"confidence": F.lit(0.0), "start_line": F.lit(1), "end_line": F.lit(1)})
    return rank.final_rank(rows).select("query_id", "handle", F.round(F.col("score") * 1000).cast("long").alias("score_milli"), "position")


OUTLINE_SQL = "quiet AS (SELECT * FROM (SELECT *, bool_or(kind NOT LIKE '%-outline') OVER (PARTITION BY query_id, folder) AS specific FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM scored)) WHERE NOT (kind LIKE '%-outline' AND specific AND NOT (exact OR relation <> '')))"


@query(f"WITH {SCORED}, {OUTLINE_SQL} SELECT query_id, handle, kind FROM quiet")
def outline_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders stand for paths here, where every file is one candidate."""
    rows = scored(spark, sf_dir).withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))
    return rank.drop_outlines(rows).select("query_id", "handle", "kind")


@query(f"""WITH {SCORED} SELECT query_id, handle FROM (SELECT *, row_number() OVER (PARTITION BY query_id, regexp_replace(path, '/[^/]*$', ''), content_hash ORDER BY position) AS nth FROM scored) WHERE nth = 1""")
def candidate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))
    return rank.first_of_content(rows, "position").select("query_id", "handle")


def chunk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all fused files of every question, as candidates with spans."""
    best = scored(spark, sf_dir).select("query_id", "path", "score", "reasons", "relation", "kind", "symbol", "signature", "terms", "position")
    w = windows(spark, sf_dir)
    rows = best.withColumnRenamed("position", "file_position").join(w, "path")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "start_line")
    rows = rows.withColumn("position", F.row_number().over(place).cast("long"))
    return rows.withColumn("intent", F.when(F.col("query_id") % 2 == 0, "callers").otherwise("definition")).withColumn("query", F.array_join("terms", " "))


@query()
def span_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_candidates(spark, sf_dir).select("query_id", "path", "handle", "start_line", "end_line", "position")
    last = F.max("position").over(Window.partitionBy("query_id"))  # wider spans come after all others
    wide = rows.unionByName(rows.withColumn("end_line", F.col("end_line") + 3).withColumn("handle", F.concat("handle", F.lit("+"))).withColumn("position", F.col("position") + last))
    return rank.without_contained(wide)


@query()
def pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_candidates(spark, sf_dir)
    return evidence.bundles(rows.select("query_id", "query", "intent", "position", *evidence.CANDIDATE), 2048)


@query()
def evidence_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_candidates(spark, sf_dir)
    return evidence.packets(rows.select("query_id", "query", "intent", "position", "terms", *evidence.CANDIDATE), 2048)


def role_column():
    """``evidence.role`` for candidates of the scored set, as an expression."""
    by_relation = F.when(F.col("relation") == "references", "reference")
    kind = F.regexp_replace("kind", "-outline$", "")
    return by_relation.when(F.lower("symbol").startswith("test"), "test").when(kind.isin(*sorted(evidence.TYPE_KINDS)), "type").when(F.col("kind").isin(*sorted(evidence.IMPLEMENTATION_KINDS)), "implementation").otherwise("context")


@query(f"""WITH {SCORED} SELECT query_id, handle, CASE WHEN relation = 'references' THEN 'reference' WHEN starts_with(symbol, 'test') THEN 'test' WHEN kind IN ('class-outline', 'interface') THEN 'type' ELSE 'implementation' END AS role,
array_to_string(list_slice(list_filter([CASE WHEN exact THEN 'exact_symbol' END, CASE WHEN len(near) > 0 THEN 'qualified_symbol' END, CASE WHEN relation = 'references' THEN 'references_target' END, CASE WHEN hits > 1 THEN 'changed_span' END, CASE WHEN on_path > 0 THEN 'path_match' END, 'lexical_match'], lambda x: x IS NOT NULL), 1, 4), ',') AS why FROM scored""")
def role_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda *names: F.exists("reasons", lambda x: x["code"].isin(*names))
    found = F.array(
        F.when(has("symbol-exact"), "exact_symbol"), F.when(has("symbol-prefix"), "qualified_symbol"), F.when(F.col("relation") == "references", "references_target"),
        F.when(has("changed-file"), "changed_span"), F.when(has("path"), "path_match"), F.when(has("lexical", "retrieval-fusion"), "lexical_match"),
    )
    return scored(spark, sf_dir).select("query_id", "handle", role_column().alias("role"), F.array_join(F.slice(F.array_compact(found), 1, 4), ",").alias("why"))


@query(f"""WITH {SCORED}, t AS (SELECT query_id, sum(CAST(tokens AS BIGINT))::BIGINT AS baseline, sum(CAST(CASE WHEN position <= 5 THEN tokens ELSE 0 END AS BIGINT))::BIGINT AS packed FROM scored GROUP BY query_id)
SELECT query_id, baseline, packed, round((baseline - packed) / CAST(baseline AS DOUBLE), 6) AS saved FROM t""")
def token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scored(spark, sf_dir).groupBy("query_id").agg(F.sum("tokens").alias("baseline"), F.sum(F.when(F.col("position") <= 5, F.col("tokens")).otherwise(0)).alias("packed"))
    return t.select("query_id", "baseline", "packed", F.round((F.col("baseline") - F.col("packed")) / F.col("baseline"), 6).alias("saved"))


# ------------------------------------------------------------------ graph


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolved(views.relations(spark, sf_dir), views.symbols(spark, sf_dir))


FAMILY = "CASE {0} WHEN 'c' THEN 'c-family' WHEN 'cpp' THEN 'c-family' WHEN 'javascript' THEN 'js-family' WHEN 'typescript' THEN 'js-family' ELSE {0} END"
LINKS = f"""wanted AS (SELECT r.from_handle, r.kind, r.unresolved_to, r.confidence, s.language FROM relations r JOIN symbols s ON r.from_handle = s.handle WHERE unresolved_to IS NOT NULL),
named AS (SELECT handle, language, 0 AS tier, qualified_name AS target FROM symbols UNION ALL SELECT handle, language, 1, name FROM symbols),
asked AS (SELECT DISTINCT unresolved_to, language, kind FROM wanted), met AS (SELECT a.*, n.handle, n.tier FROM asked a JOIN named n ON a.unresolved_to = n.target WHERE a.kind IN ('imports', 'exports', 'references') OR {FAMILY.format('a.language')} = {FAMILY.format('n.language')}),
best AS (SELECT unresolved_to, language, kind, tier, min(handle) AS lo, max(handle) AS hi FROM met GROUP BY unresolved_to, language, kind, tier QUALIFY tier = min(tier) OVER (PARTITION BY unresolved_to, language, kind)), uniq AS (SELECT * FROM best WHERE lo = hi)"""
EDGES = f"""{SYMBOLS}, {RELATIONS}, {LINKS}, edges AS (SELECT from_handle, to_handle, kind, max(confidence) AS confidence FROM (SELECT from_handle, to_handle, kind, confidence FROM relations WHERE to_handle IS NOT NULL
UNION ALL SELECT w.from_handle, u.lo, w.kind, w.confidence FROM wanted w JOIN uniq u ON w.unresolved_to = u.unresolved_to AND w.language = u.language AND w.kind = u.kind) GROUP BY ALL)"""


@query(f"WITH {SYMBOLS}, {RELATIONS}, {LINKS} SELECT w.from_handle, w.kind, w.unresolved_to, u.lo AS to_handle, CAST(u.tier AS BIGINT) AS tier FROM wanted w JOIN uniq u ON w.unresolved_to = u.unresolved_to AND w.language = u.language AND w.kind = u.kind")
def link_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.link(views.relations(spark, sf_dir), views.symbols(spark, sf_dir)).drop("confidence")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.symbols(spark, sf_dir)
    return s.filter(F.col("kind").isin("type", "interface", "class")).select(F.col("handle").alias("anchor_handle"))


ANCHORS = "anchors AS (SELECT handle AS anchor_handle FROM symbols WHERE kind IN ('type', 'interface', 'class'))"


def _hop(kind: str, direction: str) -> str:
    a, b = ("to_handle", "from_handle") if direction == "incoming" else ("from_handle", "to_handle")
    return f"SELECT DISTINCT anchor_handle, {b} AS handle, '{direction}' AS direction, confidence FROM anchors JOIN edges ON anchor_handle = {a} WHERE {f"kind = '{kind}'" if kind else 'true'}"


RELATION_SQL = {
    "self": "SELECT anchor_handle, anchor_handle AS handle, 'related' AS direction, CAST(1 AS DOUBLE) AS confidence FROM anchors",
} | {r: (_hop(k, d) if d != "both" else _hop(k, "incoming") + " UNION " + _hop(k, "outgoing")) for r, (k, d) in graph.EXPANSIONS.items()}


def _relation_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph.expand(anchors(spark, sf_dir), edges(spark, sf_dir), name)

    run.__name__ = f"relation_{name}"
    query(f"WITH {EDGES}, {ANCHORS} {RELATION_SQL[name]}")(run)


for _name in RELATION_SQL:
    _relation_query(_name)


@query(f"""WITH RECURSIVE {SYMBOLS}, up AS (SELECT handle, 1 AS level, parent_handle AS ancestor FROM symbols WHERE parent_handle IS NOT NULL UNION ALL SELECT u.handle, level + 1, s.parent_handle FROM up u JOIN symbols s ON u.ancestor = s.handle WHERE s.parent_handle IS NOT NULL)
SELECT handle, CAST(level AS BIGINT) AS level, ancestor FROM up""")
def scope_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(views.symbols(spark, sf_dir)).select("handle", F.col("level").cast("long").alias("level"), "ancestor")


@query(f"""WITH RECURSIVE {SYMBOLS}, up AS (SELECT handle, 1 AS level, parent_handle AS ancestor FROM symbols WHERE parent_handle IS NOT NULL UNION ALL SELECT u.handle, level + 1, s.parent_handle FROM up u JOIN symbols s ON u.ancestor = s.handle WHERE s.parent_handle IS NOT NULL),
w AS (SELECT DISTINCT 'order:' || CAST(l_orderkey AS VARCHAR) AS handle, s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
f AS (SELECT w.handle, w.name, u.level, s.handle AS found FROM w JOIN up u ON w.handle = u.handle JOIN symbols s ON s.parent_handle = u.ancestor AND s.name = w.name)
SELECT handle, name, CAST(min(level) AS BIGINT) AS level, arg_min(found, level) AS found FROM f GROUP BY handle, name""")
def link_scoped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name means what the nearest enclosing scope declares under it."""
    s = views.symbols(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    wanted = lines.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("handle"), F.col("s_name").alias("name")).distinct()
    declared = s.select(F.col("parent_handle").alias("ancestor"), "name", F.col("handle").alias("found"))
    met = wanted.join(graph.ancestors(s), "handle").join(declared, ["ancestor", "name"])
    return met.groupBy("handle", "name").agg(F.min("level").cast("long").alias("level"), F.min_by("found", "level").alias("found"))


@query(f"WITH {FILES}, cfg AS (SELECT DISTINCT source AS dir FROM documents UNION SELECT DISTINCT source || '/' || lang FROM documents WHERE lang IN ('de', 'fr')) SELECT path, arg_max(dir, length(dir)) AS config FROM files JOIN cfg ON starts_with(path, dir || '/') GROUP BY path")
def nearest_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's deepest enclosing configuration: ancestors are exploded, so this is an equi-join."""
    d = table(spark, sf_dir, "documents")
    cfg = d.select(F.col("source").alias("dir")).union(d.filter(F.col("lang").isin("de", "fr")).select(F.concat_ws("/", "source", "lang"))).distinct()
    parts = F.split("path", "/")
    up = views.files(spark, sf_dir).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir"))
    return up.join(cfg, "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("config"))


@query(f"""WITH {EDGES}, ch AS (SELECT handle FROM symbols WHERE kind IN ('type', 'interface')), hops AS (SELECT e.from_handle AS handle, e.kind, ch.handle AS anchor_handle, e.confidence FROM ch JOIN edges e ON ch.handle = e.to_handle WHERE e.kind IN ('tests', 'calls', 'imports', 'exports', 'references'))
SELECT * FROM hops WHERE handle NOT IN (SELECT handle FROM ch) QUALIFY row_number() OVER (PARTITION BY handle ORDER BY CASE WHEN kind = 'tests' THEN 0 ELSE 1 END, confidence DESC, anchor_handle, kind) = 1""")
def impact_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.symbols(spark, sf_dir)
    changed = s.filter(F.col("kind").isin("type", "interface")).select("handle")
    return graph.impact(changed, edges(spark, sf_dir)).select("handle", "kind", "anchor_handle", "confidence")


@query(f"WITH RECURSIVE {EDGES}, reach AS (SELECT handle AS node FROM symbols WHERE kind = 'interface' UNION SELECT e.from_handle FROM reach r JOIN edges e ON e.to_handle = r.node) SELECT node FROM reach")
def transitive_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = views.symbols(spark, sf_dir).filter("kind = 'interface'").select(F.col("handle").alias("node"))
    return graph.incoming_closure(seeds, edges(spark, sf_dir))


# ------------------------------------------------------------------ changes

MERGED = "marked AS (SELECT path, first, last, max(last) OVER (PARTITION BY path ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM changes), islands AS (SELECT *, sum(CASE WHEN first > coalesce(reach + 1 + {gap}, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM marked), merged AS (SELECT path, min(first) AS first, max(last) AS last FROM islands GROUP BY path, island)"


@query(f"WITH {CHANGES}, {MERGED.format(gap=0)} SELECT * FROM merged")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge_intervals(views.changes(spark, sf_dir)).select("path", "first", "last")


@query(f"WITH {CHANGES}, {MERGED.format(gap=3)} SELECT * FROM merged")
def line_window_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge_intervals(views.changes(spark, sf_dir), 3).select("path", "first", "last")


@query(f"WITH {FILES}, {CHANGES}, {WINDOWS} SELECT path, start_line, end_line FROM windows w WHERE EXISTS (SELECT 1 FROM changes c WHERE c.path = w.path AND w.start_line <= c.last AND w.end_line >= c.first)")
def changed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overlapping(windows(spark, sf_dir), views.changes(spark, sf_dir)).select("path", "start_line", "end_line")


def perturbed(f: DataFrame) -> DataFrame:
    """A later state: some files gone, some changed, some new, by their size."""
    k = F.col("size_bytes") % 10
    later = f.filter(k != 0).withColumn("sha256", F.when(k == 1, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("sha256")))
    return later.unionByName(f.filter(k == 2).withColumn("path", F.concat(F.lit("new/"), "path")))


AFTER = "later AS (SELECT path, CASE WHEN size_bytes % 10 = 1 THEN sha256(content || '!') ELSE sha256 END AS sha256 FROM files WHERE size_bytes % 10 <> 0 UNION ALL SELECT 'new/' || path, sha256 FROM files WHERE size_bytes % 10 = 2)"
DELTA = "delta AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.sha256 <> b.sha256 THEN 'changed' ELSE 'unchanged' END AS change FROM files a FULL JOIN later b ON a.path = b.path)"


@query(f"WITH {FILES}, {AFTER}, {DELTA} SELECT path, change FROM delta")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir)
    return C.file_delta(f, perturbed(f))


@query(f"WITH {FILES}, {AFTER}, {DELTA} SELECT change, count(*) AS files FROM delta GROUP BY change")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental_diff(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("files"))


LATEST = "latest AS (SELECT path, event_id, version, change FROM (SELECT 'user/' || CAST(user_id AS VARCHAR) AS path, event_id, CAST(epoch_us(ts) AS BIGINT) AS version, event_type AS change FROM events) QUALIFY row_number() OVER (PARTITION BY path ORDER BY version DESC, event_id DESC) = 1)"


def event_changes(e: DataFrame) -> DataFrame:
    return e.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("version"), F.col("event_type").alias("change"))


@query(f"""WITH {FILES}, state AS (SELECT 'user/' || CAST(c_custkey AS VARCHAR) AS path, CAST(0 AS BIGINT) AS version, 'base' AS change FROM customer), {LATEST}
SELECT * FROM state WHERE path NOT IN (SELECT path FROM latest) UNION ALL SELECT path, version, change FROM latest WHERE change <> 'purchase'""")
def incremental_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases stand for deletions; the last event of a path decides."""
    state = table(spark, sf_dir, "customer").select(F.concat(F.lit("user/"), F.col("c_custkey").cast("string")).alias("path"), F.lit(0).cast("long").alias("version"), F.lit("base").alias("change"))
    delta = apply.latest(event_changes(table(spark, sf_dir, "events"))).withColumn("deleted", F.col("change") == "purchase")
    return C.apply_delta(state, delta.select("path", "version", "change", "deleted"))


@query(f"WITH {LATEST} SELECT path, event_id, version, change FROM latest")
def stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state by Structured Streaming, everything available at once."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    return apply.run_available(spark, sf_dir, "events.parquet", schema, event_changes, f"{base}/state", f"{base}/checkpoint").select("path", "event_id", "version", "change")


@query(f"""WITH {CHANGES}, hunks AS (SELECT path, first AS old_start, last - first + 1 AS old_count, (first * 7 + last) % 5 AS new_count FROM (SELECT DISTINCT path, first, last FROM changes)), ranges AS (SELECT DISTINCT path, last + 1 AS first, last + 4 AS last FROM changes),
moved AS (SELECT r.path, r.first, r.last, coalesce(sum(new_count - old_count), 0) AS shift FROM ranges r LEFT JOIN hunks h ON h.path = r.path AND old_start + old_count <= r.first GROUP BY ALL)
SELECT path, first, last, CAST(first + shift AS BIGINT) AS new_first, CAST(last + shift AS BIGINT) AS new_last FROM moved""")
def diff_range_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.changes(spark, sf_dir).select("path", "first", "last").distinct()
    hunks = c.select("path", F.col("first").alias("old_start"), (F.col("last") - F.col("first") + 1).alias("old_count"), ((F.col("first") * 7 + F.col("last")) % 5).alias("new_count"))
    ranges = c.select("path", (F.col("last") + 1).alias("first"), (F.col("last") + 4).alias("last")).distinct()
    return C.shifted_ranges(hunks, ranges)


@query("SELECT CAST(event_id AS BIGINT) AS diff_id, 'f' || CAST(user_id AS VARCHAR) || '.go' AS path, CAST(1 + event_id % 50 AS BIGINT) AS old_start, CAST(1 + user_id % 3 AS BIGINT) AS old_count, CAST(2 + event_id % 50 AS BIGINT) AS new_start, CAST(user_id % 4 AS BIGINT) AS new_count FROM events")
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a diff text, parsed back."""
    path = F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".go"))
    text = F.format_string(
        "diff --git a/%1$s b/%1$s\n--- a/%1$s\n+++ b/%1$s\n@@ -%2$d,%3$d +%4$d,%5$d @@ f\n-old\n+new\n",
        path, 1 + F.col("event_id") % 50, 1 + F.col("user_id") % 3, 2 + F.col("event_id") % 50, F.col("user_id") % 4,
    )
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("diff_id"), text.alias("text"))
    return diff.hunks(events).select("diff_id", "path", "old_start", "old_count", "new_start", "new_count")


# ------------------------------------------------------------------ evaluation


#: Items of fewer than five tokens that are compared with every document.
SHORT_ITEMS = 1000


def expected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: they meet on the item's second to fourth token before the whole is compared.

    Tokens inside an item are whole tokens of any text that holds it. The few items of fewer than five tokens are compared
    with every document; their number is checked, so that this stays one pass over the documents.
    """
    tokens = lambda c: F.regexp_extract_all(c, F.lit(search.TOKEN), F.lit(0))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text", tokens(F.col("text")).alias("t"))
    f = views.files(spark, sf_dir).select("path", "content")
    n = F.size("t")
    keyed = stored(b.filter(n >= 5).select("query_id", "text", F.array_join(F.slice("t", 2, 3), " ").alias("k")))  # small enough, it is broadcast: the file's size says so
    t = f.withColumn("t", tokens(F.col("content")))
    triples = F.zip_with(F.zip_with("t", F.slice("t", 2, n + 1), lambda x, y: F.concat_ws(" ", x, y)), F.slice("t", 3, n + 1), lambda x, y: F.concat_ws(" ", x, y))
    near = t.select("path", F.explode(F.array_distinct(triples)).alias("k")).join(keyed, "k").select("path", "query_id", "text").distinct()
    found = near.join(f, "path").filter(F.col("content").contains(F.col("text"))).select("query_id", F.col("path").alias("key"))
    short = b.filter(n < 5).select("query_id", "text")
    few = short.limit(SHORT_ITEMS + 1).count()
    if few > SHORT_ITEMS:
        raise ValueError(f"more than {SHORT_ITEMS} items of fewer than five tokens")
    if few:
        found = found.union(f.join(F.broadcast(short), F.col("content").contains(F.col("text"))).select("query_id", F.col("path").alias("key")))
    return found.distinct()


def forbidden_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct(), "doc_id")
    return d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("key"))


EVAL = """expected AS (SELECT DISTINCT CAST(item_id AS BIGINT) AS query_id, path AS key FROM benchmark JOIN files ON contains(content, text)),
bad AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS key FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
res AS (SELECT CAST(item_id AS BIGINT) AS query_id, (SELECT count(*) FROM expected e WHERE e.query_id = item_id) AS expected, (SELECT count(DISTINCT r.key) FROM ranked r JOIN expected e ON r.query_id = e.query_id AND r.key = e.key WHERE r.query_id = item_id) AS found,
(SELECT min(r.rank) FROM ranked r JOIN expected e ON r.query_id = e.query_id AND r.key = e.key WHERE r.query_id = item_id) AS first_rank, (SELECT count(*) FROM ranked r JOIN bad ON r.key = bad.key WHERE r.query_id = item_id) AS violations FROM benchmark)"""


def case_results(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    hits = fused(spark, sf_dir).select("query_id", F.col("handle").alias("key"), F.col("position").alias("rank")) if profile == "full" else text_hits(spark, sf_dir).select("query_id", F.col("path").alias("key"), "rank")
    return evaluate.per_case(questions(spark, sf_dir), expected_labels(spark, sf_dir), hits.filter("rank <= 100"), forbidden_labels(spark, sf_dir))


@query(f"WITH {FILES}, {ASKED}, {_bm25()}, ranked AS (SELECT query_id, path AS key, rank FROM fts), {EVAL} SELECT * FROM res")
def eval_hit_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_results(spark, sf_dir, "fts")


def _report(source: str) -> str:
    return f"""SELECT '{source}' AS profile, count(*) AS cases, round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, round(avg(CASE WHEN first_rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_3, round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_5,
round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mean_reciprocal_rank, round(avg(CASE WHEN expected = 0 THEN 1.0 ELSE found / CAST(expected AS DOUBLE) END), 6) AS mean_recall, sum(violations)::BIGINT AS violations, round(median(first_rank), 6) AS median_rank,
list_sort(list(first_rank) FILTER (first_rank IS NOT NULL))[len(list(first_rank) FILTER (first_rank IS NOT NULL)) // 2 + 1] AS upper_median_rank FROM res"""


@query(f"WITH {LISTS}, ranked AS (SELECT query_id, handle AS key, position AS rank FROM fused WHERE position <= 100), {EVAL} {_report('full')}")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report(case_results(spark, sf_dir, "full").withColumn("profile", F.lit("full")), "profile")


@query(f"""WITH {LISTS}, {EVAL.split('res AS')[0].rstrip().rstrip(',')} SELECT e.query_id, e.key, CASE WHEN NOT EXISTS (SELECT 1 FROM lists l WHERE l.query_id = e.query_id AND l.handle = e.key) THEN 'retrieval' WHEN NOT EXISTS (SELECT 1 FROM fused f WHERE f.query_id = e.query_id AND f.handle = e.key AND position <= 50) THEN 'ranking'
WHEN NOT EXISTS (SELECT 1 FROM fused f WHERE f.query_id = e.query_id AND f.handle = e.key AND position <= 5) THEN 'packing' ELSE 'packed' END AS stage FROM expected e""")
def attribution_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_lists = lists(spark, sf_dir).select("query_id", F.col("handle").alias("key"))
    place = fused(spark, sf_dir).select("query_id", F.col("handle").alias("key"), "position")
    indexed = views.files(spark, sf_dir).select(F.col("path").alias("key"))
    return evaluate.attribution(expected_labels(spark, sf_dir), indexed, all_lists, place.filter("position <= 50"), place.filter("position <= 5"))


@query(f"""WITH {LISTS}, ranked AS (SELECT query_id, path AS key, rank FROM fts), {EVAL}, base AS (SELECT query_id % 5 AS bucket, avg(coalesce(1.0::DOUBLE / first_rank, 0)) AS mrr, avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END) AS hit FROM res GROUP BY 1),
ranked2 AS (SELECT query_id, handle AS key, position AS rank FROM fused WHERE position <= 100), {EVAL.split('res AS', 1)[1].replace('(SELECT CAST(item_id', 'res2 AS (SELECT CAST(item_id', 1).replace('FROM ranked r', 'FROM ranked2 r').lstrip()},
cand AS (SELECT query_id % 5 AS bucket, avg(coalesce(1.0::DOUBLE / first_rank, 0)) AS mrr, avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END) AS hit FROM res2 GROUP BY 1),
l AS (SELECT bucket, 'mean_reciprocal_rank' AS metric, round(mrr, 6) AS v, 'b' AS side FROM base UNION ALL SELECT bucket, 'hit_at_5', round(hit, 6), 'b' FROM base UNION ALL SELECT bucket, 'mean_reciprocal_rank', round(mrr, 6), 'c' FROM cand UNION ALL SELECT bucket, 'hit_at_5', round(hit, 6), 'c' FROM cand)
SELECT bucket, metric, b AS baseline, c AS candidate, CASE WHEN c < b THEN 'regressed' WHEN c > b THEN 'improved' ELSE 'same' END AS verdict FROM (SELECT bucket, metric, max(v) FILTER (side = 'b') AS b, max(v) FILTER (side = 'c') AS c FROM l GROUP BY 1, 2)""")
def report_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda profile: evaluate.report(case_results(spark, sf_dir, profile).withColumn("bucket", F.col("query_id") % 5), "bucket")
    return evaluate.compare(of("fts"), of("full"), ["bucket"], ["mean_reciprocal_rank", "hit_at_5"])


@query(f"""WITH {FILES}, {WINDOWS}, {EDGES} SELECT 'duplicate_paths' AS rule, count(*) - count(DISTINCT path) AS n FROM files UNION ALL SELECT 'empty_spans', count(*) FROM windows WHERE end_line < start_line UNION ALL SELECT 'dangling_edges', count(*) FROM edges WHERE to_handle NOT IN (SELECT handle FROM symbols) OR from_handle NOT IN (SELECT handle FROM symbols)
UNION ALL SELECT 'confidence_range', count(*) FROM edges WHERE confidence < 0 OR confidence > 1 UNION ALL SELECT 'labels_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, e, s = views.files(spark, sf_dir), edges(spark, sf_dir), views.symbols(spark, sf_dir).select("handle")
    known = lambda side: e.join(s, e[side] == s["handle"], "left_anti")
    loose = known("to_handle").union(known("from_handle")).distinct()
    n = F.count(F.lit(1)).cast("long").alias("n")
    rows = [
        f.agg((F.count(F.lit(1)) - F.countDistinct("path")).cast("long").alias("n")).select(F.lit("duplicate_paths").alias("rule"), "n"),
        windows(spark, sf_dir).filter("end_line < start_line").agg(n).select(F.lit("empty_spans").alias("rule"), "n"),
        loose.agg(n).select(F.lit("dangling_edges").alias("rule"), "n"),
        e.filter("confidence < 0 or confidence > 1").agg(n).select(F.lit("confidence_range").alias("rule"), "n"),
        table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_anti").agg(n).select(F.lit("labels_without_document").alias("rule"), "n"),
    ]
    for x in rows[1:]:
        rows[0] = rows[0].unionByName(x)
    return rows[0]
