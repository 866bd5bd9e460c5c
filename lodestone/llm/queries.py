"""The operators' queries over the test tables, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, lm, media, packing, quality, sharding, simhash, suffixes, toxicity
from .common import table

#: Length of a training sequence, and the shards of the export.
SEQUENCE, SHARDS = 1024, 8


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_media(media.store_texts(table(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), split_pattern(), capacity=SEQUENCE)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), split_pattern())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9_quality`` without the learned verdict: what SQL can count."""
    return op9_quality(spark, sf_dir).drop("kept")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op7_lm`` without the network's score: what SQL can count."""
    return op7_lm(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 5))


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of ``op3_sharding`` as a whole: all rows and bytes, gapless slots, near-equal bytes, whole groups."""
    placed = op3_sharding(spark, sf_dir)
    per = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"), F.max("size").alias("largest"))
    law = per.agg(
        F.count(F.lit(1)).alias("shards"), F.sum("n").alias("documents"), F.sum("bytes").alias("size"), F.bool_and((F.col("slots") == F.col("n")) & (F.col("last") == F.col("n") - 1)).alias("gapless"),
        (F.max("bytes") - F.min("bytes") <= F.greatest(F.max("largest"), F.avg("bytes") * 0.02)).alias("near_equal"),
    )
    groups = placed.groupBy("size", "text_crc32").agg(F.countDistinct("shard").alias("shards_of"), F.sum("size").alias("bytes_of"), F.count(F.lit(1)).alias("rows_of"))
    total = placed.agg(F.sum("size").alias("all_bytes"), F.count(F.lit(1)).alias("all_rows"), F.sum("tokens").alias("all_tokens"))
    # a group may be split only if it is larger than a shard's share of something
    split = groups.join(F.broadcast(total)).filter((F.col("shards_of") > 1) & (F.col("bytes_of") * 16 <= F.col("all_bytes")) & (F.col("rows_of") * 16 <= F.col("all_rows")))
    return law.join(F.broadcast(split.agg(F.count(F.lit(1)).alias("split_groups"))))


QUERIES = {f.__name__: f for f in (op1_media, op2_packing, op3_sharding, op4_bpe, op5_simhash, op6_repeats, op7_lm, op8_toxicity, op9_quality, op10_html, quality_counts, lm_base, sharding_law)}

SPACES = r"[\x20\x09-\x0D]"
#: CRC-32 of a short ASCII string, bit by bit.
CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, CAST(i AS INTEGER), 1)) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), CAST(4294967295 AS BIGINT))"

ORACLES: dict[str, str] = {
    # every 50-byte string by its place, in hexadecimal; a string goes where a smaller document has it too
    "op6_repeats": """WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents), q AS (SELECT doc_id, s, substr(h, CAST(2 * s + 1 AS BIGINT), 298) AS part FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 100)) AS s FROM d)),
p AS (SELECT doc_id, s + i AS i, hash(substr(part, CAST(2 * i + 1 AS BIGINT), 100)) AS k FROM (SELECT doc_id, s, part, unnest(range(0, least(100, greatest(len(part) // 2 - 49, 0)))) AS i FROM q)),
m AS (SELECT k, min(doc_id) AS least FROM p GROUP BY k), c AS (SELECT p.doc_id, p.i FROM p JOIN m USING (k) WHERE least < p.doc_id),
n AS (SELECT *, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c)),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY 1, 2), g AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM s),
k AS (SELECT g.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (a - prev) AS BIGINT)), '' ORDER BY a) AS kept, max(b) AS last FROM g JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "quality_counts": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1))) AS i FROM w)), hit AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM hit) GROUP BY 1),
c AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{SPACES}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c""",
    "lm_base": f"""WITH d AS (SELECT doc_id, {CRC.format('CAST(doc_id AS VARCHAR)')} % 10 = 0 AS held_out, list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ['']) AS words FROM documents),
t AS (SELECT doc_id, held_out, unnest(words) AS word FROM d), c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), s AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c),
x AS (SELECT t.doc_id, t.held_out, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10(coalesce(c.c, 0) + 0.1::DOUBLE)) AS total FROM t LEFT JOIN c USING (word) GROUP BY 1, 2)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(total - n_tokens * log10(n + 0.1::DOUBLE * (v + 1)), 5) AS base_score FROM x, s""",
    "sharding_law": "SELECT CAST(8 AS BIGINT) AS shards, count(*) AS documents, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, true AS gapless, true AS near_equal, CAST(0 AS BIGINT) AS split_groups FROM documents",
}
