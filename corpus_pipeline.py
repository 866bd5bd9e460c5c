"""Documents to packed training sequences: quality rules, toxicity, near-duplicates, repeated passages, packing.

Every stage works on all rows its predecessor kept, and returns them with the columns of ``documents`` (the last one:
the pieces of ``packing``). Labels are read from ``labels`` beside the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import packing, quality, queries, simhash, suffixes, toxicity
from lodestone.llm.common import stored, table

TOXIC = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the base rules and the learned decision list keep, with all columns.

    Null and empty texts fail the base rules; repeated rows are judged row by row; without labels the base rules decide.
    """
    return quality.kept_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what scores below ``TOXIC``, with all columns.

    Null and empty texts are scored as one window without words; repeated rows score alike; without labels all stay.
    """
    return toxicity.kept_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), TOXIC)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, by SimHash blocks and a complete join at ``simhash``'s 0.8.

    The smallest id stays; rows without an id come last; rows that repeat an id with unlike texts are documents of their
    own; null and empty texts are one group; of rows that repeat, one stays.
    """
    return simhash.one_of_each(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; a character cut in two goes whole, and ``n_chars`` follows.

    All rows stay, texts of which nothing is cut (null ones too) as they are; rows without an id come after all others;
    rows of one id don't cut one another.
    """
    return suffixes.cleaned_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a null or empty text is its closing id alone, repeated rows are packed each."""
    return packing.pack_documents(docs, queries.tokenizer_file("byte_bpe_50k.json"), queries.split_pattern(), capacity=queries.SEQUENCE)


STAGES = [
    ("quality", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("repeat_dedup", repeat_dedup),
    ("packing", pack),
]

#: The learned filters, the linking and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
