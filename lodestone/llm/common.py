"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that an operator works on together. Spark bounds the batch itself by rows and by 64 MB.
BATCH_BYTES = 4 << 20
#: Bits of a sieve for each of its keys, and at most (half a million rows are broadcast then).
SIEVE = 16, 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``most`` bytes in a string or binary column each; at least one row a run."""
    start = size = 0
    for i, x in enumerate(batch.column(column)):
        size += x.as_buffer().size if x.is_valid else 0
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's setting; a local folder only where the session itself is local."""
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            current = tempfile.mkdtemp(prefix="lodestone-checkpoints-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: survives lost executors, computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column, all rows."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def parts_for(n: int, per_part: int) -> int:
    """How many parts of about ``per_part`` units hold ``n`` of them, at least one."""
    return max(1, math.ceil(n / per_part))


def most_frequent(counts: DataFrame, most: int, count: str = "c") -> DataFrame:
    """The rows with the highest counts, at most so many: whole eighths of octaves of ``count``, from the top.

    Only the number of rows in each eighth (some hundreds at any size) goes to the driver; nothing is sorted.
    """
    step = F.floor(F.log2(count) * 8)
    left, lowest = most, None
    for k, n in sorted(map(tuple, counts.filter(F.col(count) > 0).groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        left -= n
        if left < 0:
            break
        lowest = k
    return counts.filter((F.col(count) > 0) & (step >= lowest)) if lowest is not None else counts.limit(0)


_open: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables ``stored`` inside are deleted at the end, but for those to be kept: results must not read them."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            own = spark._jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def stored(df: DataFrame, keep: bool = False, outer: bool = False) -> DataFrame:
    """Like ``cut``, as a compressed Parquet table in the shared folder; inside ``temporary`` it goes at the end, unless kept.

    ``outer``: it stays until the end of the ``temporary`` around the innermost one; without such a one it is kept.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_open) > outer and not keep:
        _open[-1 - outer].append(path)
    return spark.read.schema(df.schema).parquet(path)


def sieved(df: DataFrame, key: Column | str, keys: DataFrame, own_key: Column | str) -> DataFrame:
    """``df`` with ``sieved boolean``: true for every row whose long ``key`` is an ``own_key`` of ``keys``, and for a few others.

    The keys' places in a bit map travel to the tasks, at most ``SIEVE[1]`` bits; of many more keys more other rows pass, and
    an exact join has to follow. What doesn't pass needs no join, and so no shuffle.
    """
    size = min(1 << (SIEVE[0] * max(1, keys.count()) - 1).bit_length(), SIEVE[1])
    place = lambda k: (F.col(k) if isinstance(k, str) else k).bitwiseAND(F.lit(size - 1))
    bit = lambda at: F.expr(f"shiftleft(1L, cast({at} & 63 as int))")
    words = keys.select(place(own_key).alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(bit("_at")).alias("_bits"))
    at = df.withColumn("_at", place(key))
    joined = at.join(F.broadcast(words), F.shiftright(at["_at"], 6) == words["_word"], "left")
    return joined.withColumn("sieved", F.coalesce(F.col("_bits").bitwiseAND(bit("_at")) != 0, F.lit(False))).select(*df.columns, "sieved")
