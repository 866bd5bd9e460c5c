"""Vector bin packing of document groups into shards.

Bytes, tokens and rows are balanced together. The packing itself runs over a bounded list whatever the input size: groups
(equal texts) that alone hold ``1 / (HOT * n_shards)`` of bytes, tokens or rows, and all others gathered into ``CELLS`` cells by
text hash. A group stays whole, in one shard, unless it alone is larger than a shard's equal share (one text copied into a
third of all rows, say): then it is dealt in ``PARTS`` parts by a hash of the document id, and only it.

Defined cases: a null text has no bytes and no tokens (size 1, crc32 0) and groups with the empty text; repeated rows
are placed row by row; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CELLS = 4096
PARTS = 64
HOT = 32
WORD = r"[^\x20\x09-\x0D]+"


def spread(load: np.ndarray) -> np.ndarray:
    """Difference of the fullest and the emptiest shard in each dimension, as a share of the mean."""
    return (load.max(axis=0) - load.min(axis=0)) / np.maximum(load.mean(axis=0), 1e-12)


def place(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each row of ``vectors`` (units by dimensions), by residual-capacity dot product.

    Units go in descending order of their largest share; each goes where the dot product of its shares with the
    residual capacities is highest (lowest shard number on ties). A last pass moves single units from the fullest to the
    emptiest shard of the first dimension while that narrows its spread and leaves those of the others no wider than
    they are, or within a fiftieth or four units of middling size.
    """
    n, dims = vectors.shape
    out = np.zeros(n, dtype=np.int64)
    if not n:
        return out
    share = vectors / np.maximum(vectors.sum(axis=0), 1)
    left = np.full((n_shards, dims), 1.0 / n_shards)
    for i in np.lexsort((np.arange(n), -share.max(axis=1))):
        s = int(np.argmax(left @ share[i]))
        out[i], left[s] = s, left[s] - share[i]
    load = 1.0 / n_shards - left
    loose = np.maximum(0.02, 4 * n_shards * np.median(share, axis=0))
    for _ in range(64 * n_shards):
        hi, lo = int(load[:, 0].argmax()), int(load[:, 0].argmin())
        gap = load[hi, 0] - load[lo, 0]
        own = np.flatnonzero((out == hi) & (share[:, 0] > 0) & (share[:, 0] < gap))
        limit = np.maximum(spread(load), loose)
        for i in own[np.argsort(np.abs(share[own, 0] - gap / 2), kind="stable")][:64]:
            moved = load.copy()
            moved[hi] -= share[i]
            moved[lo] += share[i]
            if (spread(moved)[1:] <= limit[1:]).all():
                out[i], load = lo, moved
                break
        else:
            break
    return out


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One slim row per document: id, size, crc32, tokens, hash of its text, part of its id."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("tokens"),
        F.xxhash64(t).alias("group"),
        F.pmod(F.xxhash64(F.col(doc_id)), F.lit(PARTS)).cast("int").alias("part"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``doc_id, size, text_crc32, tokens, shard, slot``; ``slot`` counts from 0 without gaps in each shard."""
    spark = docs.sparkSession
    slim = cut(measure(docs, doc_id, text))
    names = ("size", "tokens", "rows")
    sums = (F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    first = slim.agg(*sums).first()
    total = [max(1, first[k] or 0) for k in names]
    heavy = F.greatest(*[F.col(k) / n for k, n in zip(names, total)]) * HOT * n_shards > 1
    hot = [r["group"] for r in slim.groupBy("group").agg(*sums).filter(heavy).select("group").collect()]  # at most 3 * HOT * n_shards
    own = F.col("group").isin(hot) if hot else F.lit(False)
    # what is numbered together: a cell of light groups, or a part of a heavy group
    keyed = slim.withColumn("cell", F.when(own, F.col("group")).otherwise(F.pmod("group", F.lit(CELLS)))).withColumn("part", F.when(own, F.col("part")).otherwise(-1))
    counted = sorted(tuple(r) for r in keyed.groupBy("cell", "part").agg(*sums).collect())
    whole: dict[int, np.ndarray] = {}
    for cell, part, *sizes in counted:
        if part >= 0:
            whole[cell] = whole.get(cell, 0) + np.array(sizes, dtype=np.float64)
    split = {c for c, v in whole.items() if (v / total).max() * n_shards > 1}
    units: dict[tuple[int, int], np.ndarray] = {}
    for cell, part, *sizes in counted:
        unit = (cell, part if part < 0 or cell in split else PARTS)
        units[unit] = units.get(unit, 0) + np.array(sizes, dtype=np.float64)
    shards = dict(zip(units, place(np.array(list(units.values())).reshape(-1, 3), n_shards).tolist()))
    filled, plan = [0] * n_shards, []
    for cell, part, _, _, rows in counted:
        s = shards[cell, part if part < 0 or cell in split else PARTS]
        plan.append((cell, part, s, filled[s]))
        filled[s] += rows
    placed = spark.createDataFrame(plan, "cell long, part int, shard int, first long")  # at most CELLS + 3 * HOT * n_shards * PARTS rows
    rank = F.row_number().over(Window.partitionBy("cell", "part").orderBy("doc_id", "size", "text_crc32"))
    return (
        keyed.withColumn("rank", rank)
        .join(F.broadcast(placed), ["cell", "part"])
        .select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"))
    )
