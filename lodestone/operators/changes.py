"""Line ranges: overlap with changes, interval merging, diff hunks; file deltas between two states of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Chunks (semi-join) whose lines meet a changed range of their path; ranges are merged first, so that hot paths stay small."""
    merged = merge_intervals(changes).withColumnRenamed("path", "changed_path")
    meets = (F.col("path") == F.col("changed_path")) & (F.col("start_line") <= F.col("last")) & (F.col("end_line") >= F.col("first"))
    return chunks.join(merged, meets, "left_semi")


def merge_intervals(ranges: DataFrame, gap: int = 0) -> DataFrame:
    """``path, first, last``: ranges no more than ``gap`` + 1 lines apart are one. Equal ranges count once, so neither window's
    order leaves ties open, which the two might break differently."""
    order = Window.partitionBy("path").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("first") > F.coalesce(F.col("reach") + 1 + gap, F.lit(-1)), 1).otherwise(0)
    marked = ranges.select("path", "first", "last").distinct().withColumn("reach", reach).withColumn("fresh", fresh)
    island = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("path", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def file_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change`` (added, changed, deleted, unchanged) by content hash."""
    a = before.select("path", F.col("sha256").alias("old"))
    b = after.select("path", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def apply_delta(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The state after upserts and deletions; delta: the state's columns, ``version`` and ``deleted``; the last version of a path counts.

    Rows of one path and version come by a hash of all their columns, so that the same one counts in every run.
    """
    order = (F.desc("version"), F.xxhash64(*[F.col(c) for c in sorted(delta.columns)]))
    last = delta.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy(*order))).filter("nth = 1").drop("nth")
    kept = state.join(last.select("path"), "path", "left_anti")
    return kept.unionByName(last.filter("not deleted").select(*state.columns))


def shifted_ranges(hunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Old line ranges in new coordinates: each moves by the sum of the edits that end before it starts.

    hunks: ``path, old_start, old_count, new_count``; ranges: ``path, first, last``.
    """
    order = Window.partitionBy("path").orderBy("at", "what")
    edits = hunks.select("path", (F.col("old_start") + F.col("old_count")).alias("at"), F.lit(0).alias("what"), (F.col("new_count") - F.col("old_count")).alias("move"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    asked = ranges.select("path", F.col("first").alias("at"), F.lit(1).alias("what"), F.lit(0).alias("move"), "first", "last")
    both = edits.unionByName(asked).withColumn("by", F.sum("move").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return both.filter("what = 1").select("path", "first", "last", (F.col("first") + F.col("by")).cast("long").alias("new_first"), (F.col("last") + F.col("by")).cast("long").alias("new_last"))
