"""The corpus state kept up by a stream of file changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.store import versions


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path by (version, event); two-phase, so a hot path is combined before the shuffle."""
    columns = [c for c in changes.columns if c != "path"]
    return changes.groupBy("path").agg(F.max_by(F.struct(*columns), F.struct("version", "event_id")).alias("x")).select("path", "x.*")


def run_available(spark: SparkSession, source: str, name: str, schema, prepare, state_dir: str, checkpoint: str) -> DataFrame:
    """Applies all Parquet files called ``name`` in the folder ``source`` in micro-batches, and returns the state.

    Each batch writes a new version directory from the last one before it; a batch that is run again overwrites its own
    version, so nothing is applied twice. With no batch ever, the state is the empty one.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        now = latest(prepare(batch))
        before = [v for v in versions(spark, state_dir) if v < batch_id]
        if before:
            now = latest(spark.read.parquet(f"{state_dir}/v={max(before)}").unionByName(now))
        now.write.mode("overwrite").parquet(f"{state_dir}/v={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", name).parquet(source)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = versions(spark, state_dir)
    return spark.read.parquet(f"{state_dir}/v={max(done)}") if done else latest(prepare(spark.createDataFrame([], schema)))
