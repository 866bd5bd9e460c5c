"""Tables in the shared folder: intermediates that cut lineage, and the versioned index."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; a local one only for a local session."""
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            current = tempfile.mkdtemp(prefix="lodestone-checkpoints-")
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def travelling(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked to be broadcast if it has at most ``most`` rows, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


# ------------------------------------------------------------------ versions


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path: the store may lie where only Spark reads."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Finished version directories ``v=N``, in order; Spark marks a finished write by ``_SUCCESS``."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path):
        return []
    out = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("v=") and fs.exists(file_system(spark, f"{status.getPath()}/_SUCCESS")[1]):
            out.append(int(name[2:]))
    return sorted(out)
