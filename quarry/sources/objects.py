"""The object table: sharded by the first two hexadecimal digits of the id, so that point reads prune to one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.store import put_objects


def write_objects(objects: DataFrame, path: str, mode: str = "append") -> None:
    """objects(id binary, kind, payload binary), one folder per shard."""
    sharded = objects.withColumn("shard", F.substring(F.lower(F.hex("id")), 1, 2))
    sharded.repartition("shard").write.mode(mode).partitionBy("shard").parquet(path)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_new(spark: SparkSession, objects: DataFrame, path: str) -> None:
    """Writes only objects that the store does not have yet."""
    write_objects(put_objects(read_objects(spark, path), objects), path)


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, payload of whole files, as streams to chunk."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("content").alias("payload"))
