"""Append-only sinks: nothing is ever changed, and a rerun adds only what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def missing(fresh: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of fresh whose key is not stored; nulls in a key are equal."""
    same = F.lit(True)
    f, s = fresh.alias("f"), stored.select(*keys).alias("s")
    for k in keys:
        same = same & F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}"))
    return f.join(s, same, "left_anti")


def append_missing(spark: SparkSession, fresh: DataFrame, folder: str, keys: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Adds to a Parquet folder what it lacks of fresh; repeated keys in fresh are added once."""
    fresh = fresh.dropDuplicates(list(keys))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        fresh = missing(fresh, spark.read.parquet(folder), keys)
    fresh.write.mode("append").partitionBy(*partition_by).parquet(folder)


def archive(files: DataFrame) -> DataFrame:
    """Files read by ``binaryFile`` as (sha256, path, bytes, content): one row for each content, the first path."""
    return files.withColumn("sha256", F.sha2("content", 256)).groupBy("sha256").agg(F.min("path").alias("path"), F.first("length").alias("bytes"), F.first("content").alias("content"))


def verify_archive(archived: DataFrame) -> DataFrame:
    """Rows whose content does not hash to its name."""
    return archived.filter(F.sha2("content", 256) != F.col("sha256"))
