"""Helpers shared by the operators: tables, checkpoints and global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word separators: space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; a local one only where it is unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
        return path
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder; later stages read it back, also after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, kind: str) -> DataFrame:
    """df, computed once into a table of the shared folder. Unlike a checkpoint's, its size is known to plans and small files are read together."""
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the 0-based place of each row in the given order, without a single-task sort.

    Rows are dealt by range and sorted within partitions; each partition's count gives the next
    one's offset. Only one row per partition is gathered.
    """
    dealt = checkpoint(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__llm_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("__llm_at", 33)
    counts = dealt.groupBy(part.alias("__llm_part")).agg(F.count("*").alias("__llm_n"))
    before = Window.orderBy("__llm_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__llm_part", F.coalesce(F.sum("__llm_n").over(before), F.lit(0)).alias("__llm_offset"))
    within = F.col("__llm_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        dealt.withColumn("__llm_part", part)
        .join(F.broadcast(offsets), "__llm_part")
        .withColumn(name, F.col("__llm_offset") + within)
        .drop("__llm_part", "__llm_offset", "__llm_at")
    )


#: Keys with over this share of the rows are joined by broadcast: at most 1 / HOT_SHARE of them exist.
HOT_SHARE = 1e-3


def join_counted(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with per_key, which has one row for each key of rows and in ``count`` its rows there.

    Keys with very many rows, of which there can be only a thousand, are joined by broadcast, so that
    no task gets all rows of one; the others are joined by shuffle.
    """
    hot = F.col(count) > F.lit(max(1000, int(total * HOT_SHARE)))
    added = [c for c in per_key.columns if c != key]
    near = rows.join(F.broadcast(per_key.filter(hot)), key, "left")
    cold = near.filter(F.col(count).isNull()).drop(*added).join(per_key.filter(~hot), key)
    return near.filter(F.col(count).isNotNull()).unionByName(cold)
