"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Most rows of a table that is broadcast.
FEW = 20_000


def few(table: DataFrame) -> DataFrame:
    """A table that was cut, to be broadcast where it has few rows, so that what it is joined with need not move; as it is, where it has more."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the folder that the cluster shares (spark.checkpoint.dir); a local one only where it is unset."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return df.checkpoint()
