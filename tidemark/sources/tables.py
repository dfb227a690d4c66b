"""Reading tables with the types that knowledge time needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def normalise(df: DataFrame) -> DataFrame:
    """Zone-less timestamps become UTC instants, NaN becomes NULL."""
    fixed = {}
    for name, kind in df.dtypes:
        if kind == "timestamp_ntz":
            fixed[name] = F.col(name).cast("timestamp")
        elif kind in ("double", "float"):
            fixed[name] = F.when(~F.isnan(name), F.col(name))
    return df.withColumns(fixed) if fixed else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return normalise(spark.read.parquet(f"{folder}/{name}.parquet"))
