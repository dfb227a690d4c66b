"""Streams of revised observations: what was known when, with a bounded lateness, and forecasts revealed at their instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_data(data: DataFrame, keys: list[str], at: str, available: str, version: str, as_of: Column, lateness_minutes: int = 15) -> DataFrame:
    """The last version of each observation at or before as_of that was available within the lateness after it."""
    cutoff = as_of + F.make_dt_interval(mins=F.lit(lateness_minutes))
    seen = data.filter((F.col(at) <= as_of) & (F.col(available) <= cutoff))
    w = Window.partitionBy(*keys, at).orderBy(F.col(version).desc(), F.col(available).desc())
    return seen.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def latest_stream(stream: DataFrame, keys: list[str], at: str, available: str, value: str, lateness: str = "15 minutes") -> DataFrame:
    """Per key and day the last value by availability; the watermark closes a day once nothing of it can come within the lateness."""
    day = F.window(at, "1 day")
    return stream.withWatermark(at, lateness).groupBy(*keys, day.alias("day")).agg(F.max_by(value, F.struct(available, at)).alias("value"), F.count("*").alias("versions"))


def first_only(stream: DataFrame, keys: list[str], at: str, lateness: str = "15 minutes") -> DataFrame:
    """Each key once, as it came first: a snapshot is frozen and never made again."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def lateness(at: Column, available: Column, minutes: int = 15) -> Column:
    return F.when(available <= at + F.make_dt_interval(mins=F.lit(minutes)), "IN_TIME").otherwise("LATE")


def reveal(forecasts: DataFrame, bars: DataFrame, keys: list[str], target: str, at: str, value: str, now: Column) -> DataFrame:
    """forecasts with outcome and state: PENDING before the target, REVEALED with exactly its bar, else AWAITING_BAR."""
    b = bars.select(*keys, F.col(at).alias(target), F.col(value).alias("outcome"))
    both = forecasts.join(b, [*keys, target], "left")
    state = F.when(F.col(target) > now, "PENDING").when(F.col("outcome").isNotNull(), "REVEALED").otherwise("AWAITING_BAR")
    return both.withColumn("outcome", F.when(F.col(target) <= now, F.col("outcome"))).withColumn("state", state)


def append_new(batch: DataFrame, folder: str, keys: list[str]) -> None:
    """For foreachBatch: adds the rows of a batch that the folder lacks, so that a repeated batch changes nothing."""
    from ..sources.append import append_missing

    append_missing(batch.sparkSession, batch, folder, keys)
