"""Half-open validity intervals [start, end), where a null end is open, and runs of consecutive rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(start: Column, end: Column, at: Column) -> Column:
    return (start <= at) & (end.isNull() | (at < end))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (b_end.isNull() | (a_start < b_end)) & (a_end.isNull() | (b_start < a_end))


def from_events(events: DataFrame, keys: Sequence[str], at: str, order: Sequence[str] = ()) -> DataFrame:
    """events as versions: each is valid from its time until the next one of its key."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    return events.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w)).filter(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """points with every interval of their key that contains them. The equality on the keys carries the shuffle."""
    p, i = points.alias("p"), intervals.alias("i")
    same = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in keys]
    condition = contains(F.col(f"i.{start}"), F.col(f"i.{end}"), F.col(f"p.{at}"))
    for s in same:
        condition = s & condition
    rest = [F.col(f"i.`{c}`") for c in intervals.columns if c not in keys]
    return p.join(i, condition).select("p.*", *rest)


def conflicts(intervals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Intervals that begin before an earlier one of their key has ended."""
    w = Window.partitionBy(*keys).orderBy(start, F.col(end).asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.max(F.col(end).isNull()).over(before)
    return intervals.withColumn("__reach", F.max(end).over(before)).withColumn("__open", open_before).filter(F.col("__open") | (F.col("__reach") > F.col(start))).drop("__reach", "__open")


def union(intervals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The intervals of each key merged where they overlap or touch: (keys, start, end, pieces)."""
    far = F.coalesce(F.col(end), F.lit("9999-12-31").cast(dict(intervals.dtypes)[end]))
    w = Window.partitionBy(*keys).orderBy(start, far)
    reach = F.max(far).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = intervals.withColumn("__new", F.when(reach.isNull() | (reach < F.col(start)), 1).otherwise(0)).withColumn("__far", far)
    runs = runs.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max("__far").alias("__far"), F.bool_or(F.col(end).isNull()).alias("__open"), F.count("*").alias("pieces"))
    return merged.select(*keys, start, F.when(~F.col("__open"), F.col("__far")).alias(end), "pieces")


def islands(df: DataFrame, keys: Sequence[str], ordinal: Column) -> DataFrame:
    """Runs of consecutive ordinals (repeats count once): (keys, first, last, length)."""
    rows = df.select(*keys, ordinal.alias("__o")).distinct()
    rows = rows.withColumn("__g", F.col("__o") - F.row_number().over(Window.partitionBy(*keys).orderBy("__o")))
    return rows.groupBy(*keys, "__g").agg(F.min("__o").alias("first"), F.max("__o").alias("last"), F.count("*").alias("length")).drop("__g")


def merge_equal(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], start: str, end: str) -> DataFrame:
    """Neighbours of a key with equal values become one segment."""
    w = Window.partitionBy(*keys).orderBy(*order)
    now, was = F.struct(*values), F.lag(F.struct(*values)).over(w)
    runs = df.withColumn("__new", F.when(was.eqNullSafe(now), 0).otherwise(1))
    runs = runs.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(F.struct(F.col(end)), F.struct(*order))
    return runs.groupBy(*keys, "__run", *values).agg(F.min(start).alias(start), last.alias("__last"), F.count("*").alias("pieces")).select(*keys, *values, start, F.col("__last").getField(end).alias(end), "pieces")
