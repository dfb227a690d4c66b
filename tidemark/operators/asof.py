"""Bitemporal views and as-of joins: nothing may use what was not known at the analysed instant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known(df: DataFrame, available: str, as_of: Column, strict: bool = False) -> DataFrame:
    """Rows available at as_of; before it, if strict. A plain predicate, so that it reaches the scan."""
    return df.filter(F.col(available) < as_of if strict else F.col(available) <= as_of)


def as_of_view(df: DataFrame, keys: Sequence[str], available: str, as_of: Column, ties: Sequence[Column] = (), strict: bool = False) -> DataFrame:
    """The latest known version of each key. Ties in availability go to the last by ``ties``, descending.

    One shuffle by key; ranks of one are cut before it, too. Null keys are a key of their own.
    """
    latest = Window.partitionBy(*keys).orderBy(F.col(available).desc(), *ties)
    return known(df, available, as_of, strict).withColumn("__rank", F.row_number().over(latest)).filter("__rank = 1").drop("__rank")


def versions_at(df: DataFrame, keys: Sequence[str], available: str, as_of: Column) -> DataFrame:
    """Every version with its role at as_of: ``visible``, ``superseded`` or ``later``."""
    w = Window.partitionBy(*keys)
    last = F.max(F.when(F.col(available) <= as_of, F.col(available))).over(w)
    role = F.when(F.col(available) > as_of, "later").when(F.col(available) == last, "visible").otherwise("superseded")
    return df.withColumn("role", role)


def guard(df: DataFrame, available: str, as_of: Column) -> DataFrame:
    """df; running it fails if any row was not available at as_of."""
    seen = F.col(available) <= as_of
    return df.filter(F.assert_true(F.coalesce(seen, F.lit(False)), "a row was not available at the analysed instant").isNull())


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, take: Sequence[str], tolerance_seconds: int | None = None, forward: bool = False, strict: bool = False) -> DataFrame:
    """left with the ``take`` columns of the last right row at or before its time; of the first after, if forward.

    Both sides are put in one order per key and the last value is carried on: one shuffle and one
    sort, however many right rows match, and no pairs are made. Left rows without a match stay, with nulls.
    """
    last = 0 if strict else 1  # of equal times, the side with the larger number comes first
    value = F.struct(F.col(right_time).alias("__at"), *take)
    both = left.select("*", F.col(left_time).alias("__t"), F.lit(1 - last).alias("__side"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("__v"), F.lit(True).alias("__keep"))
    others = right.select(*keys, F.col(right_time).alias("__t"), F.lit(last).alias("__side"), value.alias("__v"), F.lit(False).alias("__keep")).filter("__t is not null")
    both = both.unionByName(others, allowMissingColumns=True)
    if forward:
        w = Window.partitionBy(*keys).orderBy(F.col("__t").desc(), F.col("__side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(*keys).orderBy("__t", F.col("__side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__keep")
    ok = F.col(left_time).isNotNull() & F.col("__v").isNotNull()
    if tolerance_seconds is not None:
        gap = F.abs(F.unix_micros(F.col(left_time).cast("timestamp")) - F.unix_micros(F.col("__v.__at").cast("timestamp")))
        ok = ok & (gap <= tolerance_seconds * 1_000_000)
    return found.select(*[F.col(f"`{c}`") for c in left.columns], *[F.when(ok, F.col(f"__v.{c}")).alias(c) for c in take])


def nearest_match(left: DataFrame, right: DataFrame, keys: Sequence[str], left_date: str, right_date: str, days: int, take: Sequence[str]) -> DataFrame:
    """left with the right row whose date is nearest, at most ``days`` away; the earlier of two as near.

    Dates are cut into bands as wide as the tolerance, so that each row meets three bands at most.
    """
    band = F.floor(F.datediff(F.col(right_date), F.lit("1970-01-01")) / max(days, 1))
    near = right.select(*keys, F.explode(F.array(band - 1, band, band + 1)).alias("__band"), F.struct(F.col(right_date).alias("__at"), *take).alias("__r"))
    asked = left.withColumn("__band", F.floor(F.datediff(F.col(left_date), F.lit("1970-01-01")) / max(days, 1))).withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in left.columns]))
    gap = F.abs(F.datediff(F.col("__r.__at"), F.col(left_date)))
    pairs = asked.join(near, [*keys, "__band"], "left").withColumn("__gap", gap)
    close = F.when(F.col("__gap") <= days, F.struct("__gap", F.col("__r.__at").alias("__at"), *[F.col(f"__r.{c}").alias(c) for c in take]))
    best = pairs.groupBy("__row").agg(F.min(close).alias("__b"))
    return best.select("__row.*", *[F.col(f"__b.{c}").alias(c) for c in take], F.col("__b.__gap").alias("days_apart"))
