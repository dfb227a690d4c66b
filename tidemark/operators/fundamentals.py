"""Periodisation of reported facts: quarters, trailing twelve months, growth, and missing values with reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def months_of(start: Column, end: Column, tolerance: int = 12) -> Column:
    """3, 6, 9 or 12 if the period's days come within tolerance of so many months, else NULL."""
    days = F.datediff(end, start) + 1
    out = F.lit(None).cast("int")
    for m in (12, 9, 6, 3):
        out = F.when(F.abs(days - F.bround(F.lit(m * 30.4375))) <= tolerance, m).otherwise(out)
    return out


def discrete_quarters(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, period_end, value, source): three-month facts, else the difference of year-to-date facts of one year.

    facts: keys, period_start, period_end, months, value; one row per key, start and end.
    """
    direct = facts.filter("months = 3").select(*keys, "period_end", "value", F.lit("DIRECT").alias("source"), F.lit(0).alias("__o"))
    w = Window.partitionBy(*keys, "period_start").orderBy("months")
    steps = facts.withColumns({"__m": F.lag("months").over(w), "__v": F.lag("value").over(w)})
    diff = steps.filter("__m is not null and months - __m = 3").select(*keys, "period_end", (F.col("value") - F.col("__v")).alias("value"), F.lit("DIFFERENCE").alias("source"), F.lit(1).alias("__o"))
    one = Window.partitionBy(*keys, "period_end").orderBy("__o")
    return direct.unionByName(diff).withColumn("__r", F.row_number().over(one)).filter("__r = 1").drop("__r", "__o")


def trailing_year(quarters: DataFrame, keys: Sequence[str], period: str = "period_end", value: str = "value") -> DataFrame:
    """quarters with ttm: the sum of four quarters, if they span a year; else the reason in ttm_reason."""
    w = Window.partitionBy(*keys).orderBy(period)
    four = w.rowsBetween(-3, 0)
    months = F.months_between(F.trunc(period, "month"), F.trunc(F.lag(period, 3).over(w), "month"))
    reason = F.when(F.count("*").over(four) < 4, "NOT_ENOUGH_HISTORY").when(months != 9, "GAP").when(F.count(value).over(four) < 4, "MISSING_VALUE")
    return quarters.withColumn("ttm_reason", reason).withColumn("ttm", F.when(F.col("ttm_reason").isNull(), F.sum(value).over(four)))


def ttm_from_annual(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, period_end, ttm, method) at each key's freshest end: the year itself, or last year + year to date - the same a year before; NULL where one of these is missing."""
    f = facts.select(*keys, "period_start", "period_end", "months", "value")
    freshest = f.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("period_end").desc(), F.col("months").desc()))).filter("__r = 1").drop("__r")
    others = f.select(*keys, F.col("period_end").alias("__e"), F.col("months").alias("__m"), F.col("value").alias("__v"))
    last_year = (F.col("__m") == 12) & (F.abs(F.datediff(F.date_sub("period_start", 1), "__e")) <= 5)
    year_before = (F.col("__m") == F.col("months")) & (F.abs(F.datediff(F.add_months("period_end", -12), "__e")) <= 7)
    both = freshest.join(others, [*keys]).groupBy(*keys, "period_end", "months", "value").agg(F.max(F.when(last_year, F.col("__v"))).alias("__year"), F.max(F.when(year_before, F.col("__v"))).alias("__prior"))
    annual = F.col("months") == 12
    value = F.when(annual, F.col("value")).otherwise(F.col("__year") + F.col("value") - F.col("__prior"))
    return both.select(*keys, "period_end", value.alias("ttm"), F.when(annual, "ANNUAL").otherwise("ROLLED").alias("method"))


def growth(df: DataFrame, keys: Sequence[str], order: str, value: str, lag: int, name: str) -> DataFrame:
    """value / value ``lag`` rows before - 1 where that was positive."""
    before = F.lag(value, lag).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(name, F.when(before > 0, F.col(value) / before - 1))


def cagr(now: Column, then: Column, years: float) -> Column:
    return F.when((now > 0) & (then > 0), F.pow(now / then, F.lit(1 / years)) - 1)


def by_priority(facts: DataFrame, keys: Sequence[str], tags: Sequence[str], conflict: float = 0.01) -> DataFrame:
    """One value per key from several tags: the first by priority, or the reason CONFLICT where they differ by more than ``conflict``."""
    rank = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    known = facts.withColumn("__p", rank).filter("__p > 0 and value is not null")
    agg = known.groupBy(*keys).agg(F.min_by("value", "__p").alias("__v"), F.min_by("tag", "__p").alias("tag"), F.min("value").alias("__lo"), F.max("value").alias("__hi"), F.count("*").alias("n_tags"))
    wide = F.col("__hi") - F.col("__lo") > conflict * F.greatest(F.abs("__lo"), F.abs("__hi"))
    return agg.select(*keys, F.when(~wide, F.col("__v")).alias("value"), "tag", "n_tags", F.when(wide, "CONFLICT").alias("reason"))


def ratio(a: Column, b: Column) -> Column:
    """struct(value, reason) of a / b: NULL with a reason where a part is missing or b is not positive."""
    reason = F.when(a.isNull(), "MISSING_NUMERATOR").when(b.isNull(), "MISSING_DENOMINATOR").when(b == 0, "ZERO_DENOMINATOR").when(b < 0, "NEGATIVE_DENOMINATOR")
    return F.struct(F.when(reason.isNull(), F.try_divide(a, b)).alias("value"), reason.alias("reason"))
