"""Data quality, coverage and readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missingness(df: DataFrame, features: Sequence[str], strata: Sequence[str]) -> DataFrame:
    """(feature, stratum, value, n, missing): overall and by each stratum, in one pass of grouping sets."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).isNull().alias("gone")) for f in features])
    long = df.select(*[F.col(s).cast("string").alias(s) for s in strata], F.explode(cells).alias("__c")).select(*strata, "__c.feature", "__c.gone")
    sets = [[F.col("feature")], *[[F.col("feature"), F.col(s)] for s in strata]]
    agg = long.groupingSets(sets, F.col("feature"), *map(F.col, strata)).agg(F.count("*").alias("n"), F.count_if("gone").alias("missing"), *[F.grouping(s).alias(f"__g_{s}") for s in strata])
    which, value = F.lit("ALL"), F.lit(None).cast("string")
    for s in strata:
        which, value = F.when(F.col(f"__g_{s}") == 0, s).otherwise(which), F.when(F.col(f"__g_{s}") == 0, F.col(s)).otherwise(value)
    return agg.select("feature", which.alias("stratum"), value.alias("value"), "n", "missing")


def reasons(checks: Sequence[tuple[str, Column]]) -> Column:
    """array<string>: the names of the checks that fail, in their order; an unknown check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks]))


def funnel(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """(reason, n): rows by the first check that they fail; ELIGIBLE if none."""
    first = F.coalesce(F.get(reasons(checks), F.lit(0)), F.lit("ELIGIBLE"))
    return df.groupBy(first.alias("reason")).agg(F.count("*").alias("n"))


def blocking(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """(reason, n): how often each check fails."""
    return df.select(F.explode(reasons(checks)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, expected: DataFrame, keys: Sequence[str], part: str, complete: float = 0.98, partial: float = 0.80) -> DataFrame:
    """(keys, present, expected, ratio, status) of the distinct parts that a key has of those it should have."""
    have = rows.groupBy(*keys).agg(F.count_distinct(part).alias("present"))
    due = expected.groupBy(*keys).agg(F.count_distinct(part).alias("expected"))
    both = due.join(have, list(keys), "left").withColumn("present", F.coalesce("present", F.lit(0).cast("long")))
    ratio = F.try_divide(F.col("present"), F.col("expected"))
    status = F.when(ratio >= complete, "COMPLETE").when(ratio >= partial, "PARTIAL").when(F.col("present") > 0, "SPARSE").otherwise("MISSING")
    return both.withColumn("ratio", ratio).withColumn("status", status)


def violations(df: DataFrame, key: Sequence[str], checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """(key, check) for each row and each check that it fails."""
    return df.select(*key, F.explode(reasons(checks)).alias("check"))


def all_proven(df: DataFrame, group: Sequence[str], proven: str) -> DataFrame:
    """(group, members, ok): one member that is not proven fails the whole group."""
    return df.groupBy(*group).agg(F.count("*").alias("members"), F.bool_and(F.coalesce(F.col(proven), F.lit(False))).alias("ok"))


def deterministic_sample(df: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """The n rows whose key has the smallest salted digest; an ordered limit, so that no full sort is made."""
    return df.withColumn("__h", F.sha2(F.concat_ws("|", F.lit(salt), F.col(key).cast("string")), 256)).orderBy("__h", key).limit(n).drop("__h")
