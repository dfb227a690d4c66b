"""Ranks and quantiles of whole columns: counts by value, dealt by range and added up, so that no task sorts a column.

Groups may be few and large. Values with very many rows are counted before they move, and joined back by
broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Values with over this share of the rows, of which there are at most a thousand, are joined by broadcast.
HOT_SHARE = 1e-3


def running_before(counts: DataFrame, groups: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    """counts (one row per group and order value) with, for each of sums, <sum>_before: its total over the group's smaller values."""
    dealt = cut(counts.repartitionByRange(*groups, order).withColumn("__p", F.spark_partition_id()))
    within = Window.partitionBy(*groups, "__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*groups, "__p").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    earlier = Window.partitionBy(*groups).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range partition
    offsets = parts.select(*groups, "__p", *[F.coalesce(F.sum(f"__{s}").over(earlier), F.lit(0)).alias(f"__{s}_o") for s in sums])
    out = dealt.withColumns({f"__{s}_w": F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums}).join(offsets, [*groups, "__p"])
    return out.select(*counts.columns, *[(F.col(f"__{s}_w") + F.col(f"__{s}_o")).alias(f"{s}_before") for s in sums])


def value_ranks(df: DataFrame, groups: Sequence[str], x: str) -> DataFrame:
    """(groups, x, n, rank): the average 1-based rank of each different value that is not null."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*groups, x).agg(F.count("*").alias("n"))
    ranked = running_before(counts, groups, x, ["n"])
    return ranked.select(*groups, x, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"))


def with_group_rank(df: DataFrame, groups: Sequence[str], x: str, name: str, total: int) -> DataFrame:
    """df with the average rank of x within its group of few and large ones; NULL where x is."""
    ranks = cut(value_ranks(df, groups, x)).withColumnRenamed("rank", name)
    on = [*groups, x]
    hot = F.col("n") > F.lit(max(1000, int(total * HOT_SHARE)))
    near = df.join(F.broadcast(ranks.filter(hot)), on, "left")
    known = near.filter(F.col("n").isNotNull())
    rest = near.filter(F.col("n").isNull()).drop("n", name).join(ranks.filter(~hot), on, "left")
    return known.unionByName(rest).drop("n")


def with_rank(df: DataFrame, x: str, name: str, total: int) -> DataFrame:
    """df with the average rank of x over the whole table; NULL where x is."""
    return with_group_rank(df, [], x, name, total)


def quantiles(df: DataFrame, groups: Sequence[str], x: str, shares: dict[str, float]) -> DataFrame:
    """(groups, one column for each of shares): exact quantiles, linear between values."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*groups, x).agg(F.count("*").alias("n"))
    placed = running_before(counts, groups, x, ["n"])
    total = counts.groupBy(*groups).agg(F.sum("n").alias("__n")) if groups else counts.agg(F.sum("n").alias("__n"))
    placed = placed.join(total, list(groups)) if groups else placed.withColumn("__n", total.select("__n").scalar())
    out = []
    for name, q in shares.items():
        at = (F.col("__n") - 1) * q
        low, high = ([F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col(x)) for k in (F.floor(at), F.ceil(at))])
        out.append((F.max(low) + (F.max(high) - F.max(low)) * (F.max(at) - F.floor(F.max(at)))).alias(name))
    return placed.groupBy(*groups).agg(*out) if groups else placed.agg(*out)
