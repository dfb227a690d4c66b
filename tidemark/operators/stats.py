"""Metrics of predictions, trades and equity curves as aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cross_section import correlation, with_both_ranks
from .ranks import quantiles


def regression_metrics(df: DataFrame, groups: Sequence[str], y: str, p: str) -> DataFrame:
    """(groups, n, mae, rmse, pearson, spearman)."""
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    ranked = with_both_ranks(rows, groups, y, p)
    e = F.col(y) - F.col(p)
    moved = (F.count("*") >= 3) & (F.min(y) != F.max(y)) & (F.min(p) != F.max(p))
    return ranked.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(moved, correlation(F.col(y), F.col(p))).alias("pearson"), F.when(moved, correlation(F.col("__a"), F.col("__b"))).alias("spearman")
    )


def classification_metrics(df: DataFrame, groups: Sequence[str], y: str, p: str) -> DataFrame:
    """(groups, n, brier, log_loss); probabilities are clipped by 1e-12 for the logarithm."""
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-12)), F.lit(1e-12))
    loss = -(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(loss).alias("log_loss"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 10, least: int = 1) -> DataFrame:
    """(bin, n, mean_predicted, observed, gap) over equal bins, the last of them closed."""
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    bucket = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    agg = rows.groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("__p"), F.avg(F.col(y).cast("double")).alias("__o"))
    enough = F.col("n") >= least
    return agg.select("bin", "n", F.when(enough, F.col("__p")).alias("mean_predicted"), F.when(enough, F.col("__o")).alias("observed"), F.when(enough, F.col("__o") - F.col("__p")).alias("gap"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of Wilson's interval for k of n; NULL for n = 0."""
    p = F.try_divide(k, n)
    mid = F.try_divide(p + z * z / 2 / F.nullif(n, F.lit(0)), 1 + z * z / F.nullif(n, F.lit(0)))
    half = z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + z * z / 4 / F.nullif(n, F.lit(0)) / F.nullif(n, F.lit(0))) / (1 + z * z / F.nullif(n, F.lit(0)))
    return mid - half, mid + half


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, n, missing, mean, std, p10, p50, p90) per column."""
    cols = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.explode(cols).alias("c")).select("c.*")
    plain = long.groupBy("name").agg(F.count("x").alias("n"), F.avg(F.col("x").isNull().cast("double")).alias("missing"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    return plain.join(quantiles(long, ["name"], "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), "name", "left")


def trade_stats(trades: DataFrame, groups: Sequence[str], r: str, least: int = 10) -> DataFrame:
    """(groups, n, hit_rate, profit_factor, mean_r, median_r); all but n are NULL below ``least`` trades."""
    x = F.col(r)
    won, lost = F.sum(F.when(x > 0, x)), -F.sum(F.when(x < 0, x))
    agg = trades.filter(x.isNotNull()).groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg((x > 0).cast("double")).alias("hit_rate"), F.try_divide(won, lost).alias("profit_factor"), F.avg(x).alias("mean_r")
    )
    # Groups as one struct, in which nulls are equal.
    middle = quantiles(trades.withColumn("__g", F.struct(F.lit(0), *groups)), ["__g"], r, {"median_r": 0.5})
    agg = agg.withColumn("__g", F.struct(F.lit(0), *groups)).join(middle, "__g", "left")
    return agg.select(*groups, "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("hit_rate", "profit_factor", "mean_r", "median_r")])


def equity_stats(daily: DataFrame, keys: Sequence[str], day: str, ret: str, per_year: int = 252) -> DataFrame:
    """(keys, days, total_return, cagr, vol, sharpe, sortino, max_drawdown) of daily returns; the drawdown is positive."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("__level", F.product(1 + F.col(ret)).over(w))
    curve = curve.withColumn("__dd", 1 - F.col("__level") / F.greatest(F.max("__level").over(w), F.lit(1.0)))
    x, root = F.col(ret), math.sqrt(per_year)
    span = F.datediff(F.max(day), F.min(day))
    total = F.product(1 + x)
    return curve.groupBy(*keys).agg(
        F.count("*").alias("days"),
        (total - 1).alias("total_return"),
        F.when((span >= 30) & (total > 0), F.pow(total, F.lit(365.0) / F.nullif(span, F.lit(0))) - 1).alias("cagr"),
        (F.stddev_samp(x) * root).alias("vol"),
        F.try_divide(F.avg(x) * root, F.stddev_samp(x)).alias("sharpe"),
        F.try_divide(F.avg(x) * root, F.stddev_samp(F.when(x < 0, x))).alias("sortino"),
        F.max("__dd").alias("max_drawdown"),
    )


def equity_sleeves(positions: DataFrame, day: str, weight: float, ret: str, cost: str | None = None) -> DataFrame:
    """(day, ret, exposure): equal sleeves added up per day, costs taken off."""
    gain = F.sum(F.col(ret) * weight)
    return positions.groupBy(day).agg((gain - F.sum(F.col(cost) * weight) if cost else gain).alias("ret"), (F.count("*") * weight).alias("exposure"))


def own_percentile(df: DataFrame, key: str, order: str, x: str, last: int = 60, least: int = 24) -> DataFrame:
    """<x>_pctile: the share in percent of the key's last earlier values that do not exceed the current one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-last, -1)
    seen = F.collect_list(x).over(w)
    df = df.withColumn("__seen", seen)
    share = F.try_divide(F.size(F.filter("__seen", lambda v: v <= F.col(x))) * 100.0, F.size("__seen"))
    return df.withColumn(f"{x}_pctile", F.when((F.size("__seen") >= least) & F.col(x).isNotNull(), share)).drop("__seen")


def relative_beta(returns: DataFrame, bench: DataFrame, key: str, day: str, r: str, b: str, n: int, least: int) -> DataFrame:
    """(key, n, beta) over the last n days that a series shares with its benchmark."""
    both = returns.join(bench.select(day, b), day).filter(F.col(r).isNotNull() & F.col(b).isNotNull())
    last = both.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(F.col(day).desc()))).filter(F.col("__i") <= n)
    return last.groupBy(key).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.try_divide(F.covar_samp(r, b), F.var_samp(b))).alias("beta"))
