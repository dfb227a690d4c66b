"""Walk-forward folds with purge, embargo, label availability and a sealed holdout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut, few
from .ranks import quantiles


def plan_folds(spark: SparkSession, first: str, last: str, train: int, validation: int, test: int, step: int, embargo: int = 0, rolling: bool = False) -> DataFrame:
    """(fold, train_start, train_end, val_start, val_end, test_start, test_end) of months, ends exclusive; some dozen rows."""
    months = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr(f"interval {step} month"))).alias("anchor"))
    start = F.add_months("anchor", train + embargo)
    fold = months.select(
        F.row_number().over(Window.orderBy("anchor")).alias("fold"),
        (F.col("anchor") if rolling else F.to_date(F.lit(first))).alias("train_start"), F.add_months("anchor", train).alias("train_end"),
        start.alias("val_start"), F.add_months(start, validation).alias("val_end"), F.add_months(start, validation).alias("test_start"), F.add_months(start, validation + test).alias("test_end"),
    )
    return fold.filter(F.col("test_end") <= F.add_months(F.to_date(F.lit(last)), 1))


def assign(observations: DataFrame, folds: DataFrame, at: str, label_end: str, available: str) -> DataFrame:
    """observations x folds with role: TRAIN, VALIDATION, TEST, or why a training row goes: UNAVAILABLE, then PURGED.

    Unavailable: its label was not known when validation began. Purged: its outcome reaches into the
    evaluated span. The folds are a few rows and are broadcast; observations do not shuffle.
    """
    rows = observations.join(F.broadcast(folds), (F.col(at) >= F.col("train_start")) & (F.col(at) < F.col("test_end")))
    in_train = F.col(at) < F.col("train_end")
    role = (
        F.when(in_train & (F.col(available) > F.col("val_start")), "UNAVAILABLE")
        .when(in_train & (F.col(label_end) >= F.col("val_start")), "PURGED")
        .when(in_train, "TRAIN")
        .when(F.col(at) < F.col("val_start"), "EMBARGOED")
        .when(F.col(at) < F.col("val_end"), "VALIDATION")
        .otherwise("TEST")
    )
    return rows.withColumn("role", role)


def development_only(df: DataFrame, at: str, label_end: str, holdout_start: Column) -> DataFrame:
    """Rows decided and resolved before the sealed holdout."""
    return df.filter((F.col(at) < holdout_start) & (F.col(label_end) < holdout_start))


def train_only_fit(rows: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(groups, <c>_median, <c>_lo, <c>_hi, <c>_mean, <c>_std) of TRAIN rows alone; std of a population, 0 as 1."""
    train = cut(rows.filter("role = 'TRAIN'").select(*groups, *columns))
    cuts = train.select(*groups).distinct()
    for c in columns:
        cuts = cuts.join(quantiles(train, groups, c, {f"{c}_median": 0.5, f"{c}_lo": 0.01, f"{c}_hi": 0.99}), list(groups), "left")
    cuts = cut(cuts)  # a row a group: joined as its size allows
    clipped = train.join(few(cuts), list(groups))
    value = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.col(f"{c}_median")), F.col(f"{c}_lo")), F.col(f"{c}_hi"))
    moments = clipped.groupBy(*groups).agg(*[x for c in columns for x in (F.avg(value(c)).alias(f"{c}_mean"), F.stddev_pop(value(c)).alias(f"__{c}"))])
    moments = moments.withColumns({f"{c}_std": F.when(F.col(f"__{c}") == 0, 1.0).otherwise(F.col(f"__{c}")) for c in columns}).drop(*[f"__{c}" for c in columns])
    return cuts.join(moments, list(groups))


def standardise(rows: DataFrame, fit: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """rows with <c>_x imputed, clipped and standardised by a fit, and <c>_imputed."""
    joined = rows.join(few(cut(fit)), list(groups))
    for c in columns:
        full = F.least(F.greatest(F.coalesce(F.col(c), F.col(f"{c}_median")), F.col(f"{c}_lo")), F.col(f"{c}_hi"))
        joined = joined.withColumns({f"{c}_x": (full - F.col(f"{c}_mean")) / F.col(f"{c}_std"), f"{c}_imputed": F.col(c).isNull()})
    return joined.drop(*[f"{c}_{p}" for c in columns for p in ("median", "lo", "hi", "mean", "std")])


def linear_score(features: Column, weights: Sequence[float], intercept: float = 0.0) -> Column:
    """Dot product of an array of features with stored weights."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(features, w, lambda a, b: a.cast("double") * b), F.lit(float(intercept)), lambda s, x: s + x)


def integrity(assigned: DataFrame, key: str, label_end: str, available: str) -> DataFrame:
    """(fold, train, evaluated, leaks): training rows whose outcome or label reaches into the evaluated span."""
    leak = (F.col("role") == "TRAIN") & ((F.col(label_end) >= F.col("val_start")) | (F.col(available) > F.col("val_start")))
    return assigned.groupBy("fold").agg(F.count_if(F.col("role") == "TRAIN").alias("train"), F.count_if(F.col("role").isin("VALIDATION", "TEST")).alias("evaluated"), F.count_if(leak).alias("leaks"))
