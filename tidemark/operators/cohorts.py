"""Readiness of index cohorts, and how far completed ingestions cover a period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ingestion_state(spans: DataFrame, traces: DataFrame, key: str) -> DataFrame:
    """spans (key, start, end) with state and covered_to.

    traces: key, provider, accepted, status, period_start, period_end. Completed periods of accepted providers
    count as far as they follow each other without a day between, from the span's start on.
    VERIFIED_COVERAGE reaches the span's end, PARTIAL_PERIOD does not; ATTEMPTED_FAILED has attempts and no
    completed one, NOT_ATTEMPTED none by an accepted provider.
    """
    tried = traces.filter("accepted").groupBy(key).agg(F.count("*").alias("__tried"), F.count_if(F.col("status") == "COMPLETED").alias("__done"))
    done = traces.filter("accepted and status = 'COMPLETED'").select(key, "period_start", "period_end")
    both = spans.select(key, "start", "end").join(done, key)
    before = Window.partitionBy(key, "start", "end").orderBy("period_start", "period_end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.coalesce(F.max("period_end").over(before), F.date_sub("start", 1)), F.date_sub("start", 1))
    both = both.withColumn("__gap", (F.col("period_start") > F.date_add(reach, 1)).cast("int"))
    broken = F.sum("__gap").over(Window.partitionBy(key, "start", "end").orderBy("period_start", "period_end").rowsBetween(Window.unboundedPreceding, 0))
    far = both.withColumn("__broken", broken).filter("__broken = 0").groupBy(key, "start", "end").agg(F.max("period_end").alias("__to"))
    out = spans.join(tried, key, "left").join(far, [key, "start", "end"], "left")
    covered = F.when(F.col("__to") >= F.col("start"), F.col("__to"))
    state = F.when(F.col("__tried").isNull(), "NOT_ATTEMPTED").when(F.col("__done") == 0, "ATTEMPTED_FAILED").when(covered >= F.col("end"), "VERIFIED_COVERAGE").otherwise("PARTIAL_PERIOD")
    return out.withColumns({"state": state, "covered_to": F.when(covered.isNotNull(), F.least(covered, F.col("end")))}).drop("__tried", "__done", "__to")


def layers(members: DataFrame, date: str, flags: dict[str, float]) -> DataFrame:
    """(date, members, <flag>_share, <flag>_ready, eligible) a cohort: a layer is ready if its share of members reaches its threshold."""
    agg = members.groupBy(date).agg(F.count("*").alias("members"), *[F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")).alias(f"{f}_share") for f in flags])
    agg = agg.withColumns({f"{f}_ready": F.col(f"{f}_share") >= t for f, t in flags.items()})
    eligible = F.lit(True)
    for f in flags:
        eligible = eligible & F.col(f"{f}_ready")
    return agg.withColumn("eligible", eligible)


def blockers(members: DataFrame, security: str, flags: Sequence[str]) -> DataFrame:
    """(security, layer, dates): on how many dates a member lacks a layer."""
    missing = F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f), F.lit(False)), F.lit(f)) for f in flags])))
    return members.select(security, missing.alias("layer")).groupBy(security, "layer").agg(F.count("*").alias("dates"))


def summary(cohorts: DataFrame, date: str, run: int = 12) -> DataFrame:
    """(total_dates, eligible_dates, first_eligible, first_run, first_complete_year) of monthly cohorts.

    A run is so many eligible months in a row. The months of a calendar are some hundred rows.
    """
    good = cohorts.filter("eligible").select(F.col(date).alias("d"), (F.year(date) * 12 + F.month(date)).alias("o")).groupBy("o").agg(F.min("d").alias("d"))
    islands = good.withColumn("g", F.col("o") - F.row_number().over(Window.orderBy("o"))).groupBy("g").agg(F.min("d").alias("d"), F.count("*").alias("n"))
    years = good.groupBy(F.floor((F.col("o") - 1) / 12).cast("int").alias("y")).agg(F.count("*").alias("n"))
    total = cohorts.agg(F.count("*").alias("total_dates"), F.count_if("eligible").alias("eligible_dates"), F.min(F.when(F.col("eligible"), F.col(date))).alias("first_eligible"))
    return total.withColumns({"first_run": islands.filter(F.col("n") >= run).agg(F.min("d")).scalar(), "first_complete_year": years.filter("n = 12").agg(F.min("y")).scalar()})
