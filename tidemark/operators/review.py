"""Trade plans, what is observed of them, evidence labels, and reconciling uncertain membership events."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .machine import OPEN


def trade_levels(price: Column, atr: Column, profile: dict[str, float]) -> list[Column]:
    """entry, stop and targets at 1.5, 2 and 3 times the risk; NULL without a positive range."""
    risk = F.when(atr > 0, atr * profile["stop_atr"])
    entry = price * (1 - profile["pullback"])
    return [entry.alias("entry"), (entry - risk).alias("stop"), *[(entry + risk * k).alias(f"target_{i}") for i, k in enumerate((1.5, 2.0, 3.0), 1)]]


def horizon_levels(price: Column, annual_vol: Column, months: float) -> tuple[Column, Column]:
    """Upper and lower level one deviation away at a horizon."""
    move = annual_vol * math.sqrt(months / 12)
    return price * (1 + move), price * (1 - move)


def observations(path: DataFrame, trade: str, day: str, offsets: Sequence[int]) -> DataFrame:
    """(trade, label, day, close, ret) of the n-th bars after entry, for each offset that a path has reached."""
    n = F.row_number().over(Window.partitionBy(trade).orderBy(day))
    return path.withColumn("__n", n).filter(F.col("__n").isin(*offsets)).select(trade, F.concat(F.lit("T+"), F.col("__n").cast("string")).alias("label"), F.col(day).alias("day"), "close", (F.try_divide(F.col("close"), F.col("entry")) - 1).alias("ret"))


def milestones(log: DataFrame, trade: str) -> DataFrame:
    """(trade, entered, first_target, ended, days_held) from an event log."""
    at = lambda test: F.min(F.when(test, F.col("session_date")))
    ended = at(~F.col("state").isin(*OPEN))
    agg = log.groupBy(trade).agg(at(F.col("event") == "ENTRY").alias("entered"), at(F.col("event") == "TARGET_1").alias("first_target"), ended.alias("ended"))
    return agg.withColumn("days_held", F.datediff("ended", "entered"))


def compare_plans(original: DataFrame, user: DataFrame, trade: str) -> DataFrame:
    """(trade, state, user_state, ret, user_ret, better): the outcomes of two plans of one trade."""
    o, u = original.select(trade, "state", "ret"), user.select(trade, F.col("state").alias("user_state"), F.col("ret").alias("user_ret"))
    gap = F.col("user_ret") - F.col("ret")
    return o.join(u, trade, "full_outer").withColumn("better", F.when(F.abs(gap) < 1e-12, "SAME").when(gap > 0, "USER").when(gap < 0, "ORIGINAL"))


def evidence_label(checks: Sequence[Column], least: int = 3) -> Column:
    """Strong, Moderate or Weak by the share of the known checks that hold; NULL with fewer than ``least`` known."""
    known = sum((c.isNotNull().cast("int") for c in checks), F.lit(0))
    held = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in checks), F.lit(0))
    share = F.try_divide(held.cast("double"), known)
    return F.when(known >= least, F.when(share >= 0.8, "Strong").when(share >= 0.5, "Moderate").otherwise("Weak"))


def collapse_duplicates(legs: DataFrame, key: str) -> DataFrame:
    """(key, kind, lo, hi, exact, n): consecutive legs of one kind for a security are one event.

    legs: key, kind, lo, hi, exact. An exact leg gives the dates, otherwise the widest span does.
    """
    w = Window.partitionBy(key).orderBy("lo", "hi", "kind")
    new = F.coalesce((F.lag("kind").over(w) != F.col("kind")).cast("int"), F.lit(1))
    runs = legs.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    exact = F.min(F.when(F.col("exact"), F.struct("lo", "hi")))
    agg = runs.groupBy(key, "__run", "kind").agg(exact.alias("__x"), F.min("lo").alias("__lo"), F.max("hi").alias("__hi"), F.count("*").alias("n"))
    return agg.select(key, "kind", F.coalesce("__x.lo", "__lo").alias("lo"), F.coalesce("__x.hi", "__hi").alias("hi"), F.col("__x").isNotNull().alias("exact"), "n")


def certain_members(anchor: DataFrame, legs: DataFrame, key: str, at: Column) -> DataFrame:
    """(key, state): IN, OUT or UNCERTAIN at an instant after the anchor, from collapsed legs with their uncertainty [lo, hi].

    A leg has surely happened once hi has come, may have from lo on, and has not before.
    """
    done = legs.filter(F.col("hi") <= at).groupBy(key).agg(F.max(F.struct("hi", "lo", "kind"))["kind"].alias("__last"))
    open_ = legs.filter((F.col("lo") <= at) & (F.col("hi") > at)).select(key).distinct().withColumn("__open", F.lit(True))
    names = anchor.select(key).withColumn("__in", F.lit(True))
    both = names.join(done, key, "full_outer").join(open_, key, "full_outer")
    state = F.when(F.col("__open"), "UNCERTAIN").when(F.coalesce(F.col("__last") == "ADD", F.col("__in"), F.lit(False)), "IN").otherwise("OUT")
    return both.select(key, state.alias("state"))


def match_one_to_one(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str, left_day: str, right_day: str, days: int) -> DataFrame:
    """(group, left_id, right_id, days_apart): pairs within ``days``, nearest first, each row used once.

    Pairs meet in bands of days, never all of a group. Of the pairs left, those that are the nearest of
    both their rows are taken at once, and the pairs of their rows go; rounds are cut until none is left.
    """
    band = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01")) / (days + 1))
    l = left.select(group, F.col(left_id).alias("__l"), F.col(left_day).alias("__ld"), F.explode(F.array(*[band(F.col(left_day)) + k for k in (-1, 0, 1)])).alias("__b"))
    r = right.select(group, F.col(right_id).alias("__r"), F.col(right_day).alias("__rd"), band(F.col(right_day)).alias("__b"))
    open_ = cut(l.join(r, [group, "__b"]).select(group, F.abs(F.datediff("__ld", "__rd")).alias("__g"), "__l", "__r").filter(F.col("__g") <= days).distinct())
    taken = None
    while not open_.isEmpty():
        nearest = {f"__of{side}": F.min(F.struct("__g", "__l", "__r")).over(Window.partitionBy(group, side)) for side in ("__l", "__r")}
        mutual = open_.withColumns(nearest).filter("__of__l = __of__r and __of__l.__l = __l and __of__l.__r = __r")
        now = cut(mutual.select(group, "__g", "__l", "__r"))
        taken = now if taken is None else taken.unionByName(now)
        open_ = cut(open_.join(now.select(group, "__l"), [group, "__l"], "left_anti").join(now.select(group, "__r"), [group, "__r"], "left_anti"))
    found = open_ if taken is None else taken
    return found.select(group, F.col("__l").alias(left_id), F.col("__r").alias(right_id), F.col("__g").alias("days_apart"))


def class_sets(legs: DataFrame, keys: Sequence[str], place: str, pool: str) -> DataFrame:
    """(keys, place, security): legs that are one statement (equal keys: clause, kind, dates, exactness, status, name) and share
    one pool of exactly as many securities are assigned in order of place.

    pool is an array of candidate securities. Which place is which security is not known and does not matter: all have the same
    dates. Legs of one clause with other pools, dates or names are other statements. Nulls among keys are equal.
    """
    one = [F.col(k) for k in keys]
    agg = legs.filter(F.size(pool) > 0).groupBy(*one, F.array_sort(F.array_distinct(pool)).alias("__pool")).agg(F.sort_array(F.collect_list(place)).alias("__places"))
    joint = agg.filter(F.size("__pool") == F.size("__places"))
    return joint.select(*one, F.explode(F.arrays_zip(F.col("__places").alias("place"), F.col("__pool").alias("security"))).alias("z")).select(*one, F.col("z.place").alias(place), "z.security")
