"""Queries of membership between dated compositions: nations are pools, customers securities, orders what is said of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as I
from ..operators import segments as S
from ..sources.tables import table
from .registry import query

YEARS = (1995, 1996, 1997, 1998, 1999, 2000, 2001)


def world(spark, sf):
    """Compositions at each New Year's Eve; a customer is a member by key and year. Orders of the year of a change tell of it, with a day or a month's span; others are claims."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name")
    years = F.array(*[F.lit(y) for y in YEARS])
    held = lambda y: (F.col("c_custkey") * 31 + y * 17) % 5 != 0
    eve = F.make_date(F.col("y") - 1, F.lit(12), F.lit(31))
    every = c.withColumn("y", F.explode(years))
    members = every.filter(held(F.col("y"))).select(F.col("c_nationkey").alias("pool"), eve.alias("as_of"), F.col("c_custkey").cast("string").alias("security"), F.lit(None).cast("string").alias("issuer"), F.col("c_name").alias("name"), F.lit(1.0).alias("shares"), F.lit(False).alias("weak"))
    anchors = c.select("c_nationkey").distinct().withColumn("y", F.explode(years))
    anchors = anchors.select(F.col("c_nationkey").alias("pool"), eve.alias("as_of"), F.date_add(eve, 1).alias("opens"), F.lit(False).alias("early"), F.lit(0).alias("unresolved"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("d")).join(c, "c_custkey").withColumn("y", F.year("d"))
    change = held(F.col("y")) != held(F.col("y") + 1)
    exact = change & (F.col("o_orderkey") % 3 != 0)
    kind = F.when(F.when(change, held(F.col("y") + 1)).otherwise(F.col("o_orderkey") % 2 == 0), "ADD").otherwise("REMOVE")
    legs = o.select(
        F.col("c_nationkey").alias("pool"), F.col("o_orderkey").alias("leg"), F.col("o_orderkey").alias("event"), kind.alias("kind"), F.col("c_custkey").cast("string").alias("ticker"), F.col("c_custkey").cast("string").alias("security"),
        F.when(~change, "CLAIM").when(exact, "CONFIRMED").otherwise("UNDATED").alias("status"), F.when(change, F.col("d")).alias("lo"), F.when(exact, F.col("d")).when(change, F.date_add("d", 30)).alias("hi"),
        exact.alias("exact"), F.col("d").alias("said"), F.lit(None).cast("date").alias("other_day"), F.lit(False).alias("backed"),
    )
    return anchors, members, legs


@query()
def segment_status(spark, sf):
    """No SQL twin: the outcome of a security hangs on the order of its statements; a test holds it against plain loops."""
    found = S.reconcile(*world(spark, sf))
    return found.segments.select("pool", "a", "b", "members_a", "members_b", "confirmed", "gaps", "blocking", "forward_ok", "backward_ok", "status")


@query()
def anchor_members(spark, sf):
    """Who is a member at the open of each first of July, from either end, and who may be. Tested like segment_status."""
    anchors, members, legs = world(spark, sf)
    days = anchors.select("pool", F.make_date(F.year("opens"), F.lit(7), F.lit(1)).alias("day"))
    return S.members_at(S.reconcile(anchors, members, legs), days).select("pool", "day", "security", "forward", "backward", "uncertain")


def observations(spark, sf):
    """Customers' spans of orders with what their orders show: an identifier for each three years, urgent orders are sure of it, pending ones show two candidates or none."""
    c = F.col("o_custkey")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    era = F.floor((F.year("day") - 1992) / 3)
    name = lambda e: F.concat(F.lit("I"), c.cast("string"), F.lit("-"), e.cast("string"))
    spans = o.groupBy("o_custkey").agg(F.date_add(F.min("day"), (F.col("o_custkey") % 4 * 40).cast("int")).alias("start"), F.max("day").alias("last"))
    spans = spans.select(c.alias("span"), "start", F.when(c % 3 != 0, F.date_sub("last", (c % 5 * 60).cast("int"))).alias("stop")).filter("stop is null or stop > start")
    open_, sure = F.col("o_orderstatus") == "P", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    points = o.select(
        c.alias("span"), "day", F.when(~open_, name(era)).alias("isin"), sure.alias("sure"), (sure & (F.col("o_orderkey") % 11 == 0)).alias("exact"),
        F.when(open_ & (F.col("o_orderkey") % 2 == 0), F.array(name(era), name(era + 1))).otherwise(F.array().cast("array<string>")).alias("candidates"),
    )
    eras = o.select("o_custkey").distinct().withColumn("e", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    first = F.make_date(1992 + 3 * F.col("e"), F.lit(1), F.lit(1))
    transitions = eras.filter((F.col("e") > 0) & (c % 2 == 0)).select(name(F.col("e") - 1).alias("old"), name(F.col("e")).alias("new"), F.date_add(first, 20).alias("day"), F.when(c % 4 == 0, "NEW").otherwise("SAME").alias("continuity"))
    issues = eras.select(name(F.col("e")).alias("isin"), c.cast("string").alias("issuer"), F.when(c % 5 != 0, F.date_add(first, 10)).alias("issued"))
    return spans, points, transitions, issues


@query()
def identity_segments(spark, sf):
    """No SQL twin: whether a day holds hangs on the runs before and after it; a test holds it against plain loops over the whole table."""
    return I.identity_segments(*observations(spark, sf), F.lit("2001-12-31").cast("date"))
