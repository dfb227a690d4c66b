"""Universe membership from events, walking sets back and forth, and succession chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def build_membership(events: DataFrame, keys: Sequence[str], at: str, order: Sequence[str]) -> DataFrame:
    """(keys, valid_from, valid_to, status) from ADD and DELETE events.

    A repeated event of the same kind changes nothing; an interval opens at the first ADD and closes at
    the next DELETE.
    """
    w = Window.partitionBy(*keys).orderBy(at, *order)
    turns = events.withColumn("__was", F.lag("kind").over(w)).filter((F.col("__was").isNull() & (F.col("kind") == "ADD")) | (F.col("__was") != F.col("kind")))
    spans = turns.withColumn("valid_to", F.lead(at).over(w)).filter("kind = 'ADD'")
    return spans.select(*keys, F.col(at).alias("valid_from"), "valid_to", F.when(F.col("valid_to").isNull(), "ACTIVE").otherwise("CLOSED").alias("status"))


def sequence_errors(events: DataFrame, keys: Sequence[str], at: str, order: Sequence[str]) -> DataFrame:
    """Events out of turn: an ADD of a member, or a DELETE of what is none."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    was = F.lag("kind").over(w)
    error = F.when((F.col("kind") == "ADD") & (was == "ADD"), "ALREADY_PRESENT").when((F.col("kind") == "DELETE") & (was.isNull() | (was == "DELETE")), "NOT_PRESENT")
    return events.withColumn("error", error).filter("error is not null")


def size_over_time(membership: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, at, members): how many members a group has from each change on."""
    steps = membership.select(*groups, F.col("valid_from").alias("at"), F.lit(1).alias("__d")).unionByName(membership.filter("valid_to is not null").select(*groups, F.col("valid_to").alias("at"), F.lit(-1).alias("__d")))
    per = steps.groupBy(*groups, "at").agg(F.sum("__d").alias("__d"))
    return per.withColumn("members", F.sum("__d").over(Window.partitionBy(*groups).orderBy("at"))).drop("__d")


def members_at(membership: DataFrame, at) -> DataFrame:
    return membership.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def undo(anchor: DataFrame, events: DataFrame, keys: Sequence[str], at: str, back_to) -> DataFrame:
    """(keys, member, consistent): the set of an anchor, walked back through its events after an instant.

    The state before is the state now less later adds plus later deletes; anything but 0 and 1 means
    that the events contradict the anchor.
    """
    step = F.sum(F.when(F.col("kind") == "ADD", -1).otherwise(1)).alias("__d")
    moved = events.filter(F.col(at) > back_to).groupBy(*keys).agg(step)
    both = anchor.select(*keys, F.lit(1).alias("__in")).join(moved, list(keys), "full_outer")
    state = F.coalesce("__in", F.lit(0)) + F.coalesce("__d", F.lit(0))
    return both.select(*keys, (state == 1).alias("member"), state.isin(0, 1).alias("consistent"))


def replay(start: DataFrame, events: DataFrame, keys: Sequence[str], at: str, after, until) -> DataFrame:
    """(keys, member, consistent): a set walked forward through the events in (after, until]."""
    step = F.sum(F.when(F.col("kind") == "ADD", 1).otherwise(-1)).alias("__d")
    moved = events.filter((F.col(at) > after) & (F.col(at) <= until)).groupBy(*keys).agg(step)
    both = start.select(*keys, F.lit(1).alias("__in")).join(moved, list(keys), "full_outer")
    state = F.coalesce("__in", F.lit(0)) + F.coalesce("__d", F.lit(0))
    return both.select(*keys, (state == 1).alias("member"), state.isin(0, 1).alias("consistent"))


def set_difference(a: DataFrame, b: DataFrame, group: Sequence[str], member: str) -> DataFrame:
    """(group, member, side): members of one composition that the other lacks."""
    x, y = a.select(*group, member, F.lit(True).alias("__a")), b.select(*group, member, F.lit(True).alias("__b"))
    both = x.join(y, [*group, member], "full_outer").filter("__a is null or __b is null")
    return both.select(*group, member, F.when(F.col("__b").isNull(), "ONLY_A").otherwise("ONLY_B").alias("side"))


def succession_closure(edges: DataFrame, old: str, new: str) -> DataFrame:
    """(old, final, steps): each predecessor with its last successor. Chains double in length each round.

    Edges have one successor per predecessor. A chain ends within as many rounds as the logarithm of the
    edges; what moves longer is on a cycle or leads to one, has no final successor and is left out.
    """
    now = cut(edges.select(F.col(old).alias("o"), F.col(new).alias("n"), F.lit(1).cast("long").alias("s")).filter("o <> n"))
    for _ in range(max(now.count(), 1).bit_length() + 1):
        ahead = now.select(F.col("o").alias("n"), F.col("n").alias("n2"), F.col("s").alias("s2"))
        step = now.join(ahead, "n", "left").select("o", F.coalesce("n2", "n").alias("n"), (F.col("s") + F.coalesce("s2", F.lit(0))).alias("s"), F.col("n2").isNotNull().alias("moved"))
        step = cut(step)
        now = step.select("o", "n", "s")
        if step.filter("moved").isEmpty():
            break
    ends = now.join(edges.select(F.col(old).alias("n")).distinct(), "n", "left_anti")
    return ends.select(F.col("o").alias(old), F.col("n").alias("final"), F.col("s").alias("steps"))


def one_candidate(left: DataFrame, right: DataFrame, on: Sequence[str], take: str) -> DataFrame:
    """left with the value of ``take`` where exactly one exists for its key, else NULL and AMBIGUOUS or NONE."""
    per = right.groupBy(*on).agg(F.count_distinct(take).alias("__n"), F.min(take).alias("__v"))
    both = left.join(per, list(on), "left")
    status = F.when(F.col("__n").isNull(), "NONE").when(F.col("__n") > 1, "AMBIGUOUS").otherwise("UNIQUE")
    return both.withColumn(take, F.when(F.col("__n") == 1, F.col("__v"))).withColumn("status", status).drop("__n", "__v")
