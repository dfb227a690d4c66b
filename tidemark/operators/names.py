"""Names and tickers as of a day: who held a name then, through changes and reuse.

Taking a name is a node: a listing, or a change from another name. The parent of a change is the last
node of its old name before its day, which one as-of join finds for all changes; whose name it is follows
by doubling over parents. So a change is resolved by the graph as it stood the day before, a name that is
used again belongs to its last taker, and a link from the future has no part in an earlier day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import as_of_join
from .lineage import cut


def name_history(listings: DataFrame, changes: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(node, name, since, until, security, status): every taking of a name, and whose it was.

    listings: security, name, since. changes: change (an id), old, new, day, and known if as_of is given: changes
    not known by then have no part. A name is left by the first change from it, or when another takes it, until is
    that day. status is HELD; UNKNOWN_NAME for a change from a name that nobody had; NOT_HELD for one from a name
    already left, and for what follows from a refused change.
    """
    seen = changes if as_of is None else changes.filter(F.col("known") <= as_of)
    seen = seen.filter("old is not null and new is not null and day is not null")
    first = listings.select(F.concat(F.lit("L:"), F.col("security").cast("string"), F.lit(":"), "name", F.lit(":"), F.col("since").cast("string")).alias("node"), "name", "since", F.col("security").cast("string").alias("security"), F.lit(None).cast("string").alias("old"))
    taken = seen.select(F.concat(F.lit("C:"), F.col("change").cast("string")).alias("node"), F.col("new").alias("name"), F.col("day").alias("since"), F.lit(None).cast("string").alias("security"), "old")
    nodes = cut(first.unionByName(taken).dropDuplicates(["node"]))
    # The last node of the old name before the day; of several nodes of a day the one with the largest id.
    last = nodes.groupBy("name", "since").agg(F.max("node").alias("parent"))
    asked = nodes.filter("old is not null").select("node", F.col("old").alias("name"), "since")
    parents = as_of_join(asked, last.select("name", F.col("since").alias("__s"), "parent"), ["name"], "since", "__s", ["parent"], strict=True)
    parents = cut(parents.select("node", "since", "parent"))
    nth = F.row_number().over(Window.partitionBy("parent").orderBy("since", "node"))
    graded = parents.withColumn("own", F.when(F.col("parent").isNull(), "UNKNOWN_NAME").when(nth > 1, "NOT_HELD"))
    left = graded.filter("own is null").select(F.col("parent").alias("node"), F.col("since").alias("left"))
    now = nodes.select("node", "security").join(graded.select("node", "parent", "own"), "node", "left")
    now = cut(now.select("node", F.coalesce("parent", "node").alias("to"), F.col("own").alias("problem")))
    while True:  # chains double in length each round
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("problem").alias("theirs"))
        step = now.join(ahead, "to", "left")
        inherited = F.coalesce("problem", F.when(F.col("theirs").isNotNull(), "NOT_HELD"))
        moved = cut(step.select("node", F.coalesce("next", "to").alias("to"), inherited.alias("problem"), (F.coalesce("next", "to") != F.col("to")).alias("moved")))
        now = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    root = nodes.filter("security is not null").select(F.col("node").alias("to"), F.col("security").alias("of"))
    whole = nodes.select("node", "name", "since").join(now, "node").join(root, "to", "left").join(left, "node", "left")
    # The next taker of the name, by day; takers of one day follow each other at once.
    taker = F.lead("since").over(Window.partitionBy("name").orderBy("since", "node"))
    out = whole.withColumn("until", F.least("left", taker))
    status = F.coalesce("problem", F.lit("HELD"))
    return out.select("node", "name", "since", "until", F.when(status == "HELD", F.col("of")).alias("security"), status.alias("status"))


def names_as_of(points: DataFrame, history: DataFrame, name: str, at: str) -> DataFrame:
    """points with security, status and node: who held the name on the day. HELD, LEFT (its last holder had left it), REFUSED (its last taking is not proven) or UNKNOWN."""
    last = history.withColumn("__o", F.row_number().over(Window.partitionBy("name", "since").orderBy(F.desc("node")))).filter("__o = 1")
    last = last.select(F.col("name").alias(name), F.col("since").alias("__s"), F.struct("node", "until", "security", F.col("status").alias("state")).alias("__h"))
    found = as_of_join(points, last, [name], at, "__s", ["__h"])
    h = F.col("__h")
    status = F.when(h.isNull(), "UNKNOWN").when(h["state"] != "HELD", "REFUSED").when(h["until"] <= F.col(at), "LEFT").otherwise("HELD")
    return found.withColumn("status", status).withColumn("security", F.when(F.col("status") == "HELD", h["security"])).withColumn("node", h["node"]).drop("__h")


def rename_links(statements: DataFrame, sightings: DataFrame) -> DataFrame:
    """statements (id, old, new, announced) with old_security, new_security, status and reason.

    sightings: name, security, day on which a composition showed it. The old name must be of exactly one security seen by
    the announcement, the new one of exactly one seen from it on, and the two must differ (LINKED); else the statement is SKIPPED.
    Names are compared as given: normalise them first.
    """
    spans = sightings.groupBy("name", "security").agg(F.min("day").alias("first"), F.max("day").alias("last"))

    def side(name: str, seen: Column, out: str) -> DataFrame:
        hit = statements.select("id", F.col(name).alias("name"), "announced").join(spans, "name").filter(seen)
        return hit.groupBy("id").agg(F.count_distinct("security").alias(f"{out}_n"), F.min("security").alias(out))

    both = statements.join(side("old", F.col("first") <= F.col("announced"), "old_security"), "id", "left").join(side("new", F.col("last") >= F.col("announced"), "new_security"), "id", "left")
    both = both.fillna(0, ["old_security_n", "new_security_n"])
    one = (F.col("old_security_n") == 1) & (F.col("new_security_n") == 1)
    same = F.col("old_security").eqNullSafe(F.col("new_security"))
    reason = F.when(~one, F.format_string("old name has %d securities, new name %d", "old_security_n", "new_security_n")).when(same, "the name is still the same security's")
    keep = one & ~same
    return both.select(*statements.columns, *[F.when(keep, F.col(c)).alias(c) for c in ("old_security", "new_security")], F.when(keep, "LINKED").otherwise("SKIPPED").alias("status"), reason.alias("reason"))
