"""Value along mergers: what a share becomes when its issuer is acquired, split off or closed, and total return through it.

A holder of an acquired security holds its acquirer's from then on, and so on. ``holdings`` closes these
steps over keys in the order of time; the value of a share on a day is then one as-of join with the closes
of whoever it has become. Chains are followed in rounds, a row for each step; they are as long as a row of
mergers is, and securities of many acquisitions are a join key like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .actions import on_sessions
from .asof import as_of_join
from .lineage import cut

SHARES = ("SPLIT", "REVERSE_SPLIT", "STOCK_DIVIDEND")
CASH = ("CASH_DIVIDEND", "SPECIAL_DIVIDEND", "RETURN_OF_CAPITAL")
IN_KIND = ("SPINOFF", "RIGHTS_ISSUE", "SCRIP_DIVIDEND")
TERMINAL = ("CASH_ACQUISITION", "STOCK_ACQUISITION", "BANKRUPTCY", "DELISTING", "MERGER")


def terminals(actions: DataFrame, key: str, as_of: Column | None = None) -> DataFrame:
    """(key, day, kind, ratio, cash, target, value, conflict): what ends each key, its first terminal day as known by as_of.

    A delisting beside another kind is that kind's; other kinds of one day contradict each other (conflict).
    """
    seen = actions.filter(F.col("kind").isin(*TERMINAL) & F.col("ex_date").isNotNull())
    seen = seen if as_of is None else seen.filter((F.col("announced_at") <= as_of) & (F.col("ex_date") <= F.to_date(as_of)))
    first = seen.withColumn("day", F.min("ex_date").over(Window.partitionBy(key))).filter("ex_date = day")
    order = F.struct((F.col("kind") == "DELISTING").alias("d"), "action_id")
    best = F.min_by(F.struct("kind", "ratio", F.col("cash_amount").alias("cash"), F.col("target_key").alias("target"), F.col("value_per_share").alias("value")), order)
    per = first.groupBy(key, "day").agg(best.alias("t"), (F.count_distinct(F.when(F.col("kind") != "DELISTING", F.col("kind"))) > 1).alias("conflict"))
    return per.select(key, "day", "t.*", "conflict")


def holdings(ends: DataFrame, key: str) -> DataFrame:
    """(key, since, until, holder, factor, problem): what a share of each key that is acquired for shares becomes, step by step.

    ends is what ``terminals`` gives. since and until bound a step's days, NULL where open. A step into a security
    that had ended before is TARGET_GONE, one that comes back to a security of the chain CYCLE; both end it.
    """
    kind = ends.schema[key].dataType
    steps = cut(ends.filter("kind = 'STOCK_ACQUISITION' and not conflict and target is not null and ratio is not null").select(F.col(key).alias("__from"), F.col("day").alias("__on"), "target", "ratio"))
    gone = cut(ends.select(F.col(key).alias("target"), F.col("day").alias("__ended")))
    now = steps.select(F.col("__from").alias(key), F.lit(None).cast("date").alias("since"), F.col("__from").alias("holder"), F.lit(1.0).alias("factor"), F.array("__from").alias("path"), F.lit(None).cast("string").alias("problem"))
    every = now
    while True:
        ahead = now.filter("problem is null").join(steps, (F.col("holder") == F.col("__from")) & (F.col("since").isNull() | (F.col("__on") >= F.col("since"))))
        ahead = ahead.join(gone, "target", "left")
        problem = F.when(F.array_contains("path", F.col("target")), "CYCLE").when(F.col("__ended") < F.col("__on"), "TARGET_GONE")
        now = cut(ahead.select(key, F.col("__on").alias("since"), F.col("target").cast(kind).alias("holder"), (F.col("factor") * F.col("ratio")).alias("factor"), F.concat("path", F.array(F.col("target").cast(kind))).alias("path"), problem.alias("problem")))
        if now.isEmpty():
            break
        every = every.unionByName(now)
    step = Window.partitionBy(key).orderBy(F.size("path"))
    return cut(every.withColumn("until", F.lead("since").over(step)).select(key, "since", "until", "holder", "factor", "problem"))


def followed_close(asked: DataFrame, held: DataFrame, bars: DataFrame, key: str, day: str, stale: int = 7) -> DataFrame:
    """asked (key, day and others) with holder, value and problem: the last close, at most ``stale`` days old, of what a share of key has become by the day, in shares of key.

    Keys that are never acquired hold themselves. Steps of one day count in their order, the last one holds.
    """
    h = held.select(F.col(key).alias("__k"), "since", "until", "holder", "factor", "problem")
    at = (F.col(key) == F.col("__k")) & (F.col("since").isNull() | (F.col("since") <= F.col(day))) & (F.col("until").isNull() | (F.col(day) < F.col("until")))
    both = asked.join(h, at, "left").withColumns({"holder": F.coalesce("holder", F.col(key)), "factor": F.coalesce("factor", F.lit(1.0))}).drop("__k", "since", "until")
    closes = bars.filter("close is not null").select(F.col(key).alias("holder"), F.col("session_date").alias("__d"), "close")
    priced = as_of_join(both, closes.select("holder", "__d", F.col("close").alias("__c"), F.col("__d").alias("__cd")), ["holder"], day, "__d", ["__c", "__cd"])
    fresh = F.col("problem").isNull() & (F.datediff(day, "__cd") <= stale)
    return priced.withColumn("value", F.when(fresh, F.col("factor") * F.col("__c"))).drop("__c", "__cd", "factor")


def total_return_in_kind(bars: DataFrame, actions: DataFrame, key: str, as_of: Column | None = None, stale: int = 7) -> DataFrame:
    """(key, session_date, close, gross, tr_level, note, problem) for each bar up to each key's end, and for the day of the end.

    gross is s * (close + cash) / before + in kind / before; at the end what is paid / before: cash, the ratio of
    what the acquirer's share is worth, the recovery of a bankruptcy (0 if none is told), or the last close where
    nothing is told. What is paid in kind is worth what the action says, else the ratio of the spun-off share. A value
    that cannot be told is a problem (UNVALUED, CONFLICT of terminal kinds, CYCLE, TARGET_GONE) and leaves no level
    from there on; nothing is taken to be zero. ``refuse_problems`` makes it an error.
    """
    ends = cut(terminals(actions, key, as_of))
    held = holdings(ends, key)
    end = ends.select(key, F.col("day").alias("__end"))
    open_ = bars.filter("close is not null").join(end, key, "left").filter("__end is null or session_date < __end").select(key, "session_date", "close")
    known = actions if as_of is None else actions.filter((F.col("announced_at") <= as_of) & (F.col("ex_date") <= F.to_date(as_of)))
    known = known.join(end, key, "left").filter("__end is null or ex_date < __end").drop("__end")

    plain = known.withColumn("kind", F.when(F.col("kind").isin(*SHARES), "SPLIT").when(F.col("kind").isin(*CASH), "DIVIDEND")).filter("kind is not null")
    on_bar = on_sessions(open_, plain, key).select(key, "session_date", "split", "cash")
    kind = known.filter(F.col("kind").isin(*IN_KIND))
    on = open_.select(key, F.col("session_date").alias("__on"), F.col("session_date").alias("__bar"))
    moved = as_of_join(kind, on, [key], "ex_date", "__on", ["__bar"], forward=True).filter("__bar is not null")
    spun = F.col("kind") == "SPINOFF"
    asked = moved.select(F.col(key).alias("__of"), F.col("target_key").alias(key), "__bar", "value_per_share", "ratio", spun.alias("__spun"))
    worth = followed_close(asked, held, bars, key, "__bar", stale)
    value = F.coalesce("value_per_share", F.when(F.col("__spun"), F.col("ratio") * F.col("value")))
    in_kind = worth.groupBy(F.col("__of").alias(key), F.col("__bar").alias("session_date")).agg(F.sum(value).alias("in_kind"), (F.count(F.when(value.isNull(), 1)) > 0).alias("unvalued"), F.max("problem").alias("kind_problem"))

    priced = followed_close(ends.select(F.col(key).alias("__of"), F.col("target").alias(key), "day", "kind", "ratio", "cash", F.col("value").alias("told"), "conflict"), held, bars, key, "day", stale)
    paid = F.when(F.col("kind") == "CASH_ACQUISITION", F.col("cash")).when(F.col("kind") == "STOCK_ACQUISITION", F.col("ratio") * F.col("value")).when(F.col("kind") == "BANKRUPTCY", F.coalesce("told", F.lit(0.0)))
    trouble = F.when(F.col("conflict"), "CONFLICT").when(F.col("kind").isin("DELISTING", "MERGER"), None).when(paid.isNull(), F.coalesce("problem", F.lit("UNVALUED")))
    last = priced.select(F.col("__of").alias(key), F.col("day").alias("session_date"), "kind", F.when(~F.col("conflict"), paid).alias("paid"), trouble.alias("problem"))
    own = bars.select(key, "session_date", F.col("close").alias("__own"))
    last = last.join(own, [key, "session_date"], "left")

    rows = open_.join(on_bar, [key, "session_date"], "left").join(in_kind, [key, "session_date"], "left").withColumn("problem", F.when(F.col("unvalued"), F.coalesce("kind_problem", F.lit("UNVALUED"))))
    both = rows.select(key, "session_date", "close", "split", "cash", "in_kind", "problem").unionByName(last.select(key, "session_date", "kind", "paid", "problem", "__own"), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("session_date")
    before = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flat = F.coalesce("paid", F.when(F.col("kind").isin("DELISTING", "MERGER"), F.coalesce("__own", "__before")))
    normal = F.coalesce("split", F.lit(1.0)) * (F.col("close") + F.coalesce("cash", F.lit(0.0))) + F.coalesce("in_kind", F.lit(0.0))
    both = both.withColumn("__before", before)
    gross = F.when(F.col("problem").isNull(), F.try_divide(F.when(F.col("kind").isNotNull(), flat).otherwise(normal), F.col("__before")))
    both = both.withColumns({"gross": gross, "close": F.when(F.col("kind").isNotNull(), flat).otherwise(F.col("close")), "note": F.col("kind")})
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    lost = F.max(F.col("problem").isNotNull()).over(so_far)
    both = both.withColumn("tr_level", F.when(~lost, F.product(F.coalesce("gross", F.lit(1.0))).over(so_far)))
    # An end on the first day has nothing before it, and is no return.
    return both.filter("kind is null or __before is not null").select(key, "session_date", "close", "gross", "tr_level", "note", "problem")


def refuse_problems(returns: DataFrame) -> DataFrame:
    """returns, whose reading fails on a row with a problem."""
    said = F.concat(F.lit("total return is undefined: "), F.col("problem"), F.lit(" on "), F.col("session_date").cast("string"))
    return returns.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(said).cast("string")))
