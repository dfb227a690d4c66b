"""Corporate actions: split factors, adjusted closes, total return, and reconciling several sources.

An action works on a bar if its ex-date has come and it was announced by the analysed instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_between(actions: DataFrame, spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """spans with the product of the split ratios in (start, end]. Spans may be repeated, and may hold nulls (factor 1)."""
    s = actions.filter("kind = 'SPLIT'").select(F.col(key).alias("__k"), F.col("ex_date").alias("__ex"), F.col("ratio").alias("__ratio"))
    hit = (F.col(key) == F.col("__k")) & (F.col("__ex") > F.col(start)) & (F.col("__ex") <= F.col(end))
    factors = spans.select(key, start, end).distinct().join(s, hit).groupBy(key, start, end).agg(F.product("__ratio").alias("split_factor"))
    return spans.join(factors, [key, start, end], "left").withColumn("split_factor", F.coalesce("split_factor", F.lit(1.0)))


def on_sessions(bars: DataFrame, actions: DataFrame, key: str, as_of: Column | None = None) -> DataFrame:
    """(key, session_date, split, cash): what is known by as_of, on the first bar with a close on or after each ex-date.

    Several ex-dates may come to one bar: cash is then put in shares after the last of their splits.
    Actions after the last bar have a NULL session_date, and only those whose day has come by as_of.
    """
    seen = actions if as_of is None else actions.filter((F.col("announced_at") <= as_of) & (F.col("ex_date") <= F.to_date(as_of)))
    split, cash = F.product(F.when(F.col("kind") == "SPLIT", F.col("ratio"))), F.sum(F.when(F.col("kind") == "DIVIDEND", F.col("cash_amount")))
    daily = seen.groupBy(key, F.col("ex_date").alias("__d")).agg(F.coalesce(split, F.lit(1.0)).alias("__split"), F.coalesce(cash, F.lit(0.0)).alias("__cash"))
    days = bars.filter(F.col("close").isNotNull()).select(key, F.col("session_date").alias("__d"), F.lit(None).cast("double").alias("__split"), F.lit(None).cast("double").alias("__cash"), F.col("session_date").alias("__bar"))
    both = daily.withColumn("__bar", F.lit(None).cast(bars.schema["session_date"].dataType)).unionByName(days)
    # Going backwards in time, the last bar seen is the first on or after a day.
    ahead = Window.partitionBy(key).orderBy(F.desc("__d"), F.col("__bar").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = both.withColumn("session_date", F.last("__bar", ignorenulls=True).over(ahead)).filter("__split is not null")
    if as_of is None:
        moved = moved.filter(F.col("session_date").isNotNull())
    so_far = Window.partitionBy(key, "session_date").orderBy("__d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = moved.withColumn("__old", F.col("__cash") * F.product("__split").over(so_far))
    return whole.groupBy(key, "session_date").agg(F.product("__split").alias("split"), (F.sum("__old") / F.product("__split")).alias("cash"))


def total_return(bars: DataFrame, actions: DataFrame, key: str, as_of: Column | None = None) -> DataFrame:
    """bars with gross (s * (close + cash) / close before; NULL on the first bar) and tr_level.

    Cash is per share after the split of the same day. Bars without a close are stepped over: they have
    no gross, the level before, and what happens on them counts on the next bar, as do actions on days
    without a bar.
    """
    joined = bars.join(on_sessions(bars, actions, key, as_of), [key, "session_date"], "left")
    w = Window.partitionBy(key).orderBy("session_date")
    s, d = F.coalesce("split", F.lit(1.0)), F.coalesce("cash", F.lit(0.0))
    before = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    joined = joined.withColumn("gross", F.try_divide(s * (F.col("close") + d), before))
    level = F.product(F.coalesce("gross", F.lit(1.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("tr_level", level).drop("split", "cash")


def adjusted_closes(bars: DataFrame, actions: DataFrame, key: str, as_of: Column | None = None) -> DataFrame:
    """bars with adj_close: later splits divide, later dividends take off their share of the close before.

    All closes before an ex-date are adjusted, whether that day has a bar or not; splits after the last
    bar adjust every close once their day has come by as_of, and dividends there take off the last close.
    """
    placed = on_sessions(bars, actions, key, as_of)
    joined = bars.join(placed, [key, "session_date"], "left")
    w = Window.partitionBy(key).orderBy("session_date")
    before = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    factor = F.coalesce(1 / F.col("split"), F.lit(1.0)) * F.coalesce(1 - F.try_divide(F.col("cash") * F.coalesce("split", F.lit(1.0)), before), F.lit(1.0))
    later = Window.partitionBy(key).orderBy(F.col("session_date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumn("__f", factor).withColumn("adj_close", F.col("close") * F.coalesce(F.product("__f").over(later), F.lit(1.0)))
    if as_of is not None:
        tail = placed.filter(F.col("session_date").isNull()).select(key, F.col("split").alias("__ts"), F.col("cash").alias("__tc"))
        out = out.withColumn("__last", F.max_by(F.when(F.col("close").isNotNull(), F.col("close")), F.when(F.col("close").isNotNull(), F.col("session_date"))).over(Window.partitionBy(key))).join(tail, key, "left")
        out = out.withColumn("adj_close", F.col("adj_close") * F.coalesce(1 / F.col("__ts") * F.coalesce(1 - F.try_divide(F.col("__tc") * F.col("__ts"), F.col("__last")), F.lit(1.0)), F.lit(1.0))).drop("__ts", "__tc", "__last")
    return out.drop("split", "cash", "__f")


def until_terminal(path: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """path up to each key's first terminal action, which pays ``cash_amount`` instead of the close of its day."""
    first = actions.filter("kind in ('CASH_MERGER', 'BANKRUPTCY', 'DELISTING')").groupBy(key).agg(F.min_by(F.struct("ex_date", "cash_amount"), F.struct("ex_date", "kind")).alias("__t"))
    joined = path.join(first, key, "left")
    kept = joined.filter(F.col("__t").isNull() | (F.col("session_date") <= F.col("__t.ex_date")))
    at = F.col("session_date") == F.col("__t.ex_date")
    return kept.withColumn("close", F.when(at, F.coalesce("__t.cash_amount", "close")).otherwise(F.col("close"))).withColumn("terminal", F.coalesce(at, F.lit(False))).drop("__t")


def collapse_sources(actions: DataFrame, key: str, days: int = 5) -> DataFrame:
    """One row for what several sources report of one event: dividends of one ex-date, and equal splits within ``days``.

    The better tier stays, then the earlier known, then the smaller id. A key's splits are folded in
    that order: each one is kept unless a kept one is as near and as large.
    """
    order = ["tier", "announced_at", "action_id"]
    div = actions.filter("kind = 'DIVIDEND'").withColumn("__r", F.row_number().over(Window.partitionBy(key, "ex_date").orderBy(*order))).filter("__r = 1").drop("__r")
    item = F.struct(*order, *[c for c in actions.columns if c not in (*order, key)])
    lists = actions.filter("kind = 'SPLIT'").groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("__a"))
    kept = F.expr(f"""aggregate(__a, slice(__a, 1, 0), (acc, x) -> if(
        exists(acc, k -> abs(datediff(k.ex_date, x.ex_date)) <= {days} and abs(k.ratio - x.ratio) <= 1e-9), acc, concat(acc, array(x))))""")
    splits = lists.select(key, F.explode(kept).alias("x")).select(key, "x.*").select(*actions.columns)
    return div.unionByName(splits).unionByName(actions.filter("kind not in ('DIVIDEND', 'SPLIT')"))


def compare_sources(official: DataFrame, vendor: DataFrame, key: str, days: int = 5, cash_tolerance: float = 0.01) -> DataFrame:
    """official with the nearest vendor row of its class and the verdict MATCH, DISAGREEMENT or MISSING."""
    from .asof import nearest_match

    right = vendor.select(key, "kind", F.col("ex_date").alias("vendor_date"), F.col("ratio").alias("vendor_ratio"), F.col("cash_amount").alias("vendor_cash"))
    both = nearest_match(official, right, [key, "kind"], "ex_date", "vendor_date", days, ["vendor_ratio", "vendor_cash"])
    diffs = F.array_compact(F.array(
        F.when(F.col("days_apart") > 0, "ex_date"),
        F.when(F.abs(F.col("ratio") - F.col("vendor_ratio")) > 1e-9, "ratio"),
        F.when(F.abs(F.col("cash_amount") - F.col("vendor_cash")) > cash_tolerance, "cash_amount"),
    ))
    verdict = F.when(F.col("days_apart").isNull(), "MISSING").when(F.size(diffs) == 0, "MATCH").otherwise("DISAGREEMENT")
    return both.withColumn("diffs", F.when(F.col("days_apart").isNotNull(), F.array_join(diffs, ","))).withColumn("verdict", verdict)


def compare_bars(a: DataFrame, b: DataFrame, keys: list[str], small: float = 0.005) -> DataFrame:
    """(status, n): days of two sources as EXACT, SMALL, LARGE, ONLY_A or ONLY_B."""
    x = a.select(*keys, F.col("close").alias("__a"), F.lit(True).alias("__in_a"))
    y = b.select(*keys, F.col("close").alias("__b"), F.lit(True).alias("__in_b"))
    gap = F.abs(F.try_divide(F.col("__a"), F.col("__b")) - 1)
    status = F.when(F.col("__in_b").isNull(), "ONLY_A").when(F.col("__in_a").isNull(), "ONLY_B").when(F.col("__a") == F.col("__b"), "EXACT").when(gap <= small, "SMALL").otherwise("LARGE")
    return x.join(y, keys, "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
