"""Path-dependent trades: first touch by windows, positions by a fold, and replay from the event log (the state machine itself is in ``machine``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_touch(path: DataFrame, trade: str, day: str = "session_date") -> DataFrame:
    """(trade, outcome, exit_date, pessimistic, optimistic, mfe, mae) of long trades.

    path: one row per trade and bar after entry, with entry, stop, target, open, high, low, close. A
    gap fills at the open. A bar that touches both levels is AMBIGUOUS: the pessimistic exit takes the
    stop, the optimistic one the target. mfe and mae run to the exit bar. No fold: the first hit is a
    minimum, what comes before it a window.
    """
    stop, target = F.col("low") <= F.col("stop"), F.col("high") >= F.col("target")
    gap_down, gap_up = F.col("open") <= F.col("stop"), F.col("open") >= F.col("target")
    kind = F.when(gap_down, "STOP_GAP").when(gap_up, "TARGET_GAP").when(stop & target, "AMBIGUOUS").when(stop, "STOP").when(target, "TARGET")
    bars = path.withColumn("__kind", kind).withColumn("__hit", F.min(F.when(F.col("__kind").isNotNull(), F.col(day))).over(Window.partitionBy(trade)))
    live = bars.filter(F.col("__hit").isNull() | (F.col(day) <= F.col("__hit")))
    low_fill = F.when(gap_down | gap_up, F.col("open")).when(stop, F.col("stop")).when(target, F.col("target"))
    high_fill = F.when(gap_down | gap_up, F.col("open")).when(target, F.col("target")).when(stop, F.col("stop"))
    last = F.struct(day)
    return live.groupBy(trade).agg(
        F.coalesce(F.max_by("__kind", last), F.lit("OPEN")).alias("outcome"),
        F.max(day).alias("exit_date"),
        (F.max_by(F.try_divide(F.coalesce(low_fill, F.col("close")), F.col("entry")), last) - 1).alias("pessimistic"),
        (F.max_by(F.try_divide(F.coalesce(high_fill, F.col("close")), F.col("entry")), last) - 1).alias("optimistic"),
        (F.max(F.try_divide(F.col("high"), F.col("entry"))) - 1).alias("mfe"),
        (F.min(F.try_divide(F.col("low"), F.col("entry"))) - 1).alias("mae"),
    )


def position_fold(events: DataFrame, key: str, order: list[str], kind: str, quantity: str, price: str) -> DataFrame:
    """(key, quantity, avg_cost, realised, n_events): BUY and SELL events in order; sells keep the average cost and are cut to what is held."""
    item = F.struct(*order, F.col(kind).alias("k"), F.col(quantity).cast("double").alias("q"), F.col(price).cast("double").alias("p"))
    lists = events.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("__e"))
    fold = F.expr("""aggregate(__e, struct(0D as quantity, 0D as avg_cost, 0D as realised),
        (s, e) -> case
            when e.k = 'BUY' then struct(s.quantity + e.q as quantity, (s.quantity * s.avg_cost + e.q * e.p) / (s.quantity + e.q) as avg_cost, s.realised as realised)
            when e.k = 'SELL' then struct(s.quantity - least(e.q, s.quantity) as quantity, if(s.quantity <= e.q, 0D, s.avg_cost) as avg_cost,
                s.realised + least(e.q, s.quantity) * (e.p - s.avg_cost) as realised)
            else s end)""")
    return lists.select(key, fold.alias("s"), F.size("__e").cast("long").alias("n_events")).select(key, "s.*", "n_events")


def position_size(capital: Column, risk_share: Column, entry: Column, stop: Column) -> Column:
    """Whole units that lose no more than the share of capital at the stop, and that capital can pay."""
    risk = F.abs(entry - stop)
    return F.greatest(F.lit(0), F.least(F.floor(F.try_divide(capital * risk_share, risk)), F.floor(F.try_divide(capital, entry))))


def replay(log: DataFrame, trade: str) -> DataFrame:
    """(trade, state, entry, exit, ret, n_events) from the log alone: exits weighted by their fractions; an entry at zero has no return."""
    entry = F.max(F.when(F.col("event") == "ENTRY", F.col("price")))
    sold, share = F.sum(F.col("price") * F.col("fraction")), F.sum("fraction")
    agg = log.groupBy(trade).agg(F.max_by("state", "sequence_number").alias("state"), entry.alias("entry"), sold.alias("__sold"), share.alias("__share"), F.count("*").alias("n_events"))
    exit_price = F.when(F.col("__share") > 0, F.col("__sold") / F.col("__share"))
    return agg.select(trade, "state", "entry", exit_price.alias("exit"), (F.when(F.abs(F.col("__share") - 1) < 1e-9, F.try_divide(exit_price, F.col("entry"))) - 1).alias("ret"), "n_events")


def append_suffix(stored: DataFrame, fresh: DataFrame, trade: str) -> DataFrame:
    """What a rerun adds to a stored log. It fails where the rerun contradicts what is stored."""
    both = fresh.alias("f").join(stored.alias("s"), [trade, "sequence_number"], "left")
    same = F.col("s.event").isNull() | ((F.col("s.event") == F.col("f.event")) & F.col("s.session_date").eqNullSafe(F.col("f.session_date")) & F.col("s.price").eqNullSafe(F.col("f.price")))
    checked = both.filter(F.assert_true(same, "the stored log is no prefix of the rerun").isNull())
    return checked.filter(F.col("s.event").isNull()).select(trade, "sequence_number", *[F.col(f"f.{c}") for c in fresh.columns if c not in (trade, "sequence_number")])
