"""Price bars and calendars: building bars, sessions, gaps and data checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_bars(ticks: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """(key, session_date, open, high, low, close, volume) from ticks; volume counts them.

    Of several ticks at a day's first or last instant the one with the smallest tie, a number, is its open or close, as SQL's arg_min and arg_max take the first.
    """
    first, last = F.struct(at, tie), F.struct(F.col(at), -F.col(tie))
    return ticks.groupBy(key, F.to_date(at).alias("session_date")).agg(
        F.min_by(value, first).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, last).alias("close"), F.count("*").alias("volume")
    )


def calendar(bars: DataFrame, day: str) -> DataFrame:
    """(session_date, ordinal): all days on which anything traded, numbered without gaps."""
    days = bars.select(F.col(day).alias("session_date")).distinct()
    return days.withColumn("ordinal", F.row_number().over(Window.orderBy("session_date")))


def with_ordinal(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """bars with the ordinal of their session; a calendar has some thousand days, and is broadcast."""
    return bars.join(F.broadcast(sessions), "session_date")


def contiguous(ordinal: str, n: int, w: Window) -> Column:
    """True where the bar and the n before it are on consecutive sessions."""
    return F.coalesce(F.col(ordinal) - F.lag(ordinal, n).over(w) == n, F.lit(False))


def missing_sessions(bars: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """(key, session_date) of sessions between a key's first and last bar on which it has none."""
    span = bars.groupBy(key).agg(F.min("session_date").alias("__a"), F.max("session_date").alias("__b"))
    due = span.join(F.broadcast(sessions), F.col("session_date").between(F.col("__a"), F.col("__b"))).select(key, "session_date")
    return due.join(bars.select(key, "session_date"), [key, "session_date"], "left_anti")


def bar_findings(currency: str | None = None, expected: str | None = None) -> Column:
    """array<string>: what is wrong with a bar."""
    prices = ["open", "high", "low", "close"]
    bad = lambda test: F.coalesce(F.greatest(*[test(F.col(c)) for c in prices]), F.lit(False))
    eps = F.lit(1e-9)
    checks: list[tuple[str, Column]] = [
        ("non_finite", bad(lambda c: F.isnan(c) | (F.abs(c) == float("inf"))) | F.col("close").isNull()),
        ("non_positive", bad(lambda c: c <= 0)),
        ("high_below_low", F.col("high") < F.col("low") - eps),
        ("outside_range", (F.greatest("open", "close") > F.col("high") + eps) | (F.least("open", "close") < F.col("low") - eps)),
        ("negative_volume", F.col("volume") < 0),
        ("zero_volume", F.col("volume") == 0),
    ]
    if currency:
        checks.append(("currency_mismatch", F.col(currency) != F.lit(expected)))
    return F.array_compact(F.array(*[F.when(c, n) for n, c in checks]))


def price_jumps(bars: DataFrame, key: str, limit: float) -> DataFrame:
    """Bars whose close moved by more than limit against the last accepted bar of the key.

    A rejected bar is not compared with, so that this is a fold over the key's bars in order.
    """
    row = F.struct("session_date", "close")
    lists = bars.filter("close is not null").groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("__bars"))
    fold = F.expr(f"""
        aggregate(__bars, struct(cast(null as double) as last, cast(array() as array<struct<session_date:date,close:double,before:double>>) as jumps),
            (acc, b) -> if(acc.last is null or abs(try_divide(b.close, acc.last) - 1) <= {limit}D,
                struct(b.close as last, acc.jumps as jumps),
                struct(acc.last as last, concat(acc.jumps, array(struct(b.session_date as session_date, b.close as close, acc.last as before))) as jumps)))""")
    return lists.select(key, F.explode(fold["jumps"]).alias("j")).select(key, "j.*")


def series_report(bars: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """Per key: rows, repeated days, bars off the calendar, missing sessions and the longest gap in days."""
    w = Window.partitionBy(key).orderBy("session_date")
    per = bars.withColumn("__gap", F.datediff("session_date", F.lag("session_date").over(w))).groupBy(key).agg(
        F.count("*").alias("n_bars"),
        (F.count("*") - F.count_distinct("session_date")).alias("n_repeated"),
        F.max("__gap").alias("longest_gap_days"),
        F.count_if(F.size(bar_findings()) > 0).alias("n_bad_bars"),
    )
    lost = missing_sessions(bars, sessions, key).groupBy(key).agg(F.count("*").alias("n_missing"))
    return per.join(lost, key, "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0).cast("long")))


def session_shift(days: DataFrame, day: str, sessions: DataFrame, name: str, forward: bool = True, strict: bool = False) -> DataFrame:
    """days with the first session on or after each (before, if not forward; not on it, if strict)."""
    s = sessions.select(F.col("session_date").alias("__s"))
    test = {(True, False): F.col("__s") >= F.col(day), (True, True): F.col("__s") > F.col(day), (False, False): F.col("__s") <= F.col(day), (False, True): F.col("__s") < F.col(day)}
    pick = F.min("__s") if forward else F.max("__s")
    distinct = days.select(day).distinct()
    found = distinct.join(F.broadcast(s), test[forward, strict], "left").groupBy(day).agg(pick.alias(name))
    return days.join(found, day, "left")


def month_firsts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(F.trunc("session_date", "month").alias("month")).agg(F.min("session_date").alias("session_date"))


def as_columns(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]
