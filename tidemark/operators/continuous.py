"""Features of a market without closing hours: a bar each day, and a window counts only if no day in it is missing."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import log

YEAR = 365


@dataclass(frozen=True)
class Days:
    """Lengths in days."""

    returns: Sequence[int] = (1, 3, 7, 14, 30, 90, 180, 365)
    means: Sequence[int] = (20, 50, 200)
    highs: Sequence[int] = (30, 90, 365)
    vols: Sequence[int] = (7, 30, 90)
    ranges: int = 14
    shape: int = 30
    volumes: Sequence[int] = (1, 7)


def daily_features(bars: DataFrame, key: str, day: str, days: Days = Days()) -> DataFrame:
    """(key, day, close, a column a feature): NULL where the window is not whole.

    bars: key, day, high, low, close, volume. A window of n days is whole if the bar n - 1 before is n - 1 days ago.
    A close of zero has a log return of minus infinity, and skew and kurtosis are corrected for the returns that are there.
    """
    w = Window.partitionBy(key).orderBy(day)
    c, v = F.col("close"), F.col("volume")

    def whole(n: int) -> Column:
        return F.lit(True) if n == 1 else F.coalesce(F.datediff(day, F.lag(day, n - 1).over(w)) == n - 1, F.lit(False))

    def last(n: int):
        return w.rowsBetween(-n + 1, 0)

    before = F.lag("close").over(w)
    step = {"__r": F.when((c > 0) & (before > 0), F.ln(c / before)), "__tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))}
    bars = bars.withColumns(step | {f"__sma_{n}": F.when(whole(n), F.avg(c).over(last(n))) for n in days.means})
    r = F.col("__r")
    f = {f"log_return_{n}": F.when(whole(n + 1), log(F.try_divide(c, F.lag("close", n).over(w)))) for n in days.returns}
    f |= {f"distance_sma_{n}": F.try_divide(c, F.col(f"__sma_{n}")) - 1 for n in days.means}
    f |= {f"sma_{a}_vs_{b}": F.try_divide(F.col(f"__sma_{a}"), F.col(f"__sma_{b}")) - 1 for a, b in zip(days.means, days.means[1:])}
    f |= {f"distance_high_{n}": F.when(whole(n), F.try_divide(c, F.max("high").over(last(n))) - 1) for n in days.highs}
    for n in days.highs[:-1]:
        path = F.aggregate(F.collect_list(c).over(last(n)), F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("low")), lambda s, x: F.struct(F.greatest(s["top"], x).alias("top"), F.least(s["low"], F.try_divide(x, F.greatest(s["top"], x)) - 1).alias("low")))
        f[f"drawdown_{n}"] = F.when(whole(n), path["low"])
    f["drawdown_from_observed_high"] = F.try_divide(c, F.max("high").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1
    f |= {f"realized_vol_{n}": F.when(whole(n + 1), F.stddev_samp(r).over(last(n)) * math.sqrt(YEAR)) for n in days.vols}
    f["atr"] = F.when(whole(days.ranges + 1), F.avg("__tr").over(last(days.ranges)))
    n = days.shape
    k = F.count(r).over(last(n)).cast("double")  # returns to or from a close of zero are not there
    f["skew"] = F.when(whole(n + 1) & (k > 2), F.skewness(r).over(last(n)) * F.sqrt(k * (k - 1)) / (k - 2))
    f["kurtosis"] = F.when(whole(n + 1) & (k > 3), ((k + 1) * F.kurtosis(r).over(last(n)) + 6) * (k - 1) / ((k - 2) * (k - 3)))
    f |= {f"volume_change_{k}": F.when(whole(k + 1), F.try_divide(v, F.lag("volume", k).over(w)) - 1) for k in days.volumes}
    f["volume_z"] = F.when(whole(n), F.try_divide(v - F.avg(v).over(last(n)), F.stddev_samp(v).over(last(n))))
    return bars.select(key, day, "close", *[x.alias(k) for k, x in f.items()])


def derivative_states(rows: DataFrame, price_return: str, interest_change: str, funding: str, funding_z: str) -> DataFrame:
    """rows with the four states of price against open interest, and funding far from its own mean: 1, 0, or NULL where an input is missing."""
    p, oi, z, f = (F.col(x) for x in (price_return, interest_change, funding_z, funding))
    state = lambda cond: F.when(p.isNotNull() & oi.isNotNull(), cond.cast("int"))
    high = lambda cond: F.when(z.isNotNull() & f.isNotNull(), cond.cast("int"))
    return rows.withColumns({
        "price_up_oi_up": state((p > 0) & (oi > 0)), "price_up_oi_down": state((p > 0) & (oi < 0)), "price_down_oi_up": state((p < 0) & (oi > 0)), "price_down_oi_down": state((p < 0) & (oi < 0)),
        "funding_positive_high": high((z > 2) & (f > 0)), "funding_negative_high": high((z < -2) & (f < 0)),
    })
