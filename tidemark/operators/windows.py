"""Causal rolling features as columns over a window ordered by session.

Every function takes the ordered window and gives NULL until it has its full history.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import divided

YEAR = 252


def _last(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-n + 1, 0)


def full(value: Column, x: Column, w: WindowSpec, n: int) -> Column:
    """value where x is there on all of the last n bars."""
    return F.when(F.count(x).over(_last(w, n)) == n, value)


def sma(x: Column, w: WindowSpec, n: int) -> Column:
    return full(F.avg(x).over(_last(w, n)), x, w, n)


def change(x: Column, w: WindowSpec, n: int = 1) -> Column:
    """x / x n bars before - 1."""
    return F.try_divide(x, F.lag(x, n).over(w)) - 1


def growth(x: Column, w: WindowSpec, n: int = 1) -> Column:
    """x / x n bars before, divided as doubles are: from zero it is infinite or NaN, not NULL."""
    return divided(x, F.lag(x, n).over(w))


def log_return(x: Column, w: WindowSpec) -> Column:
    before = F.lag(x).over(w)
    return F.when((x > 0) & (before > 0), F.ln(x / before))


def annual_vol(returns: Column, w: WindowSpec, n: int, per_year: int = YEAR) -> Column:
    return full(F.stddev_samp(returns).over(_last(w, n)) * math.sqrt(per_year), returns, w, n)


def downside_vol(returns: Column, w: WindowSpec, n: int, per_year: int = YEAR) -> Column:
    low = F.pow(F.least(returns, F.lit(0.0)), 2)
    return full(F.sqrt(F.avg(low).over(_last(w, n))) * math.sqrt(per_year), returns, w, n)


def distance(x: Column, mean: Column) -> Column:
    return F.try_divide(x, mean) - 1


def bollinger(x: Column, w: WindowSpec, n: int, k: float) -> tuple[Column, Column, Column]:
    """Middle, upper and lower band; the deviation is that of a population."""
    mid, dev = F.avg(x).over(_last(w, n)), F.stddev_pop(x).over(_last(w, n)) * k
    return tuple(full(c, x, w, n) for c in (mid, mid + dev, mid - dev))


def zscore(x: Column, w: WindowSpec, n: int) -> Column:
    return full(F.try_divide(x - F.avg(x).over(_last(w, n)), F.stddev_samp(x).over(_last(w, n))), x, w, n)


def ratio_to_mean(x: Column, w: WindowSpec, n: int) -> Column:
    return full(F.try_divide(x, F.avg(x).over(_last(w, n))), x, w, n)


def skew(x: Column, w: WindowSpec, n: int) -> Column:
    """Bias-corrected sample skewness."""
    return full(F.skewness(x).over(_last(w, n)) * math.sqrt(n * (n - 1)) / (n - 2), x, w, n)


def excess_kurtosis(x: Column, w: WindowSpec, n: int) -> Column:
    """Bias-corrected sample excess kurtosis."""
    g = F.kurtosis(x).over(_last(w, n))
    return full(((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3)), x, w, n)


def compound(factor: Column, w: WindowSpec, n: int) -> Column:
    """Product of the last n factors, less 1."""
    return full(F.product(factor).over(_last(w, n)) - 1, factor, w, n)


def with_drawdown(df: DataFrame, keys: list[str], order: str, level: str, name: str = "drawdown") -> DataFrame:
    """level / highest level so far - 1, and in ``max_<name>`` its worst so far."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(name, F.try_divide(F.col(level), F.max(level).over(w)) - 1)
    return df.withColumn(f"max_{name}", F.min(name).over(w))


def momentum(x: Column, w: WindowSpec, recent: int = 21, far: int = 252) -> Column:
    return F.try_divide(F.lag(x, recent).over(w), F.lag(x, far).over(w)) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, evaluated once."""
    return F.transform(F.array(value), body)[0]


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: the halves of the factors give what the product's rounding leaves out, which joins what the sum's leaves out."""
    whole = F.struct(a.alias("a"), b.alias("b"), c.alias("c"), (a * b).alias("p"), (a * 134217729.0).alias("s"), (b * 134217729.0).alias("t"))
    halves = lambda v: F.struct(v["p"].alias("p"), v["c"].alias("c"), (v["p"] + v["c"]).alias("sum"), *[part for x, y in (("a", "s"), ("b", "t")) for part in ((v[y] - (v[y] - v[x])).alias(x), (v[x] - (v[y] - (v[y] - v[x]))).alias(f"{x}_low"))])
    lost = lambda v: F.struct(v["p"].alias("p"), v["c"].alias("c"), v["sum"].alias("sum"), (((v["a"] * v["b"] - v["p"]) + v["a"] * v["b_low"] + v["a_low"] * v["b"]) + v["a_low"] * v["b_low"]).alias("lost"))
    total = lambda v: F.nanvl(v["sum"] + (((v["p"] - (v["sum"] - (v["sum"] - v["p"]))) + (v["c"] - (v["sum"] - v["p"]))) + v["lost"]), v["sum"])
    return _let(whole, lambda v: _let(halves(v), lambda h: _let(lost(h), total)))


def slope(x: Column, w: WindowSpec, n: int, position: Column) -> Column:
    """Least-squares slope of x over the last n bars: their covariance over the variance of their positions.

    Products join the covariance with one rounding, as in SQL engines, so that slopes which lie at a tie of decimal digits round the same way.
    """
    point = F.when(x.isNotNull() & position.isNotNull(), F.struct(position.cast("double").alias("x"), x.cast("double").alias("y")))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "y", "xy", "xx")])

    def step(s: Column, v: Column) -> Column:
        means = F.struct((s["n"] + 1).alias("n"), (s["x"] + (v["x"] - s["x"]) / (s["n"] + 1)).alias("x"), (s["y"] + (v["y"] - s["y"]) / (s["n"] + 1)).alias("y"))
        return _let(means, lambda m: F.struct(m["n"].alias("n"), m["x"].alias("x"), m["y"].alias("y"), _fused(v["x"] - s["x"], v["y"] - m["y"], s["xy"]).alias("xy"), (s["xx"] + (v["x"] - m["x"]) * (v["x"] - s["x"])).alias("xx")))

    fitted = F.aggregate(F.collect_list(point).over(_last(w, n)), zero, step, lambda s: F.try_divide(F.try_divide(s["xy"], s["n"]), F.try_divide(s["xx"], s["n"])))
    return full(fitted, x, w, n)


def trend_state(signs: list[Column], least: int = 4) -> Column:
    """STRONG_UP .. STRONG_DOWN from the sum of signs, NULL if fewer than ``least`` are known."""
    known = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in signs), F.lit(0))
    total = sum((F.coalesce(F.signum(s), F.lit(0.0)) for s in signs), F.lit(0.0))
    state = F.when(total >= 4, "STRONG_UP").when(total >= 2, "UP").when(total > -2, "NEUTRAL").when(total > -4, "DOWN").otherwise("STRONG_DOWN")
    return F.when(known >= least, state)


def pivots(w: WindowSpec, side: int = 5) -> tuple[Column, Column]:
    """Swing highs and lows, known only ``side`` bars later: strict against the bars before, not strict after."""
    n = F.count(F.lit(1)).over(w.rowsBetween(-side, side))
    high = (F.col("high") > F.max("high").over(w.rowsBetween(-side, -1))) & (F.col("high") >= F.max("high").over(w.rowsBetween(1, side)))
    low = (F.col("low") < F.min("low").over(w.rowsBetween(-side, -1))) & (F.col("low") <= F.min("low").over(w.rowsBetween(1, side)))
    return F.coalesce(high & (n == 2 * side + 1), F.lit(False)), F.coalesce(low & (n == 2 * side + 1), F.lit(False))
