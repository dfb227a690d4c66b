"""Fundamental ratios and valuation multiples at every reported period, with the reason of each missing one.

Periods are quarters in order; everything is a window over a key's own periods, so that the history
of any date is the same rows cut at that date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats

FLOWS = ("revenue", "gross_profit", "operating_income", "net_income", "cfo", "capex")
MULTIPLES = ("pe", "price_to_sales", "price_to_book", "fcf_yield")


def trailing(quarters: DataFrame, keys: Sequence[str], period: str, flows: Sequence[str] = FLOWS, instants: Sequence[str] = ()) -> DataFrame:
    """quarters with <flow>_ttm, <flow>_prior (the same a year before), fcf of both, and <instant>_avg with the value a year before.

    Four quarters make a year if they lie nine months apart; an average needs the value of a year before.
    """
    w = Window.partitionBy(*keys).orderBy(period)
    four = w.rowsBetween(-3, 0)
    whole = F.months_between(period, F.lag(period, 3).over(w)) == 9
    year = F.months_between(period, F.lag(period, 4).over(w)) == 12
    out = quarters.withColumns({f"{f}_ttm": F.when(whole & (F.count(f).over(four) == 4), F.sum(f).over(four)) for f in flows})
    out = out.withColumns({f"{f}_prior": F.when(year, F.lag(f"{f}_ttm", 4).over(w)) for f in flows})
    out = out.withColumns({f"{i}_avg": (F.col(i) + F.when(year, F.lag(i, 4).over(w))) / 2 for i in instants})
    if {"cfo", "capex"} <= set(flows):
        out = out.withColumns({f"fcf_{k}": F.when(F.col(f"capex_{k}") >= 0, F.col(f"cfo_{k}") - F.col(f"capex_{k}")) for k in ("ttm", "prior")})
    return out


def _ratio(a: Column, b: Column) -> tuple[Column, Column]:
    """(value, reason) of a / b with a positive denominator."""
    missing = a.isNull() | b.isNull()
    return F.when(~missing & (b > 0), a / b), F.when(missing, "missing_fundamental").when(b <= 0, "denominator_invalid")


def fundamental_features(trailed: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """(keys, period, feature, value, reason) from the columns of trailing, with assets, equity, cash and debt as instants and shares.

    Total debt may be NULL; growth compares with the trailing year of a year before, and shares with those of then.
    """
    c = F.col
    w = Window.partitionBy(*keys).orderBy(period)
    before = F.when(F.months_between(period, F.lag(period, 4).over(w)) == 12, F.lag("shares", 4).over(w))
    df = trailed.withColumn("__shares_prior", before)
    plain = {f"{k}_ttm": (c(f"{k}_ttm"), F.when(c(f"{k}_ttm").isNull(), "missing_fundamental")) for k in (*FLOWS, "fcf")}
    out = plain | {f"{k}_growth": _minus_one(_ratio(c(f"{k}_ttm"), c(f"{k}_prior"))) for k in ("revenue", "operating_income", "net_income", "fcf")}
    out |= {f"{n}_margin": _ratio(c(f"{k}_ttm"), c("revenue_ttm")) for n, k in (("gross", "gross_profit"), ("operating", "operating_income"), ("net", "net_income"), ("fcf", "fcf"))}
    out |= {"roa": _ratio(c("net_income_ttm"), c("assets_avg")), "roe": _ratio(c("net_income_ttm"), c("equity_avg")), "cfo_to_net_income": _ratio(c("cfo_ttm"), c("net_income_ttm"))}
    out |= {"accruals_to_assets": _ratio(c("net_income_ttm") - c("cfo_ttm"), c("assets_avg")), "cash_to_assets": _ratio(c("cash"), c("assets")), "debt_to_assets": _ratio(c("debt"), c("assets"))}
    out |= {"shares_growth": _minus_one(_ratio(c("shares"), c("__shares_prior")))}
    each = F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("value"), r.alias("reason")) for k, (v, r) in out.items()])
    return df.select(*keys, period, F.explode(each).alias("f")).select(*keys, period, "f.*")


def _minus_one(pair: tuple[Column, Column]) -> tuple[Column, Column]:
    return pair[0] - 1, pair[1]


def total_debt(whole: Column, noncurrent: Column, current: Column) -> Column:
    """Total debt if it is reported, else its long and current parts, both of one date."""
    return F.coalesce(whole, noncurrent + current)


def multiples(df: DataFrame, max_age: int = 400) -> DataFrame:
    """df with market_cap, earnings_yield, pe, price_to_sales, price_to_book, fcf_yield, ev, ev_to_sales, ev_to_operating_income and reason.

    df: price, price_date, shares, shares_date, split_factor (from shares_date on), and the trailing columns.
    Shares reported over max_age days ago are stale.
    """
    c = F.col
    fresh = c("shares").isNotNull() & (F.datediff("price_date", "shares_date") <= max_age)
    df = df.withColumn("market_cap", F.when(fresh, c("price") * c("shares") * F.coalesce("split_factor", F.lit(1.0))))
    df = df.withColumn("ev", c("market_cap") + c("debt") - c("cash"))
    over = lambda a, b: F.when(c(b) > 0, c(a) / c(b))
    return df.withColumns({
        "earnings_yield": F.try_divide(c("net_income_ttm"), c("market_cap")), "pe": over("market_cap", "net_income_ttm"), "price_to_sales": over("market_cap", "revenue_ttm"), "price_to_book": over("market_cap", "equity"),
        "fcf_yield": F.try_divide(c("fcf_ttm"), c("market_cap")), "ev_to_sales": over("ev", "revenue_ttm"), "ev_to_operating_income": over("ev", "operating_income_ttm"),
        "reason": F.when(c("shares").isNull(), "missing_fundamental").when(~fresh, "stale_data"),
    })


def valuation_history(points: DataFrame, key: str, date: str, last: int = 60, least: int = 24, measures: Sequence[str] = MULTIPLES) -> DataFrame:
    """points with <multiple>_pctile: its place among the key's earlier points, as each date knew them."""
    for m in measures:
        points = stats.own_percentile(points, key, date, m, last, least)
    return points


def in_currency(bars: DataFrame, rates: DataFrame, currency: str, day: str, level: str, tolerance_days: int = 7) -> DataFrame:
    """bars with level_usd and rate_day: the level times the last rate known at its day, if no older than the tolerance.

    rates: currency, rate_day, usd_per_unit; the dollar needs none.
    """
    from .asof import as_of_join

    known = rates.select(F.col("currency").alias(currency), F.col("rate_day").alias("__rd"), F.struct(F.col("rate_day").alias("d"), F.col("usd_per_unit").alias("r")).alias("__rate"))
    both = as_of_join(bars, known, [currency], day, "__rd", ["__rate"], tolerance_seconds=tolerance_days * 86_400)
    dollar = F.col(currency) == "USD"
    return both.withColumns({
        "level_usd": F.when(dollar, F.col(level)).otherwise(F.col(level) * F.col("__rate.r")), "rate_day": F.when(~dollar, F.col("__rate.d")),
    }).drop("__rate")
