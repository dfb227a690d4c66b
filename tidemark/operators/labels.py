"""Labels of an analysis from its measured facts, as columns. Facts that are NULL are left out, never guessed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "Insufficient"


def _count(conds: Sequence[Column]) -> Column:
    return sum((F.coalesce(c.cast("int"), F.lit(0)) for c in conds), F.lit(0))


def _known(values: Sequence[Column]) -> Column:
    return sum((v.isNotNull().cast("int") for v in values), F.lit(0))


def by_checks(values: Sequence[Column], holds: Sequence[Column], strong: int = 4, moderate: int = 2, least: int = 3, names: Sequence[str] = ("Strong", "Moderate", "Weak")) -> Column:
    """The label by how many checks hold; Insufficient with fewer than ``least`` known."""
    good = _count(holds)
    return F.when(_known(values) < least, NONE).when(good >= strong, names[0]).when(good >= moderate, names[1]).otherwise(names[2])


def fundamentals(operating_margin: Column, fcf_margin: Column, roa: Column, cfo_to_net_income: Column, net_margin: Column) -> Column:
    values = [operating_margin, fcf_margin, roa, cfo_to_net_income, net_margin]
    return by_checks(values, [operating_margin > 0.10, fcf_margin > 0.05, roa > 0.05, cfo_to_net_income >= 0.8, net_margin > 0])


def growth(rates: Sequence[Column]) -> Column:
    """Of yearly and three-year growth rates: those above five percent."""
    return by_checks(rates, [r > 0.05 for r in rates])


def valuation(pe_pct: Column, sales_pct: Column, fcf_yield_pct: Column) -> Column:
    """Cheap, Fair or Expensive by the mean percentile in the own history; a high cash-flow yield is cheap."""
    parts = [pe_pct, sales_pct, 100.0 - fcf_yield_pct]
    mean = F.try_divide(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), _known(parts))
    return F.when(mean.isNull(), NONE).when(mean <= 30, "Cheap").when(mean >= 70, "Expensive").otherwise("Fair")


def momentum(returns: Sequence[Column]) -> Column:
    n, up, down = _known(returns), _count([r > 0.05 for r in returns]), _count([r < -0.05 for r in returns])
    return F.when(n < 2, NONE).when(up == n, "Strong").when(up > down, "Positive").when(down > up, "Negative").otherwise("Mixed")


def relative_strength(excess: Sequence[Column]) -> Column:
    n, up = _known(excess), _count([r > 0 for r in excess])
    return F.when(n < 2, NONE).when(up == n, "Outperforming").when(up == 0, "Underperforming").otherwise("Mixed")


def risk(vol: Column, max_drawdown: Column) -> Column:
    """Low, Moderate or High from annual volatility and the year's worst drawdown (negative)."""
    score = F.when(vol < 0.22, 0).when(vol < 0.38, 1).otherwise(2) + F.when(max_drawdown.isNull() | (max_drawdown > -0.15), 0).when(max_drawdown > -0.30, 1).otherwise(2)
    return F.when(vol.isNull(), NONE).when(score <= 1, "Low").when(score <= 2, "Moderate").otherwise("High")


def data_quality(bars: Column, sessions_behind: Column, available: Column, expected: Column) -> Column:
    """High to Insufficient: a year of bars, a fresh close, four fifths of the fundamentals."""
    points = _count([bars >= 252, sessions_behind <= 0, F.try_divide(available.cast("double"), expected) >= 0.8])
    return F.when(points == 3, "High").when(points == 2, "Medium").when(points == 1, "Low").otherwise(NONE)


#: The divisions of the two leading digits of an industry code, and those that ratios do not apply to.
DIVISIONS = (("01", "09", "Agriculture"), ("10", "14", "Mining"), ("15", "17", "Construction"), ("20", "39", "Manufacturing"), ("40", "49", "Transport, Comms, Utilities"), ("50", "51", "Wholesale"), ("52", "59", "Retail"), ("60", "67", "Finance, Insurance, RE"), ("70", "89", "Services"))


def sector(code: Column) -> Column:
    """The division of an industry code; NULL for codes of no division."""
    two = F.when(F.length(code) >= 2, F.substring(code, 1, 2))
    out = F.lit(None).cast("string")
    for low, high, name in DIVISIONS:
        out = F.when(two.between(low, high), name).otherwise(out)
    return out
