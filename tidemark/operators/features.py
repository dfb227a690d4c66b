"""The technical panel: every price feature of a bar as known at its close, with the reason of each missing value.

One shuffle by key serves it all: the recursive means are folded per key, the rest are windows in one
order. Windows that span a hole in the session calendar give no value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import recursive as R
from . import windows as V


@dataclass(frozen=True)
class Spans:
    """Lengths in bars: of a month, quarter, half and whole year, of the three means, of a slope and of Wilder's means."""

    month: int = 21
    quarter: int = 63
    half: int = 126
    year: int = 252
    short: int = 20
    middle: int = 50
    long: int = 200
    slope: int = 20
    wilder: int = 14

    def needs(self) -> dict[str, int]:
        """The bars that each feature needs, its own included."""
        m, q, h, y = self.month, self.quarter, self.half, self.year
        means = {"short": self.short, "middle": self.middle, "long": self.long}
        out = {"ret_month": m + 1, "ret_quarter": q + 1, "ret_half": h + 1, "ret_year": y + 1, "momentum": y + 1}
        out |= {f"distance_{k}": n for k, n in means.items()} | {f"slope_{k}": n + self.slope for k, n in means.items()}
        out |= {"ema_distance_short": self.short, "ema_distance_middle": self.middle, "short_vs_middle": self.middle, "middle_vs_long": self.long}
        out |= {"distance_year_high": y, "distance_half_high": h, "drawdown_year": y, "drawdown_half": h, "vol_short": self.short + 1, "vol_quarter": q + 1, "vol_half": h + 1}
        out |= {"atr_pct": self.wilder + 1, "atr_normalized": self.wilder + y, "skew": q + 1, "kurtosis": q + 1, "downside_vol": q + 1}
        return out | {"volume_change_short": 2 * self.short, "volume_change_quarter": 2 * q, "volume_z_short": self.short, "volume_z_quarter": q, "rsi": self.wilder + 1}

    def spanned(self) -> dict[str, int]:
        """Features that are void where so many bars do not follow each other in the calendar."""
        m, q, h, y = self.month, self.quarter, self.half, self.year
        return {
            "ret_month": m, "ret_quarter": q, "ret_half": h, "ret_year": y, "momentum": y, "vol_short": m, "vol_quarter": q, "vol_half": h,
            "drawdown_year": y, "drawdown_half": h, "skew": q, "kurtosis": q, "downside_vol": q,
        }


def folded(bars: DataFrame, key: str, order: str, spans: Spans) -> DataFrame:
    """bars (key, order, ordinal, high, low, close, volume, level) with ema_short, ema_middle, atr and rsi, folded in one pass over a key's bars.

    Bars without high, low or close have none of these, and the others' are those of the series without them.
    """
    fields = ["ordinal", "high", "low", "close", "volume", "level"]
    s = R._series(bars, key, order, [F.col(c).cast("double").alias(c) for c in fields])
    tail, n = "slice(__s, 2, greatest(size(__s) - 1, 0))", spans.wilder
    masked = "transform({0}, (x, i) -> if(i >= {1}, x, null))"
    whole = "s.high is not null and s.low is not null and s.close is not null"
    s = R._arrays(s, {
        "__void": f"filter(__s, s -> not ({whole}))", "__s": f"filter(__s, s -> {whole})",
        "__c": "transform(__s, s -> s.close)", "__es": R.ema_of("__c", spans.short), "__em": R.ema_of("__c", spans.middle),
        "ema_short": masked.format("__es", spans.short - 1), "ema_middle": masked.format("__em", spans.middle - 1),
        "__tr": f"transform({tail}, (s, i) -> greatest(s.high - s.low, abs(s.high - __s[i].close), abs(s.low - __s[i].close)))",
        "atr": f"concat(array(cast(null as double)), {R.wilder_of('__tr', n)})",
        "__d": f"transform({tail}, (s, i) -> s.close - __s[i].close)", "__up": "transform(__d, d -> greatest(d, 0D))", "__dn": "transform(__d, d -> greatest(-d, 0D))",
        "__au": R.wilder_of("__up", n), "__ad": R.wilder_of("__dn", n),
        "rsi": "concat(array(cast(null as double)), zip_with(__au, __ad, (u, d) -> if(d = 0, 100D, 100 - 100 / (1 + u / d))))",
    })
    made = ("ema_short", "ema_middle", "atr", "rsi")
    none = F.transform("__void", lambda v: F.struct(v.alias("__s"), *[F.lit(None).cast("double").alias(c) for c in made]))
    told = F.when(F.size("__s") > 0, F.concat(F.arrays_zip("__s", *made), none)).otherwise(none)
    rows = s.select(key, F.explode(told).alias("z"))
    return rows.select(key, F.col("z.__s.t").alias(order), *[F.col(f"z.__s.{c}").alias(c) for c in fields], *[F.col(f"z.{c}").alias(c) for c in ("ema_short", "ema_middle", "atr", "rsi")])


def technical_panel(bars: DataFrame, key: str, order: str, spans: Spans = Spans(), level: str | None = None) -> DataFrame:
    """(key, order, position, close, the features of Spans.needs, atr, vol_year) for each bar.

    bars: key, order, ordinal (the session's place in its calendar), high, low, close, volume; level, the
    total-return level, is the close where there is none.
    """
    bars = folded(bars.withColumn("level", F.col(level or "close")), key, order, spans)
    w = Window.partitionBy(key).orderBy(order)
    c, lvl, v = F.col("close"), F.col("level"), F.col("volume")
    means = {"short": spans.short, "middle": spans.middle, "long": spans.long}
    steps = {f"__sma_{k}": V.sma(c, w, n) for k, n in means.items()} | {"__r": V.log_return(lvl, w), "position": F.row_number().over(w) - 1}
    steps |= {f"__v_{k}": V.sma(v, w, n) for k, n in (("short", spans.short), ("quarter", spans.quarter))}
    bars = bars.withColumns(steps)
    r = F.col("__r")

    def high(x: Column, n: int) -> Column:
        return V.distance(x, V.full(F.max(x).over(w.rowsBetween(-n + 1, 0)), x, w, n))

    spread = {"month": spans.month, "quarter": spans.quarter, "half": spans.half, "year": spans.year}
    f = {f"ret_{k}": V.change(lvl, w, n) for k, n in spread.items()} | {"momentum": V.momentum(lvl, w, spans.month, spans.year)}
    f |= {f"distance_{k}": V.distance(c, F.col(f"__sma_{k}")) for k in means} | {f"slope_{k}": V.change(F.col(f"__sma_{k}"), w, spans.slope) for k in means}
    f |= {f"ema_distance_{k}": V.distance(c, F.col(f"ema_{k}")) for k in ("short", "middle")}
    f |= {"short_vs_middle": V.distance(F.col("__sma_short"), F.col("__sma_middle")), "middle_vs_long": V.distance(F.col("__sma_middle"), F.col("__sma_long"))}
    f |= {f"distance_{k}_high": high(c, spread[k]) for k in ("year", "half")} | {f"drawdown_{k}": high(lvl, spread[k]) for k in ("year", "half")}
    f |= {f"vol_{k}": V.annual_vol(r, w, n) for k, n in (("short", spans.short), ("quarter", spans.quarter), ("half", spans.half), ("year", spans.year))}
    f |= {"atr_pct": F.try_divide(F.col("atr"), c), "atr_normalized": V.ratio_to_mean(F.col("atr"), w, spans.year)}
    f |= {"skew": V.skew(r, w, spans.quarter), "kurtosis": V.excess_kurtosis(r, w, spans.quarter), "downside_vol": V.downside_vol(r, w, spans.quarter)}
    for k, n in (("short", spans.short), ("quarter", spans.quarter)):
        f |= {f"volume_change_{k}": V.change(F.col(f"__v_{k}"), w, n), f"volume_z_{k}": V.zscore(v, w, n)}
    ordinal = F.col("ordinal")
    clean = {n: F.coalesce(ordinal - F.lag("ordinal", n).over(w) == n, F.lit(False)) for n in set(spans.spanned().values())}
    f = {k: F.when(clean[spans.spanned()[k]], x) if k in spans.spanned() else x for k, x in f.items()} | {"rsi": F.col("rsi")}
    return bars.select(key, order, "position", "close", *[F.nanvl(f[k], F.lit(None)).alias(k) for k in spans.needs()], "atr", f["vol_year"].alias("vol_year"))


def with_reasons(panel: DataFrame, key: str, order: str, spans: Spans = Spans()) -> DataFrame:
    """(key, order, feature, value, reason) a row a feature: reason is NULL where there is a value."""
    def why(name: str, need: int) -> Column:
        return F.when(F.col(name).isNotNull(), None).when(F.col("position") + 1 < need, "NOT_ENOUGH_HISTORY").otherwise("PROVIDER_GAP")

    each = [F.struct(F.lit(k).alias("feature"), F.col(k).alias("value"), why(k, n).alias("reason")) for k, n in spans.needs().items()]
    return panel.select(key, order, F.explode(F.array(*each)).alias("f")).select(key, order, "f.*")


def trend(panel: DataFrame) -> Column:
    """STRONG_UPTREND .. STRONG_DOWNTREND by five facts, NULL if fewer than four are known."""
    parts = [F.col(c) for c in ("distance_short", "distance_middle", "distance_long", "middle_vs_long", "slope_long")]
    known = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    score = sum((F.when(p > 0, 1).when(p.isNotNull(), -1).otherwise(0) for p in parts), F.lit(0))
    state = F.when(score >= 4, "STRONG_UPTREND").when(score >= 2, "UPTREND").when(score >= -1, "NEUTRAL").when(score >= -3, "DOWNTREND").otherwise("STRONG_DOWNTREND")
    return F.when(known >= 4, state)


#: Horizons in months of the alerts.
ALERT_HORIZONS = (1, 3, 6, 12, 24)


def risk_features(panel: DataFrame, support: Column | None = None) -> DataFrame:
    """panel with trend_state, the components of a risk alert and the alert for each horizon: 1, 0, or NULL where an input is missing.

    support: the lower edge of the nearest support zone, as frozen the bar before (``zones.frozen_support``).
    The alert of a horizon is the sell call of the review rules for a position opened at this close.
    """
    from .rulebook import RULES, SELL_AT, horizon_bucket, raw_scores, weighted

    def flag(cond: Column) -> Column:
        return cond.cast("double")

    none = F.lit(None)
    support = none.cast("double") if support is None else support
    facts = {
        "trend_state": trend(panel), "close_vs_long": F.col("distance_long"), "price": F.col("close"), "support_lower": support,
        "valuation_label": none.cast("string"), "fundamentals_label": none.cast("string"),
    }
    made = panel.withColumns(facts)
    raws = {k: raw_scores()[k] for k in RULES}
    made = made.withColumns({f"__raw_{k}": c for k, c in raws.items()})
    alerts = {}
    for h in ALERT_HORIZONS:
        sell = weighted({k: F.col(f"__raw_{k}") for k in RULES}, horizon_bucket(F.lit(h))) <= SELL_AT
        alerts[f"risk_alert_h{h}"] = F.when(sell & F.col("trend_state").isNotNull(), 1.0).when(F.col("trend_state").isNotNull() | F.col("distance_long").isNotNull(), 0.0)
    return made.withColumns({
        "rc_below_long": flag(F.col("distance_long") < 0), "rc_momentum_negative": flag(F.col("ret_half") < 0), "rc_support_broken": flag(F.col("close") < F.col("support_lower")),
        "rc_elevated_volatility": flag(F.col("vol_quarter") > 1.25 * F.col("vol_year")), "rc_drawdown_state": flag(F.col("drawdown_year") <= -0.15), **alerts,
    }).drop("close_vs_long", "price", "support_lower", "valuation_label", "fundamentals_label", *[f"__raw_{k}" for k in RULES])
