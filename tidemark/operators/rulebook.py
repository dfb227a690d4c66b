"""Review of held positions by weighted rules with hard overrides, and comparison of rule variants."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cross_section import average_rank

DAYS_PER_MONTH = 30.44
SELL_AT, ADD_AT, OVEREXTENDED = -2.0, 2.5, 3.0
RULES = ("trend", "long_trend", "momentum", "valuation", "fundamentals", "support")
#: The weight of each of RULES by the bucket of the horizon.
WEIGHTS = {"SHORT": (1.0, 0.5, 0.5, 0.25, 0.25, 1.0), "MEDIUM": (0.75, 1.0, 1.0, 1.0, 1.0, 0.75), "LONG": (0.5, 1.5, 1.0, 1.5, 1.5, 0.5)}
#: The raw score of a label.
RAW = {
    "trend": {"STRONG_UPTREND": 2.0, "UPTREND": 1.0, "SIDEWAYS": 0.0, "MIXED": 0.0, "DOWNTREND": -1.0, "STRONG_DOWNTREND": -2.0},
    "valuation": {"Cheap": 1.0, "Fair": 0.0, "Expensive": -1.0},
    "fundamentals": {"Strong": 1.0, "Moderate": 0.0, "Weak": -1.0},
}


def horizon_bucket(months: Column) -> Column:
    return F.when(months <= 3, "SHORT").when(months <= 8, "MEDIUM").otherwise("LONG")


def _label(kind: str, label: Column) -> Column:
    return F.create_map(*map(F.lit, chain(*RAW[kind].items())))[label]


def raw_scores() -> dict[str, Column]:
    """The raw score of each rule from trend_state, close_vs_long, ret_half, valuation_label, fundamentals_label, support_lower, atr and price; NULL skips it."""
    sign = lambda c: F.when(F.col(c).isNotNull(), F.when(F.col(c) > 0, 1.0).otherwise(-1.0))
    support = F.when(F.col("support_lower").isNotNull() & (F.col("atr") != 0), F.when(F.col("price") < F.col("support_lower") - 0.5 * F.col("atr"), -2.0).otherwise(0.0))
    return {
        "trend": _label("trend", F.col("trend_state")), "long_trend": sign("close_vs_long"), "momentum": sign("ret_half"),
        "valuation": _label("valuation", F.col("valuation_label")), "fundamentals": _label("fundamentals", F.col("fundamentals_label")), "support": support,
    }


def weighted(raws: dict[str, Column], bucket: Column) -> Column:
    """Sum of the raw scores by the weights of a bucket, each contribution to four digits."""
    def weight(i: int) -> Column:
        return F.when(bucket == "SHORT", WEIGHTS["SHORT"][i]).when(bucket == "MEDIUM", WEIGHTS["MEDIUM"][i]).otherwise(WEIGHTS["LONG"][i])

    return F.round(sum((F.coalesce(F.round(raws[k] * weight(i), 4), F.lit(0.0)) for i, k in enumerate(RULES)), F.lit(0.0)), 4)


def review(positions: DataFrame) -> DataFrame:
    """positions with bucket, score, pnl, months_remaining, missing_rules, recommendation and reason (the rule that decided).

    positions: avg_cost, horizon_months, months_elapsed, target_return, stop_price, the facts of
    raw_scores, close_vs_middle and rsi. Facts that are NULL skip their rule. A stop overrides all; then
    come a target met, a horizon reached, a low and a high score. A high score does not add where the
    trend is not up, the price is stretched, RSI is over 70 or under a month is left.
    """
    raws = raw_scores()
    df = positions.withColumns({f"raw_{k}": c for k, c in raws.items()}).withColumn("bucket", horizon_bucket(F.col("horizon_months")))
    score = weighted({k: F.col(f"raw_{k}") for k in RULES}, F.col("bucket"))
    df = df.withColumns({"score": score, "pnl": F.col("price") / F.col("avg_cost") - 1, "months_remaining": F.col("horizon_months") - F.greatest("months_elapsed", F.lit(0.0))})
    missing = F.concat_ws(",", *[F.when(F.col(f"raw_{k}").isNull(), k) for k in RULES])
    s, due = F.col("score"), F.col("months_remaining") <= 0
    met = F.coalesce(F.col("pnl") >= F.col("target_return"), F.lit(False))
    stretched = F.when(F.col("atr") != 0, (F.col("price") - F.col("price") / (1 + F.col("close_vs_middle"))) / F.col("atr"))
    blocked = (F.coalesce("raw_trend", F.lit(0.0)) < 1) | F.coalesce(stretched > OVEREXTENDED, F.lit(False)) | F.coalesce(F.col("rsi") > 70, F.lit(False)) | (F.col("months_remaining") < 1)
    cases = [
        (F.coalesce(F.col("price") <= F.col("stop_price"), F.lit(False)), "SELL", "STOP_HIT"),
        (met & (due | (s < 1.5)), "SELL", "TARGET_MET"),
        (met, "HOLD", "TARGET_MET_SIGNAL_STRONG"),
        (due & F.when(F.col("pnl") > 0, s < 1.0).otherwise(s < 0), "SELL", "HORIZON_REACHED"),
        (due, "HOLD", "HORIZON_REACHED_SIGNAL_FOR"),
        (s <= SELL_AT, "SELL", "SCORE_LOW"),
        ((s >= ADD_AT) & blocked, "HOLD", "SCORE_HIGH_BLOCKED"),
        (s >= ADD_AT, "ADD", "SCORE_HIGH"),
    ]
    what, why = F.lit("HOLD"), F.lit("NO_RULE")
    for cond, call, reason in reversed(cases):
        what, why = F.when(cond, call).otherwise(what), F.when(cond, reason).otherwise(why)
    return df.withColumns({"missing_rules": missing, "recommendation": what, "reason": why}).drop(*[f"raw_{k}" for k in RULES])


def directional(calls: DataFrame, groups: Sequence[str], call: str, ret: str, adverse: str) -> DataFrame:
    """Per group: base rates, and hits, means and drawdowns of the UP and DOWN calls."""
    up, down, r, a = F.col(call) == "UP", F.col(call) == "DOWN", F.col(ret), F.col(adverse)
    share = lambda cond, among=None: F.avg((cond if among is None else F.when(among, cond)).cast("double"))
    return calls.groupBy(*groups).agg(
        F.count("*").alias("n"), share(r > 0).alias("base_up"), share(r < 0).alias("base_down"), F.count_if(up).alias("n_up"), share(r > 0, up).alias("up_hit"), F.count_if(down).alias("n_down"), share(r < 0, down).alias("down_hit"),
        F.avg(F.when(up, r)).alias("up_mean"), F.avg(F.when(down, r)).alias("down_mean"), F.avg(F.when(down, a)).alias("down_adverse"), F.avg(a).alias("base_adverse"),
        share(a <= -0.1, down).alias("down_dd10"), share(a <= -0.1).alias("base_dd10"),
    )


def edges(calls: DataFrame, groups: Sequence[str], call: str, ret: str, least: int = 30) -> DataFrame:
    """(groups, n, n_up, edge): the UP calls' hit rate less the base rate; NULL under ``least`` UP calls."""
    up, hit = F.col(call) == "UP", (F.col(ret) > 0).cast("double")
    agg = calls.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(up).alias("n_up"), F.avg(F.when(up, hit)).alias("__u"), F.avg(hit).alias("__b"))
    return agg.select(*groups, "n", "n_up", F.when(F.col("n_up") >= least, F.col("__u") - F.col("__b")).alias("edge"))


def monthly_spread(calls: DataFrame, groups: Sequence[str], month: str, score: str, ret: str, tie: str, least: int = 10) -> DataFrame:
    """(groups, months, top_bottom, positive_share): the mean over months of the best fifth's return less the worst fifth's; months of few rows or of one score do not count."""
    by = [*groups, month]
    w = Window.partitionBy(*by)
    k = F.greatest(F.floor(F.count("*").over(w) / 5), F.lit(1))
    ranked = calls.withColumns({"__k": k, "__n": F.count("*").over(w), "__up": F.row_number().over(w.orderBy(F.desc(score), F.desc(tie))), "__low": F.row_number().over(w.orderBy(score, tie))})
    top, low = F.col("__up") <= F.col("__k"), F.col("__low") <= F.col("__k")
    per = ranked.filter(F.col("__n") >= least).groupBy(*by).agg(
        (F.avg(F.when(top, F.col(ret))) - F.avg(F.when(low, F.col(ret)))).alias("__e"), (F.avg(F.when(top, F.col(score))) > F.avg(F.when(low, F.col(score)))).alias("__d")
    )
    return per.filter("__d").groupBy(*groups).agg(F.count("*").alias("months"), F.avg("__e").alias("top_bottom"), F.avg((F.col("__e") > 0).cast("double")).alias("positive_share"))


def verdicts(dimensions: DataFrame, keys: Sequence[str], base: str, variant: str, tolerance: str, agree: float = 0.6) -> DataFrame:
    """(keys, verdict) from rows of keys and horizon with the base's and variant's value.

    IMPROVES or DEGRADES: the difference of the means exceeds the tolerance, and at least ``agree`` of the
    horizons that have both values move that way; else INCONCLUSIVE.
    """
    b, v = F.col(base), F.col(variant)
    agg = dimensions.groupBy(*keys).agg(
        (F.avg(v) - F.avg(b)).alias("__d"), F.avg((v > b).cast("double")).alias("__up"), F.avg((v < b).cast("double")).alias("__down"), F.max(tolerance).alias("__t")
    )
    better, worse = (F.col("__d") >= F.col("__t")) & (F.col("__up") >= agree), (-F.col("__d") >= F.col("__t")) & (F.col("__down") >= agree)
    return agg.select(*keys, F.when(better, "IMPROVES").when(worse, "DEGRADES").otherwise("INCONCLUSIVE").alias("verdict"))


def overall(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, improves, degrades, overall): three improvements and no degradation improve, two degradations degrade."""
    agg = found.groupBy(*keys).agg(F.count_if(F.col("verdict") == "IMPROVES").alias("improves"), F.count_if(F.col("verdict") == "DEGRADES").alias("degrades"))
    up = (F.col("improves") >= 3) & (F.col("degrades") == 0)
    return agg.withColumn("overall", F.when(up, "IMPROVES").when(F.col("degrades") >= 2, "DEGRADES").otherwise("INCONCLUSIVE"))


def composites(df: DataFrame, cohort: Sequence[str], components: dict[str, dict[str, int]]) -> DataFrame:
    """df with comp_<name>: the mean of the oriented percentile ranks of a component's columns, those that are known."""
    out = {}
    for name, columns in components.items():
        parts = []
        for c, sign in columns.items():
            pct = average_rank(c, cohort) / F.count(c).over(Window.partitionBy(*cohort))
            parts.append(pct if sign > 0 else 1 - pct)
        known = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
        out[f"comp_{name}"] = F.try_divide(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), known)
    return df.withColumns(out)
