"""Queries of the technical panel, position reviews, feature reports and variant tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cross_section as X
from ..operators import features as T
from ..operators import rulebook as K
from ..operators import variants as R
from ..sources.tables import table
from .panel import PANEL, RANK, panel
from .registry import query
from .series import BARS, NUMBERED, TRUE_RANGE, _ema_sql, _wilder_sql, bars

#: The bars of the table span thirty days, so that the panel's lengths are short.
SPANS = T.Spans(month=2, quarter=5, half=7, year=9, short=3, middle=5, long=8, slope=2, wilder=3)
#: Folded features, whose SQL is the closed form of each mean.
FOLDED = ("ema_distance_short", "ema_distance_middle", "atr_pct", "atr_normalized", "rsi")


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY user_id ORDER BY session_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(value: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {_frame(n)} = {n} THEN {value.replace('FRAME', _frame(n))} END"


def _lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER w"


def _panel_sql() -> str:
    s = SPANS
    means, spread = {"short": s.short, "middle": s.middle, "long": s.long}, {"month": s.month, "quarter": s.quarter, "half": s.half, "year": s.year}
    f = {f"ret_{k}": f"close / nullif({_lag('close', n)}, 0) - 1" for k, n in spread.items()} | {"momentum": f"{_lag('close', s.month)} / nullif({_lag('close', s.year)}, 0) - 1"}
    f |= {f"distance_{k}": f"close / nullif(sma_{k}, 0) - 1" for k in means} | {f"slope_{k}": f"sma_{k} / nullif({_lag(f'sma_{k}', s.slope)}, 0) - 1" for k in means}
    f |= {"short_vs_middle": "sma_short / nullif(sma_middle, 0) - 1", "middle_vs_long": "sma_middle / nullif(sma_long, 0) - 1"}
    f |= {f"{a}_{k}{b}": f"close / nullif({_full('max(close) FRAME', 'close', spread[k])}, 0) - 1" for a, b in (("distance", "_high"), ("drawdown", "")) for k in ("year", "half")}
    f |= {f"vol_{k}": _full("stddev_samp(r) FRAME * sqrt(252)", "r", n) for k, n in (("short", s.short), ("quarter", s.quarter), ("half", s.half), ("year", s.year))}
    f |= {"skew": _full("skewness(r) FRAME", "r", s.quarter), "kurtosis": _full("kurtosis(r) FRAME", "r", s.quarter), "downside_vol": _full("sqrt(avg(pow(least(r, 0), 2)) FRAME) * sqrt(252)", "r", s.quarter)}
    for k, n in (("short", s.short), ("quarter", s.quarter)):
        f |= {f"volume_change_{k}": f"v_{k} / nullif({_lag(f'v_{k}', n)}, 0) - 1", f"volume_z_{k}": _full("(volume - avg(volume) FRAME) / nullif(stddev_samp(volume) FRAME, 0)", "volume", n)}
    f = {k: f"CASE WHEN o - {_lag('o', s.spanned()[k])} = {s.spanned()[k]} THEN {x} END" if k in s.spanned() else x for k, x in f.items()}
    sma = ", ".join([*(f"{_full('avg(close) FRAME', 'close', n)} AS sma_{k}" for k, n in means.items()), *(f"{_full('avg(volume) FRAME', 'volume', n)} AS v_{k}" for k, n in (("short", s.short), ("quarter", s.quarter)))])
    return f"""{BARS}, b AS (SELECT user_id, session_date, close, volume, date_diff('day', DATE '1970-01-01', session_date) AS o, row_number() OVER w - 1 AS pos,
        CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS r FROM bars WINDOW w AS (PARTITION BY user_id ORDER BY session_date)),
        m AS (SELECT *, {sma} FROM b), f AS (SELECT user_id, session_date, close, pos, {', '.join(f'{x} AS {k}' for k, x in f.items())} FROM m WINDOW w AS (PARTITION BY user_id ORDER BY session_date))"""


PANEL_SQL = _panel_sql()
_YEAR = f"OVER (PARTITION BY user_id ORDER BY session_date ROWS BETWEEN {SPANS.year - 1} PRECEDING AND CURRENT ROW)"
#: fo: the folded features of every bar.
FOLDED_SQL = f"""es AS (SELECT user_id, session_date, close, CASE WHEN i >= {SPANS.short} THEN {_ema_sql('n', 'close', SPANS.short)} END AS es, CASE WHEN i >= {SPANS.middle} THEN {_ema_sql('n', 'close', SPANS.middle)} END AS em FROM n y),
    td AS (SELECT user_id, session_date, i - 1 AS i, {TRUE_RANGE} AS tr, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS dn FROM n WHERE i > 1),
    wl AS (SELECT user_id, session_date, {', '.join(f"{_wilder_sql('td', c, SPANS.wilder)} AS w_{c}" for c in ('tr', 'up', 'dn'))} FROM td y),
    fo AS (SELECT user_id, session_date, close / nullif(es, 0) - 1 AS ema_distance_short, close / nullif(em, 0) - 1 AS ema_distance_middle, w_tr / nullif(close, 0) AS atr_pct,
        CASE WHEN count(w_tr) {_YEAR} = {SPANS.year} THEN w_tr / nullif(avg(w_tr) {_YEAR}, 0) END AS atr_normalized, CASE WHEN w_dn = 0 THEN 100 ELSE 100 - 100 / (1 + w_up / w_dn) END AS rsi FROM es LEFT JOIN wl USING (user_id, session_date))"""


def _panel(spark, sf):
    b = bars(spark, sf).withColumn("ordinal", F.datediff("session_date", F.lit("1970-01-01")))
    return T.technical_panel(b, "user_id", "session_date", SPANS)


_ROW = "SELECT user_id, session_date, '{k}' AS feature, {k} AS value, CASE WHEN {k} IS NOT NULL THEN NULL WHEN pos + 1 < {n} THEN 'NOT_ENOUGH_HISTORY' ELSE 'PROVIDER_GAP' END AS reason FROM every"


@query(f"""WITH {NUMBERED}, {FOLDED_SQL}{PANEL_SQL[len(BARS):]}, every AS (SELECT * FROM f JOIN fo USING (user_id, session_date)), l AS ({' UNION ALL '.join(_ROW.format(k=k, n=n) for k, n in SPANS.needs().items())})
    SELECT user_id, session_date, feature, round(value, 6) + 0.0 AS value, reason FROM l""")
def technical_panel(spark, sf):
    """Every feature of every bar, with the reason where there is none."""
    rows = T.with_reasons(_panel(spark, sf), "user_id", "session_date", SPANS)
    return rows.withColumn("value", F.round("value", 6) + 0.0)


_PARTS = ("distance_short", "distance_middle", "distance_long", "middle_vs_long", "slope_long")


@query(f"""WITH {PANEL_SQL}, s AS (SELECT *, {' + '.join(f'({p} IS NOT NULL)::INT' for p in _PARTS)} AS k, {' + '.join(f'CASE WHEN {p} > 0 THEN 1 WHEN {p} IS NOT NULL THEN -1 ELSE 0 END' for p in _PARTS)} AS t FROM f)
    SELECT user_id, session_date, CASE WHEN k >= 4 THEN CASE WHEN t >= 4 THEN 'STRONG_UPTREND' WHEN t >= 2 THEN 'UPTREND' WHEN t >= -1 THEN 'NEUTRAL' WHEN t >= -3 THEN 'DOWNTREND' ELSE 'STRONG_DOWNTREND' END END AS trend_state,
        (distance_long < 0)::INT AS rc_below_long, (ret_half < 0)::INT AS rc_momentum_negative, (vol_quarter > 1.25 * vol_year)::INT AS rc_elevated_volatility, (drawdown_year <= -0.15)::INT AS rc_drawdown_state FROM s""")
def risk_features(spark, sf):
    r = T.risk_features(_panel(spark, sf))
    flags = ("rc_below_long", "rc_momentum_negative", "rc_elevated_volatility", "rc_drawdown_state")
    return r.select("user_id", "session_date", "trend_state", *[F.col(c).cast("int").alias(c) for c in flags])


#: Positions made of customers: every fact is missing for some.
POSITIONS = """p AS (SELECT c_custkey AS k, 50.0 + c_nationkey AS avg_cost, 40.0 + c_custkey % 60 AS price, CAST(1 + c_custkey % 12 AS INT) AS horizon_months, (c_custkey % 14) * 1.0 AS months_elapsed,
        CASE WHEN c_custkey % 3 = 0 THEN 0.2 END AS target_return, CASE WHEN c_custkey % 5 = 0 THEN 45.0 END AS stop_price,
        CASE c_custkey % 7 WHEN 0 THEN 'STRONG_UPTREND' WHEN 1 THEN 'UPTREND' WHEN 2 THEN 'SIDEWAYS' WHEN 3 THEN 'DOWNTREND' WHEN 4 THEN 'STRONG_DOWNTREND' END AS trend_state,
        CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal / 10000 - 0.2 END AS close_vs_long, CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal / 20000 - 0.1 END AS ret_half, c_acctbal / 50000 AS close_vs_middle,
        CASE c_custkey % 4 WHEN 0 THEN 'Cheap' WHEN 1 THEN 'Fair' WHEN 2 THEN 'Expensive' END AS valuation_label, CASE c_custkey % 6 WHEN 0 THEN 'Strong' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'Weak' END AS fundamentals_label,
        CASE WHEN c_custkey % 8 <> 0 THEN 42.0 + c_nationkey END AS support_lower, CASE WHEN c_custkey % 17 <> 0 THEN 1.5 END AS atr, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey % 90) * 1.0 END AS rsi FROM customer)"""
_MAPS = {k: "CASE " + {"trend": "trend_state", "valuation": "valuation_label", "fundamentals": "fundamentals_label"}[k] + "".join(f" WHEN '{a}' THEN {b}" for a, b in m.items()) + " END" for k, m in K.RAW.items()}
_RAWS = {
    "trend": _MAPS["trend"], "long_trend": "CASE WHEN close_vs_long > 0 THEN 1.0 WHEN close_vs_long IS NOT NULL THEN -1.0 END", "momentum": "CASE WHEN ret_half > 0 THEN 1.0 WHEN ret_half IS NOT NULL THEN -1.0 END",
    "valuation": _MAPS["valuation"], "fundamentals": _MAPS["fundamentals"], "support": "CASE WHEN support_lower IS NOT NULL AND atr <> 0 THEN CASE WHEN price < support_lower - 0.5 * atr THEN -2.0 ELSE 0.0 END END",
}


def _weight(i: int) -> str:
    return "CASE bucket" + "".join(f" WHEN '{b}' THEN {w[i]}" for b, w in K.WEIGHTS.items()) + " END"


@query(f"""WITH {POSITIONS}, r AS (SELECT *, {', '.join(f'{x} AS raw_{k}' for k, x in _RAWS.items())}, CASE WHEN horizon_months <= 3 THEN 'SHORT' WHEN horizon_months <= 8 THEN 'MEDIUM' ELSE 'LONG' END AS bucket,
        price / avg_cost - 1 AS pnl, horizon_months - greatest(months_elapsed, 0) AS months_remaining FROM p),
    s AS (SELECT *, round({' + '.join(f'coalesce(raw_{k} * {_weight(i)}, 0)' for i, k in enumerate(K.RULES))}, 4) AS score, concat_ws(',', {', '.join(f"CASE WHEN raw_{k} IS NULL THEN '{k}' END" for k in K.RULES)}) AS missing_rules,
        coalesce(pnl >= target_return, FALSE) AS met, months_remaining <= 0 AS due,
        coalesce(raw_trend, 0) < 1 OR coalesce((price - price / (1 + close_vs_middle)) / nullif(atr, 0) > 3, FALSE) OR coalesce(rsi > 70, FALSE) OR months_remaining < 1 AS blocked FROM r),
    d AS (SELECT *, CASE WHEN coalesce(price <= stop_price, FALSE) THEN 'STOP_HIT' WHEN met AND (due OR score < 1.5) THEN 'TARGET_MET' WHEN met THEN 'TARGET_MET_SIGNAL_STRONG' WHEN due AND CASE WHEN pnl > 0 THEN score < 1 ELSE score < 0 END THEN 'HORIZON_REACHED'
        WHEN due THEN 'HORIZON_REACHED_SIGNAL_FOR' WHEN score <= -2 THEN 'SCORE_LOW' WHEN score >= 2.5 AND blocked THEN 'SCORE_HIGH_BLOCKED' WHEN score >= 2.5 THEN 'SCORE_HIGH' ELSE 'NO_RULE' END AS reason FROM s)
    SELECT k, bucket, CAST(score AS DOUBLE) AS score, missing_rules, reason, CASE WHEN reason IN ('STOP_HIT', 'TARGET_MET', 'HORIZON_REACHED', 'SCORE_LOW') THEN 'SELL' WHEN reason = 'SCORE_HIGH' THEN 'ADD' ELSE 'HOLD' END AS recommendation FROM d""")
def position_review(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")

    def pick(n, *labels):
        out = F.lit(None).cast("string")
        for i, x in enumerate(labels):
            out = F.when(k % n == i, x).otherwise(out)
        return out

    p = c.select(
        k.alias("k"), (50.0 + F.col("c_nationkey")).alias("avg_cost"), (40.0 + k % 60).alias("price"), (1 + k % 12).cast("int").alias("horizon_months"), (k % 14).cast("double").alias("months_elapsed"),
        F.when(k % 3 == 0, 0.2).alias("target_return"), F.when(k % 5 == 0, 45.0).alias("stop_price"), pick(7, "STRONG_UPTREND", "UPTREND", "SIDEWAYS", "DOWNTREND", "STRONG_DOWNTREND").alias("trend_state"),
        F.when(k % 11 != 0, F.col("c_acctbal") / 10000 - 0.2).alias("close_vs_long"), F.when(k % 13 != 0, F.col("c_acctbal") / 20000 - 0.1).alias("ret_half"), (F.col("c_acctbal") / 50000).alias("close_vs_middle"),
        pick(4, "Cheap", "Fair", "Expensive").alias("valuation_label"), pick(6, "Strong", "Moderate", "Weak").alias("fundamentals_label"),
        F.when(k % 8 != 0, 42.0 + F.col("c_nationkey")).alias("support_lower"), F.when(k % 17 != 0, 1.5).alias("atr"), F.when(k % 9 != 0, (k % 90).cast("double")).alias("rsi"),
    )
    return K.review(p).select("k", "bucket", "score", "missing_rules", "reason", "recommendation")


CALLS = f"""{PANEL}, c AS (SELECT id, month, segment, (n_orders * 7 + id) % 5 AS score, ahead AS ret, least(ahead, 0) AS adverse, CASE WHEN (id + n_orders) % 3 = 0 THEN 'UP' WHEN (id + n_orders) % 3 = 1 THEN 'DOWN' ELSE 'NEUTRAL' END AS call,
        CASE WHEN id % 4 < 2 THEN 'UP' WHEN id % 4 = 2 THEN 'DOWN' ELSE 'NEUTRAL' END AS call2, CAST(id % 3 AS INT) AS horizon FROM panel WHERE ahead IS NOT NULL)"""


def _calls(spark, sf):
    k, i = (F.col("id") + F.col("n_orders")) % 3, F.col("id") % 4
    return panel(spark, sf).filter("ahead is not null").select(
        "id", "month", "segment", ((F.col("n_orders") * 7 + F.col("id")) % 5).alias("score"), F.col("ahead").alias("ret"), F.least("ahead", F.lit(0.0)).alias("adverse"),
        F.when(k == 0, "UP").when(k == 1, "DOWN").otherwise("NEUTRAL").alias("call"), F.when(i < 2, "UP").when(i == 2, "DOWN").otherwise("NEUTRAL").alias("call2"), (F.col("id") % 3).cast("int").alias("horizon"),
    )


_DIRECTIONAL = {
    "base_up": "avg((ret > 0)::INT)", "base_down": "avg((ret < 0)::INT)", "up_hit": "avg((ret > 0)::INT) FILTER (call = 'UP')", "down_hit": "avg((ret < 0)::INT) FILTER (call = 'DOWN')",
    "up_mean": "avg(ret) FILTER (call = 'UP')", "down_mean": "avg(ret) FILTER (call = 'DOWN')", "down_adverse": "avg(adverse) FILTER (call = 'DOWN')", "base_adverse": "avg(adverse)",
    "down_dd10": "avg((adverse <= -0.1)::INT) FILTER (call = 'DOWN')", "base_dd10": "avg((adverse <= -0.1)::INT)",
}


@query(f"""WITH {CALLS} SELECT segment, count(*) AS n, count(*) FILTER (call = 'UP') AS n_up, count(*) FILTER (call = 'DOWN') AS n_down, {', '.join(f'round({x}, 5) AS {k}' for k, x in _DIRECTIONAL.items())} FROM c GROUP BY segment""")
def directional_table(spark, sf):
    df = K.directional(_calls(spark, sf), ["segment"], "call", "ret", "adverse")
    return df.withColumns({k: F.round(k, 5) for k in _DIRECTIONAL})


@query(f"""WITH {CALLS}, e AS (SELECT segment, horizon, count(*) AS n, count(*) FILTER (call = 'UP') AS n_up, avg((ret > 0)::INT) FILTER (call = 'UP') - avg((ret > 0)::INT) AS e FROM c GROUP BY 1, 2)
    SELECT segment, horizon, n, n_up, CASE WHEN n_up >= 30 THEN round(e, 6) END AS edge FROM e""")
def stratum_edges(spark, sf):
    return K.edges(_calls(spark, sf), ["segment", "horizon"], "call", "ret").withColumn("edge", F.round("edge", 6))


@query(f"""WITH {CALLS}, r AS (SELECT *, greatest(floor(count(*) OVER m / 5), 1) AS k, count(*) OVER m AS n, row_number() OVER (PARTITION BY horizon, month ORDER BY score DESC, id DESC) AS u, row_number() OVER (PARTITION BY horizon, month ORDER BY score, id) AS d FROM c WINDOW m AS (PARTITION BY horizon, month)),
    p AS (SELECT horizon, month, avg(ret) FILTER (u <= k) - avg(ret) FILTER (d <= k) AS e, avg(score) FILTER (u <= k) > avg(score) FILTER (d <= k) AS ok FROM r WHERE n >= 10 GROUP BY 1, 2)
    SELECT horizon, count(*) AS months, round(avg(e), 5) AS top_bottom, round(avg((e > 0)::INT), 6) AS positive_share FROM p WHERE ok GROUP BY 1""")
def monthly_spread(spark, sf):
    df = K.monthly_spread(_calls(spark, sf), ["horizon"], "month", "score", "ret", "id")
    return df.withColumns({"top_bottom": F.round("top_bottom", 5), "positive_share": F.round("positive_share", 6)})


_EDGE = "avg((ret > 0)::INT) FILTER ({c} = 'UP') - avg((ret > 0)::INT)"


@query(f"""WITH {CALLS}, e AS (SELECT segment, horizon, {_EDGE.format(c='call')} AS b, {_EDGE.format(c='call2')} AS v FROM c GROUP BY 1, 2),
    g AS (SELECT segment, avg(v) - avg(b) AS d, avg((v > b)::INT) AS u, avg((v < b)::INT) AS l FROM e GROUP BY 1),
    w AS (SELECT segment, CASE WHEN d >= 0.005 AND u >= 0.6 THEN 'IMPROVES' WHEN -d >= 0.005 AND l >= 0.6 THEN 'DEGRADES' ELSE 'INCONCLUSIVE' END AS verdict FROM g)
    SELECT 'edge' AS dimension, count(*) FILTER (verdict = 'IMPROVES') AS improves, count(*) FILTER (verdict = 'DEGRADES') AS degrades,
        CASE WHEN count(*) FILTER (verdict = 'IMPROVES') >= 3 AND count(*) FILTER (verdict = 'DEGRADES') = 0 THEN 'IMPROVES' WHEN count(*) FILTER (verdict = 'DEGRADES') >= 2 THEN 'DEGRADES' ELSE 'INCONCLUSIVE' END AS overall FROM w""")
def variant_verdicts(spark, sf):
    calls = _calls(spark, sf)
    base, variant = (K.edges(calls, ["segment", "horizon"], c, "ret", 1).select("segment", "horizon", F.col("edge").alias(n)) for c, n in (("call", "b"), ("call2", "v")))
    both = base.join(variant, ["segment", "horizon"]).withColumns({"t": F.lit(0.005), "dimension": F.lit("edge")})
    return K.overall(K.verdicts(both, ["dimension", "segment"], "b", "v", "t"), ["dimension"])


_IC = """{c} AS (SELECT {k}, count(*) AS n, CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 AND count(*) >= 8 THEN corr(a, b) END AS ic FROM (SELECT *, {ra} AS a, {rb} AS b FROM l WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY {k})"""


def _ic_sql(name: str, k: str) -> str:
    return _IC.format(c=name, k=k, ra=RANK.format(c=k, x="x"), rb=RANK.format(c=k, x="y"))


_SIGN = "CASE WHEN abs({0}) >= 1e-12 THEN sign({0}) END"


@query(f"""WITH {PANEL}, l AS (SELECT 'before' AS feature, month, segment, before AS x, ahead AS y FROM panel UNION ALL SELECT 'spend', month, segment, spend, ahead FROM panel UNION ALL SELECT 'n_orders', month, segment, n_orders, ahead FROM panel),
    {_ic_sql('i', 'feature, month')}, {_ic_sql('j', 'feature, segment, month')},
    h AS (SELECT feature, CASE WHEN count(*) FILTER (month < DATE '1998-01-01') >= 12 THEN avg(ic) FILTER (month < DATE '1998-01-01') END AS first_half, CASE WHEN count(*) FILTER (month >= DATE '1998-01-01') >= 12 THEN avg(ic) FILTER (month >= DATE '1998-01-01') END AS second_half FROM i WHERE ic IS NOT NULL GROUP BY 1),
    s AS (SELECT feature, segment, avg(ic) AS ic FROM j WHERE ic IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 12),
    t AS (SELECT feature, count(*) AS strata, min({_SIGN.format('ic')}) AS lo, max({_SIGN.format('ic')}) AS hi FROM s GROUP BY 1),
    k AS (SELECT *, (row_number() OVER (PARTITION BY feature ORDER BY month) - 1) % 3 AS k FROM i WHERE ic IS NOT NULL), p AS (SELECT feature, k, count(*) AS n, avg(ic) AS m, stddev_samp(ic) AS s, count(*) FILTER (ic > 1e-12) AS p FROM k GROUP BY 1, 2),
    o AS (SELECT feature, CAST(sum(n) AS BIGINT) AS months, avg(m) FILTER (n >= 6 AND s > 0) AS mean_ic, avg(m / (s / sqrt(n))) FILTER (n >= 6 AND s > 0) AS mean_t, sum(p) / sum(n) AS positive_share FROM p GROUP BY 1 HAVING sum(n) >= 24),
    g AS (SELECT feature, avg((x IS NULL)::INT) * 100 AS missing_pct FROM l GROUP BY 1), q AS (SELECT feature, avg(n) AS names FROM (SELECT feature, month, count(*) AS n FROM l WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    a AS (SELECT *, greatest(lo, hi, {_SIGN.format('first_half')}, {_SIGN.format('second_half')}) AS up, least(lo, hi, {_SIGN.format('first_half')}, {_SIGN.format('second_half')}) AS down, coalesce(lo, hi, {_SIGN.format('first_half')}, {_SIGN.format('second_half')}) AS known_sign
        FROM g LEFT JOIN q USING (feature) LEFT JOIN o USING (feature) LEFT JOIN h USING (feature) LEFT JOIN t USING (feature))
    SELECT feature, months, round(mean_ic, 6) AS mean_ic, round(mean_t, 5) AS mean_t, round(positive_share, 6) AS positive_share, round(missing_pct, 6) AS missing_pct, round(names, 6) AS names, round(first_half, 6) AS first_half, round(second_half, 6) AS second_half, coalesce(strata, 0) AS strata,
        CASE WHEN missing_pct > 50 OR mean_ic IS NULL OR coalesce(names, 0) < 15 THEN 'DATA_QUALITY_LIMITED' WHEN up <> down THEN 'UNSTABLE' WHEN abs(mean_ic) < 0.02 THEN 'WEAK'
            WHEN abs(mean_ic) >= 0.03 AND abs(mean_t) >= 2 AND missing_pct <= 30 AND coalesce({_SIGN.format('mean_ic')} = known_sign, TRUE) THEN 'PROMISING' ELSE 'WEAK' END AS label FROM a""")
def feature_report(spark, sf):
    df = X.feature_report(panel(spark, sf), ["before", "spend", "n_orders"], "month", "ahead", "segment", 3, "1998-01-01")
    return df.withColumns({k: F.round(k, 6) for k in ("mean_ic", "positive_share", "missing_pct", "names", "first_half", "second_half")} | {"mean_t": F.round("mean_t", 5)})


@query(f"""WITH {PANEL}, r AS (SELECT id, month, {RANK.format(c='month', x='n_orders')} / count(*) OVER (PARTITION BY month) AS a, CASE WHEN before IS NOT NULL THEN {RANK.format(c='month', x='before')} / count(before) OVER (PARTITION BY month) END AS b FROM panel)
    SELECT id, month, round((a + coalesce(1 - b, 0)) / (1 + (b IS NOT NULL)::INT), 6) AS comp_activity FROM r""")
def component_composites(spark, sf):
    return K.composites(panel(spark, sf), ["month"], {"activity": {"n_orders": 1, "before": -1}}).select("id", "month", F.round("comp_activity", 6).alias("comp_activity"))


TRACES = """t AS (SELECT o_custkey AS k, o_orderpriority <> '1-URGENT' AS accepted, CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'FAILED' END AS status, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 150 + CAST(o_orderkey % 400 AS INT) AS b FROM orders),
    s AS (SELECT c_custkey AS k, DATE '1993-01-01' + CAST(c_custkey % 900 AS INT) AS st, DATE '1994-06-01' + CAST(c_custkey % 900 AS INT) AS en FROM customer)"""


@query(f"""WITH {TRACES}, j AS (SELECT s.*, a, b, max(b) OVER (PARTITION BY s.k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s JOIN t ON s.k = t.k WHERE accepted AND status = 'COMPLETED'),
    g AS (SELECT *, sum(CASE WHEN a > greatest(coalesce(p, st - 1), st - 1) + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS broken FROM j), f AS (SELECT k, max(b) AS far FROM g WHERE broken = 0 GROUP BY 1),
    n AS (SELECT k, count(*) AS tried, count(*) FILTER (status = 'COMPLETED') AS done FROM t WHERE accepted GROUP BY 1)
    SELECT s.k, CASE WHEN tried IS NULL THEN 'NOT_ATTEMPTED' WHEN done = 0 THEN 'ATTEMPTED_FAILED' WHEN far >= en THEN 'VERIFIED_COVERAGE' ELSE 'PARTIAL_PERIOD' END AS state, CASE WHEN far >= st THEN least(far, en) END AS covered_to
    FROM s LEFT JOIN n ON n.k = s.k LEFT JOIN f ON f.k = s.k""")
def ingestion_states(spark, sf):
    from ..operators import cohorts

    d = F.to_date("o_orderdate")
    traces = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("k"), (F.col("o_orderpriority") != "1-URGENT").alias("accepted"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED").alias("status"), d.alias("period_start"), F.date_add(d, 150 + (F.col("o_orderkey") % 400).cast("int")).alias("period_end")
    )
    shift = (F.col("c_custkey") % 900).cast("int")
    spans = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.date_add(F.lit("1993-01-01").cast("date"), shift).alias("start"), F.date_add(F.lit("1994-06-01").cast("date"), shift).alias("end"))
    return cohorts.ingestion_state(spans, traces, "k").select("k", "state", "covered_to")


_COHORT = f"""{PANEL}, c AS (SELECT id, month, before IS NOT NULL AS history, n_orders > 0 AS price, CASE WHEN id % 7 <> 0 THEN spend > 50000 END AS facts FROM panel)"""
_LAYERS = {"history": 0.8, "price": 0.98, "facts": 0.6}


def _cohort(spark, sf):
    return panel(spark, sf).select("id", "month", F.col("before").isNotNull().alias("history"), (F.col("n_orders") > 0).alias("price"), F.when(F.col("id") % 7 != 0, F.col("spend") > 50000).alias("facts"))


_SHARES = ", ".join(f"avg(coalesce({k}, FALSE)::INT) AS {k}_share" for k in _LAYERS)
_READY = ", ".join(f"{k}_share >= {t} AS {k}_ready" for k, t in _LAYERS.items())
_ALL = " AND ".join(f"{k}_share >= {t}" for k, t in _LAYERS.items())


@query(f"WITH {_COHORT}, a AS (SELECT month, count(*) AS members, {_SHARES} FROM c GROUP BY 1) SELECT month, members, {', '.join(f'round({k}_share, 6) AS {k}_share' for k in _LAYERS)}, {_READY}, {_ALL} AS eligible FROM a")
def cohort_layers(spark, sf):
    from ..operators import cohorts

    df = cohorts.layers(_cohort(spark, sf), "month", _LAYERS)
    return df.withColumns({f"{k}_share": F.round(f"{k}_share", 6) for k in _LAYERS})


@query(f"""WITH {_COHORT}, l AS (SELECT id, unnest([{', '.join(f"CASE WHEN NOT coalesce({k}, FALSE) THEN '{k}' END" for k in _LAYERS)}]) AS layer FROM c) SELECT id, layer, count(*) AS dates FROM l WHERE layer IS NOT NULL GROUP BY 1, 2""")
def cohort_blockers(spark, sf):
    from ..operators import cohorts

    return cohorts.blockers(_cohort(spark, sf), "id", list(_LAYERS))


@query(f"""WITH {_COHORT}, a AS (SELECT month, {_SHARES} FROM c GROUP BY 1), e AS (SELECT month, {_ALL} AS eligible FROM a), g AS (SELECT month, year(month) * 12 + month(month) AS o FROM e WHERE eligible),
    r AS (SELECT month, o - row_number() OVER (ORDER BY o) AS g FROM g), i AS (SELECT min(month) AS d, count(*) AS n FROM r GROUP BY g), y AS (SELECT year(month) AS y, count(*) AS n FROM g GROUP BY 1)
    SELECT count(*) AS total_dates, count(*) FILTER (eligible) AS eligible_dates, min(month) FILTER (eligible) AS first_eligible, (SELECT min(d) FROM i WHERE n >= 3) AS first_run, (SELECT CAST(min(y) AS INT) FROM y WHERE n = 12) AS first_complete_year FROM e""")
def cohort_summary(spark, sf):
    from ..operators import cohorts

    return cohorts.summary(cohorts.layers(_cohort(spark, sf), "month", _LAYERS), "month", 3)


_D_EDGE = "CASE WHEN count(*) FILTER (call = 'UP') >= {least} THEN avg((ret > 0)::INT) FILTER (call = 'UP') - avg((ret > 0)::INT) END"
_D_RANK = "(rank() OVER (PARTITION BY variant, horizon ORDER BY {0}) + (count(*) OVER (PARTITION BY variant, horizon, {0}) - 1) / 2.0)"
VARIANTS = {"base": ("call_a", "score_a"), "other": ("call_b", "score_b"), "strict": ("call_c", "score_b")}
_DIMENSIONS = f"""{CALLS}, d AS (SELECT id, month, segment, ret, horizon + 1 AS horizon, score AS score_a, (score * 3 + id) % 7 AS score_b, call AS call_a, call2 AS call_b, CASE WHEN call = 'UP' AND call2 <> 'DOWN' THEN 'UP' ELSE 'NEUTRAL' END AS call_c,
        CASE WHEN id % 5 <> 0 THEN ret - 0.01 * (id % 4) END AS reward, CASE WHEN month < DATE '1995-06-01' THEN 'before' WHEN month >= DATE '1996-01-01' THEN 'after' END AS period, year(month) * 12 + month(month) AS m FROM c),
    v AS ({' UNION ALL '.join(f"SELECT id, m, segment, ret, horizon, reward, period, '{n}' AS variant, {c} AS call, {s} AS score FROM d" for n, (c, s) in VARIANTS.items())}),
    t AS (SELECT *, greatest(floor(count(*) OVER k / 5), 1) AS k, count(*) OVER k AS n, row_number() OVER (PARTITION BY variant, horizon, m ORDER BY score DESC, id DESC) AS u, row_number() OVER (PARTITION BY variant, horizon, m ORDER BY score, id) AS l FROM v WINDOW k AS (PARTITION BY variant, horizon, m)),
    p AS (SELECT variant, horizon, m, avg(ret) FILTER (u <= k) - avg(ret) FILTER (l <= k) AS e, avg(score) FILTER (u <= k) > avg(score) FILTER (l <= k) AS ok FROM t WHERE n >= 10 GROUP BY 1, 2, 3),
    g AS (SELECT variant, horizon, 'edge' AS dimension, {_D_EDGE.format(least=10)} AS value FROM v GROUP BY 1, 2
        UNION ALL SELECT variant, horizon, 'r', CASE WHEN count(reward) FILTER (call = 'UP') >= 10 THEN avg(reward) FILTER (call = 'UP') END FROM v GROUP BY 1, 2
        UNION ALL SELECT variant, horizon, 'robust', avg((e > 0)::INT) FROM (SELECT variant, horizon, m % horizon AS o, {_D_EDGE.format(least=10)} AS e FROM v GROUP BY 1, 2, 3) GROUP BY 1, 2
        UNION ALL SELECT variant, horizon, 'region', avg((e > 0)::INT) FROM (SELECT variant, horizon, segment, {_D_EDGE.format(least=30)} AS e FROM v GROUP BY 1, 2, 3) GROUP BY 1, 2
        UNION ALL SELECT variant, horizon, 'temporal', CASE WHEN count(e) = 2 THEN min(e) END FROM (SELECT variant, horizon, period, {_D_EDGE.format(least=10)} AS e FROM v WHERE period IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2
        UNION ALL SELECT variant, horizon, 'ic', CASE WHEN count(*) >= 30 THEN corr(a, b) END FROM (SELECT *, {_D_RANK.format('score')} AS a, {_D_RANK.format('ret')} AS b FROM v) GROUP BY 1, 2
        UNION ALL SELECT variant, horizon, 'tb', avg(e) FROM p WHERE ok GROUP BY 1, 2)"""


def _dimensions(spark, sf):
    c, i = _calls(spark, sf), F.col("id")
    d = c.select(
        "id", "month", "segment", "ret", (F.col("horizon") + 1).alias("horizon"), F.col("score").alias("score_a"), ((F.col("score") * 3 + i) % 7).alias("score_b"), F.col("call").alias("call_a"), F.col("call2").alias("call_b"),
        F.when((F.col("call") == "UP") & (F.col("call2") != "DOWN"), "UP").otherwise("NEUTRAL").alias("call_c"), F.when(i % 5 != 0, F.col("ret") - 0.01 * (i % 4)).alias("reward"),
        F.when(F.col("month") < "1995-06-01", "before").when(F.col("month") >= "1996-01-01", "after").alias("period"), (F.year("month") * 12 + F.month("month")).alias("m"),
    )
    return R.dimensions(d, VARIANTS, "id", "horizon", "m", "ret", "reward", "segment", "period", "id")


@query(f"WITH {_DIMENSIONS} SELECT variant, horizon, dimension, round(value, 5) + 0.0 AS value FROM g")
def variant_dimensions(spark, sf):
    return _dimensions(spark, sf).withColumn("value", F.round("value", 5) + 0.0)


@query(f"""WITH {_DIMENSIONS}, b AS (SELECT * FROM g WHERE variant = 'base'), o AS (SELECT * FROM g WHERE variant <> 'base'), n AS (SELECT DISTINCT variant FROM o),
    j AS (SELECT n.variant, k.horizon, k.dimension, b.value AS b, o.value AS v FROM n CROSS JOIN (SELECT DISTINCT horizon, dimension FROM g) k LEFT JOIN b USING (horizon, dimension) LEFT JOIN o ON o.variant = n.variant AND o.horizon = k.horizon AND o.dimension = k.dimension),
    w AS (SELECT variant, dimension, avg(b) AS base, avg(v) AS value, avg(v) - avg(b) AS d, avg((v > b)::INT) AS u, avg((v < b)::INT) AS l, CASE dimension {' '.join(f"WHEN '{k}' THEN {x}" for k, x in R.TOLERANCES.items())} END AS t FROM j GROUP BY 1, 2),
    x AS (SELECT *, CASE WHEN d >= t AND u >= 0.6 THEN 'IMPROVES' WHEN -d >= t AND l >= 0.6 THEN 'DEGRADES' ELSE 'INCONCLUSIVE' END AS verdict FROM w),
    y AS (SELECT variant, count(*) FILTER (verdict = 'IMPROVES') AS improves, count(*) FILTER (verdict = 'DEGRADES') AS degrades FROM x GROUP BY 1)
    SELECT variant, dimension, round(base, 5) + 0.0 AS base, round(value, 5) + 0.0 AS value, verdict, improves, degrades, CASE WHEN improves >= 3 AND degrades = 0 THEN 'IMPROVES' WHEN degrades >= 2 THEN 'DEGRADES' ELSE 'INCONCLUSIVE' END AS overall FROM x JOIN y USING (variant)""")
def variant_overall(spark, sf):
    df = R.compared(_dimensions(spark, sf), "base", ["other", "strict"])
    return df.withColumns({k: F.round(k, 5) + 0.0 for k in ("base", "value")})
