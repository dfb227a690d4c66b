"""Queries of zones as known at each bar, and of the risk features that use them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import features as T
from ..operators import recursive as R
from ..operators import zones as Z
from ..operators.rulebook import RAW, RULES, SELL_AT, WEIGHTS
from .features import _PARTS, PANEL_SQL, SPANS, _panel
from .registry import query
from .series import NUMBERED, TRUE_RANGE, _wilder_sql, bars

#: The bars of the table span thirty days, so that lengths are short.
RULES_HERE = Z.Rules(side=1, lookback=14, width=0.75, half_life=4.0, volume_mean=6, fresh=4, lone=6)


def _zones_sql(r: Z.Rules) -> str:
    """b (bars with pos and atr), vis (points that a bar sees, in order of level) and z (its clusters). The recursion steps through a bar's points."""
    side = f"(PARTITION BY user_id ORDER BY pos ROWS BETWEEN {{}} PRECEDING AND {{}} {{}})"
    before, after, both = side.format(r.side, 1, "PRECEDING"), side.format(-1, r.side, "FOLLOWING").replace("-1 PRECEDING", "1 FOLLOWING"), side.format(r.side, r.side, "FOLLOWING")
    return f"""{NUMBERED}, tr AS (SELECT user_id, session_date, i - 1 AS i, {TRUE_RANGE} AS tr FROM n WHERE i > 1),
    wa AS (SELECT user_id, session_date, {_wilder_sql('tr', 'tr', SPANS.wilder)} AS atr FROM tr y),
    b AS MATERIALIZED (SELECT n.user_id, n.session_date, n.i - 1 AS pos, high, low, close, volume, atr FROM n LEFT JOIN wa USING (user_id, session_date)),
    pt AS MATERIALIZED (SELECT user_id, pos, session_date AS day, 'RESISTANCE' AS kind, high AS level, volume, greatest(high - min(low) OVER {after}, 0) AS move FROM b
        QUALIFY high > max(high) OVER {before} AND high >= max(high) OVER {after} AND count(high) OVER {both} = {2 * r.side + 1}
        UNION ALL SELECT user_id, pos, session_date, 'SUPPORT', low, volume, greatest(max(high) OVER {after} - low, 0) FROM b
        QUALIFY low < min(low) OVER {before} AND low <= min(low) OVER {after} AND count(low) OVER {both} = {2 * r.side + 1}),
    vis AS MATERIALIZED (SELECT b.user_id, b.pos AS t, b.atr, b.close, p.pos, p.day, p.kind, p.level, p.move, row_number() OVER (PARTITION BY b.user_id, b.pos, p.kind ORDER BY p.level, p.pos) AS k,
            (SELECT CASE WHEN count(*) >= 5 AND avg(x.volume) > 0 THEN p.volume / avg(x.volume) END FROM b x WHERE x.user_id = p.user_id AND x.pos BETWEEN greatest(p.pos - {r.volume_mean - 1}, b.pos - {r.lookback - 1}) AND p.pos) AS ratio
        FROM b JOIN pt p ON p.user_id = b.user_id AND p.pos BETWEEN greatest(b.pos - {r.lookback - 1}, 0) + {r.side} AND b.pos - {r.side} WHERE b.atr > 0 AND b.pos + 1 >= {2 * r.side + 2}),
    cl AS (SELECT user_id, t, kind, k, 1 AS c, level AS total, 1 AS m FROM vis WHERE k = 1
        UNION ALL SELECT v.user_id, v.t, v.kind, v.k, CASE WHEN abs(v.level - total / m) <= {r.width} * v.atr THEN c ELSE c + 1 END, CASE WHEN abs(v.level - total / m) <= {r.width} * v.atr THEN total + v.level ELSE v.level END, CASE WHEN abs(v.level - total / m) <= {r.width} * v.atr THEN m + 1 ELSE 1 END
        FROM cl JOIN vis v ON v.user_id = cl.user_id AND v.t = cl.t AND v.kind = cl.kind AND v.k = cl.k + 1),
    g AS (SELECT user_id, t, kind, c, any_value(atr) AS atr, any_value(close) AS close, min(level) AS lo, max(level) AS hi, CAST(count(*) AS INT) AS touches, min(day) AS first_touch, max(day) AS last_touch, CAST(t - max(pos) AS INT) AS age,
            t - arg_min(pos, k) AS lowest_age, avg(move) / any_value(atr) AS rejection, avg(pow(0.5, (t - pos) / {r.half_life})) AS recency, avg(ratio) AS volume_confirmation FROM vis JOIN cl USING (user_id, t, kind, k) GROUP BY 1, 2, 3, 4),
    z AS MATERIALIZED (SELECT * EXCLUDE (lo, hi), (lo + hi) / 2 AS midpoint, CASE WHEN hi - lo < {2 * r.thin} * atr THEN (lo + hi) / 2 - {r.thin} * atr ELSE lo END AS lower, CASE WHEN hi - lo < {2 * r.thin} * atr THEN (lo + hi) / 2 + {r.thin} * atr ELSE hi END AS upper FROM g),
    near AS MATERIALIZED (SELECT *, abs(midpoint - close) / atr AS distance_atr, CAST(row_number() OVER (PARTITION BY user_id, t, kind ORDER BY abs(midpoint - close) / atr) AS INT) AS place FROM z
        WHERE CASE kind WHEN 'SUPPORT' THEN midpoint < close ELSE midpoint > close END AND (touches >= {r.least_touches} OR rejection >= {r.least_rejection}) QUALIFY place <= {r.nearest})"""


ZONES_SQL = _zones_sql(RULES_HERE)
#: The support of the bar before, with the highest upper edge.
FROZEN_SQL = "fs AS (SELECT user_id, t + 1 AS pos, arg_max(lower, upper) AS support_low, max(upper) AS support_high, arg_max(touches, upper) AS support_touches, arg_max(age, upper) AS support_age FROM near WHERE kind = 'SUPPORT' GROUP BY 1, 2)"


def with_atr(spark, sf):
    b = bars(spark, sf)
    return b.join(R.atr(b, "user_id", "session_date", SPANS.wilder), ["user_id", "session_date"], "left")


def _r(df, digits, *names):
    return df.withColumns({n: rounded(n, digits) for n in names})


@query(f"""WITH RECURSIVE {ZONES_SQL} SELECT user_id, b.session_date, kind, place, round(lower, 5) AS lower, round(upper, 5) AS upper, round(midpoint, 5) AS midpoint, touches, first_touch, last_touch, age,
        round(100 * (0.4 * least(touches, 5) / 5 + 0.3 * recency + 0.3 * least(rejection / 3, 1)), 1) AS strength, round(rejection, 5) AS rejection, round(recency, 5) AS recency, round(volume_confirmation, 9) AS volume_confirmation,
        round(midpoint / nullif(near.close, 0) - 1, 5) AS distance, round(distance_atr, 5) AS distance_atr FROM near JOIN b USING (user_id) WHERE b.pos = t""")
def zones_as_of(spark, sf):
    """Every bar's nearest zones on either side, from what was confirmed by its close."""
    df = Z.zones_as_of(with_atr(spark, sf), "user_id", "session_date", RULES_HERE)
    return _r(_r(df, 5, "lower", "upper", "midpoint", "rejection", "recency", "distance", "distance_atr"), 9, "volume_confirmation")


@query(f"""WITH RECURSIVE {ZONES_SQL}, br AS (SELECT z.*, upper + {RULES_HERE.clear} * atr AS trigger, (SELECT min(x.session_date) FILTER (x.close > z.upper + {RULES_HERE.clear} * z.atr) FROM b x WHERE x.user_id = z.user_id AND x.pos BETWEEN z.t - {RULES_HERE.fresh - 1} AND z.t) AS broke_on,
            (SELECT count(*) FROM b x WHERE x.user_id = z.user_id AND x.pos BETWEEN z.t - {RULES_HERE.fresh - 1} AND z.t AND x.close <= z.upper) AS under FROM z WHERE kind = 'RESISTANCE'),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, t ORDER BY (close - upper) / atr) AS INT) AS place FROM br WHERE close > trigger AND under > 0 AND NOT (touches < 2 AND lowest_age > {RULES_HERE.lone}) QUALIFY place <= {RULES_HERE.broken})
    SELECT user_id, b.session_date, place, round(lower, 5) AS lower, round(upper, 5) AS upper, round(midpoint, 5) AS midpoint, touches, round(trigger, 5) AS trigger, broke_on, round((k.close - upper) / k.atr, 5) AS distance_atr FROM k JOIN b USING (user_id) WHERE b.pos = t""")
def broken_resistances(spark, sf):
    df = Z.broken_resistances(with_atr(spark, sf), "user_id", "session_date", RULES_HERE)
    return _r(df, 5, "lower", "upper", "midpoint", "trigger", "distance_atr")


@query(f"""WITH RECURSIVE {ZONES_SQL}, {FROZEN_SQL} SELECT user_id, session_date, round(support_low, 5) AS support_low, round(support_high, 5) AS support_high, support_touches, support_age FROM b LEFT JOIN fs USING (user_id, pos)""")
def frozen_support(spark, sf):
    """Of every bar, the support as it stood before the bar."""
    return _r(Z.frozen_support(with_atr(spark, sf), "user_id", "session_date", RULES_HERE), 5, "support_low", "support_high")


def _alert_sql(horizon: int) -> str:
    bucket = WEIGHTS["SHORT" if horizon <= 3 else "MEDIUM" if horizon <= 8 else "LONG"]
    raws = {
        "trend": "CASE trend_state" + "".join(f" WHEN '{a}' THEN {v}" for a, v in RAW["trend"].items()) + " END", "long_trend": "CASE WHEN distance_long > 0 THEN 1.0 WHEN distance_long IS NOT NULL THEN -1.0 END",
        "momentum": "CASE WHEN ret_half > 0 THEN 1.0 WHEN ret_half IS NOT NULL THEN -1.0 END", "support": "CASE WHEN support_low IS NOT NULL AND atr <> 0 THEN CASE WHEN close < support_low - 0.5 * atr THEN -2.0 ELSE 0.0 END END",
    }
    score = " + ".join(f"coalesce({raws[k]} * {bucket[i]}, 0)" for i, k in enumerate(RULES) if k in raws)
    return f"CASE WHEN trend_state IS NOT NULL AND {score} <= {SELL_AT} THEN 1 WHEN trend_state IS NOT NULL OR distance_long IS NOT NULL THEN 0 END AS risk_alert_h{horizon}"


_PANEL_ONLY = PANEL_SQL.replace("bars AS (", "bars0 AS (", 1).replace(" FROM bars WINDOW", " FROM bars0 WINDOW").replace(", b AS (", ", pb AS (").replace("FROM b)", "FROM pb)")


@query(f"""WITH RECURSIVE {ZONES_SQL}, {FROZEN_SQL}, {_PANEL_ONLY},
    s AS (SELECT f.*, atr, support_low, {' + '.join(f'({p} IS NOT NULL)::INT' for p in _PARTS)} AS known, {' + '.join(f'CASE WHEN {p} > 0 THEN 1 WHEN {p} IS NOT NULL THEN -1 ELSE 0 END' for p in _PARTS)} AS score
        FROM f JOIN b USING (user_id, session_date) LEFT JOIN fs ON fs.user_id = b.user_id AND fs.pos = b.pos),
    tr2 AS (SELECT *, CASE WHEN known >= 4 THEN CASE WHEN score >= 4 THEN 'STRONG_UPTREND' WHEN score >= 2 THEN 'UPTREND' WHEN score >= -1 THEN 'NEUTRAL' WHEN score >= -3 THEN 'DOWNTREND' ELSE 'STRONG_DOWNTREND' END END AS trend_state FROM s)
    SELECT user_id, session_date, trend_state, (distance_long < 0)::INT AS rc_below_long, (ret_half < 0)::INT AS rc_momentum_negative, (close < support_low)::INT AS rc_support_broken, (vol_quarter > 1.25 * vol_year)::INT AS rc_elevated_volatility,
        (drawdown_year <= -0.15)::INT AS rc_drawdown_state, {', '.join(_alert_sql(h) for h in T.ALERT_HORIZONS)} FROM tr2""")
def risk_alerts(spark, sf):
    """Components and alerts of every bar, support included."""
    support = Z.frozen_support(with_atr(spark, sf), "user_id", "session_date", RULES_HERE)
    r = T.risk_features(_panel(spark, sf).join(support, ["user_id", "session_date"]), F.col("support_low"))
    flags = ["rc_below_long", "rc_momentum_negative", "rc_support_broken", "rc_elevated_volatility", "rc_drawdown_state", *[f"risk_alert_h{h}" for h in T.ALERT_HORIZONS]]
    return r.select("user_id", "session_date", "trend_state", *[F.col(c).cast("int").alias(c) for c in flags])
