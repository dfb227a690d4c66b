"""Zones as of each bar against loops over its own past, and that no later bar moves them."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, zones

D0 = dt.date(2020, 1, 1)
SCHEMA = "k string, d date, high double, low double, close double, volume double, atr double"


def walk(seed, n, key="a"):
    rng, price, out = random.Random(seed), 50.0, []
    for i in range(n):
        price = max(5.0, price + rng.gauss(0, 1.5))
        out.append((key, D0 + dt.timedelta(i), price + rng.random() * 2, price - rng.random() * 2, price, float(rng.randint(50, 150)), None if i < 3 else 1.0 + rng.random()))
    return out


def plain(bars, t, r):
    """Zones of the last bar of bars[: t + 1], by loops."""
    start, atr, close = max(0, t - r.lookback + 1), bars[t][6], bars[t][4]
    d = bars[start : t + 1]
    if atr is None or atr <= 0 or t + 1 < 2 * r.side + 2:
        return {"SUPPORT": [], "RESISTANCE": [], "BROKEN": []}
    out = {"SUPPORT": [], "RESISTANCE": [], "BROKEN": []}
    for kind, c, sign in (("RESISTANCE", 2, 1), ("SUPPORT", 3, -1)):
        points = [
            (d[i][c], i) for i in range(r.side, len(d) - r.side)
            if all(sign * d[i][c] > sign * d[j][c] for j in range(i - r.side, i)) and all(sign * d[i][c] >= sign * d[j][c] for j in range(i + 1, i + 1 + r.side))
        ]
        clusters = []
        for level, i in sorted(points):
            if clusters and abs(level - sum(x for x, _ in clusters[-1]) / len(clusters[-1])) <= r.width * atr:
                clusters[-1].append((level, i))
            else:
                clusters.append([(level, i)])
        for cl in clusters:
            low, high, mid = cl[0][0], cl[-1][0], (cl[0][0] + cl[-1][0]) / 2
            if high - low < 2 * r.thin * atr:
                low, high = mid - r.thin * atr, mid + r.thin * atr
            places = [i for _, i in cl]
            moves = [max(0.0, (d[i][2] - min(x[3] for x in d[i + 1 : i + 1 + r.side])) if kind == "RESISTANCE" else (max(x[2] for x in d[i + 1 : i + 1 + r.side]) - d[i][3])) for i in places]
            ratio = []
            for i in places:
                v = [x[5] for x in d[max(0, i - r.volume_mean + 1) : i + 1]]
                if len(v) >= 5 and sum(v) > 0:
                    ratio.append(d[i][5] / (sum(v) / len(v)))
            n, rejection, recency = len(cl), sum(moves) / len(cl) / atr, sum(0.5 ** ((len(d) - 1 - i) / r.half_life) for i in places) / len(cl)
            recent = [x[4] for x in d[-r.fresh :]]
            if kind == "RESISTANCE" and close > high + r.clear * atr and min(recent) <= high and not (n < 2 and len(d) - 1 - cl[0][1] > r.lone):
                out["BROKEN"].append(((close - high) / atr, low, high, n, next(x[1] for x in d[-r.fresh :] if x[4] > high + r.clear * atr)))
            if (mid >= close if kind == "SUPPORT" else mid <= close) or (n < r.least_touches and rejection < r.least_rejection):
                continue
            strength = round(100 * (0.4 * min(n, 5) / 5 + 0.3 * recency + 0.3 * min(rejection / 3, 1)), 1)
            out[kind].append((abs(mid - close) / atr, low, high, n, d[min(places)][1], d[max(places)][1], len(d) - 1 - max(places), strength, sum(ratio) / len(ratio) if ratio else None))
    return {k: sorted(v)[: r.broken if k == "BROKEN" else r.nearest] for k, v in out.items()}


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert len(a) == len(b) and all(x == y or (isinstance(x, float) and x == pytest.approx(y, abs=0.11 if abs(x) > 3 and round(x, 1) == x else 1e-9)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("rules", [zones.Rules(side=2, lookback=40, fresh=8, lone=12, volume_mean=8), zones.Rules(side=5, lookback=60, half_life=20.0, fresh=10, lone=20, broken=9, nearest=9)])
def test_zones_of_every_bar_against_loops(spark, rules):
    bars = {k: walk(s, n, k) for s, (k, n) in enumerate((("a", 150), ("b", 90), ("c", 7), ("e", 1)))}
    df = spark.createDataFrame([b for rows in bars.values() for b in rows], SCHEMA).withColumn("lower", F.lit("clash"))
    near, gone, frozen = {}, {}, {}
    for z in zones.zones_as_of(df, "k", "d", rules).orderBy("place").collect():
        near.setdefault((z.k, z.d, z.kind), []).append((z.distance_atr, z.lower, z.upper, z.touches, z.first_touch, z.last_touch, z.age, z.strength, z.volume_confirmation))
    for z in zones.broken_resistances(df, "k", "d", rules).orderBy("place").collect():
        gone.setdefault((z.k, z.d), []).append((z.distance_atr, z.lower, z.upper, z.touches, z.broke_on))
    for z in zones.frozen_support(df, "k", "d", rules).collect():
        frozen[z.k, z.d] = z
    assert len(frozen) == 248
    for k, rows in bars.items():
        before = {"SUPPORT": []}
        for t, bar in enumerate(rows):
            want = plain(rows, t, rules)
            for kind in ("SUPPORT", "RESISTANCE"):
                same(near.get((k, bar[1], kind), []), want[kind])
            same(gone.get((k, bar[1]), []), want["BROKEN"])
            best = max(before["SUPPORT"], key=lambda z: z[2], default=None)
            f = frozen[k, bar[1]]
            assert (f.support_low is None) == (best is None)
            if best:
                same([(f.support_low, f.support_high, f.support_touches, f.support_age)], [(best[1], best[2], best[3], best[6])])
            before = want


def test_a_changed_future_leaves_the_past_alone(spark):
    """Support at t is of the bars before t: neither bar t nor later ones can move it."""
    rules, bars, k = zones.Rules(side=2, lookback=60), walk(5, 120), 80
    shocked = [b if i < k else (*b[:2], *(x * 0.7 for x in b[2:5]), *b[5:]) for i, b in enumerate(bars)]
    a, b = ({r.d: tuple(r) for r in zones.frozen_support(spark.createDataFrame(rows, SCHEMA), "k", "d", rules).collect()} for rows in (bars, shocked))
    days = sorted(a)
    assert all(a[d] == b[d] for d in days[: k + 1]) and any(a[d] != b[d] for d in days[k + 1 :])
    ahead = zones.zones_as_of(spark.createDataFrame(bars[:k], SCHEMA), "k", "d", rules).collect()
    whole = zones.zones_as_of(spark.createDataFrame(bars, SCHEMA), "k", "d", rules).filter(F.col("d") < F.lit(days[k])).collect()
    assert sorted(map(str, ahead)) == sorted(map(str, whole))


def test_nulls_flat_bars_and_no_bars(spark):
    flat = [("f", D0 + dt.timedelta(i), 10.0, 9.0, 9.5, 100.0, 1.0) for i in range(40)]
    holes = [(*b[:2], *(None if i % 17 == 3 else x for x in b[2:6]), None if i % 13 == 0 else b[6]) for i, b in enumerate(walk(6, 80, "h"))]
    rules = zones.Rules(side=2, lookback=30)
    df = spark.createDataFrame(flat + holes, SCHEMA)
    assert zones.zones_as_of(df, "k", "d", rules).filter("k = 'f'").count() == 0
    assert zones.frozen_support(df, "k", "d", rules).count() == 120 and zones.zones_as_of(df, "k", "d", rules).filter("k = 'h' and midpoint is null").count() == 0
    assert zones.zones_as_of(df.limit(0), "k", "d", rules).count() == 0 == zones.broken_resistances(df.limit(0), "k", "d", rules).count()


def test_alerts_are_the_sell_calls_of_the_review(spark):
    """All parts down and the support lost: every horizon alerts; without trend and long mean none is known."""
    rows = [("x", 40.0, -0.1, -0.2, -0.3, -0.1, -0.05, -0.3, 45.0, 1.0, 0.4, 0.2, -0.3), ("y", 60.0, 0.1, 0.2, 0.3, 0.1, 0.05, 0.3, 45.0, 1.0, 0.2, 0.2, -0.05), ("z", 60.0, None, None, None, None, None, -0.3, None, None, None, None, None)]
    cols = "k string, close double, distance_short double, distance_middle double, distance_long double, middle_vs_long double, slope_long double, ret_half double, s double, atr double, vol_quarter double, vol_year double, drawdown_year double"
    got = {r.k: r for r in features.risk_features(spark.createDataFrame(rows, cols), F.col("s")).collect()}
    for h in features.ALERT_HORIZONS:
        assert [got[k][f"risk_alert_h{h}"] for k in "xyz"] == [1.0, 0.0, None]
    assert [got[k].rc_support_broken for k in "xyz"] == [1.0, 0.0, None] and got["z"].trend_state is None and not math.isnan(got["x"].rc_drawdown_state)
