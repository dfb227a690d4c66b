"""Small cases of the operators, beside the comparison of each query with its SQL twin."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import actions, asof, bars, cross_section, fundamentals, intervals, quality, recursive, simulate, splits, stats, universe, windows
from tidemark.plans import trades

D = dt.date


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def day(n, month=1):
    return D(2024, month, n)


def test_as_of_view_is_strict_on_demand_and_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 3, 30), (None, 2, 40), (None, 1, 50)], "k string, av int, v int")
    assert rows(asof.as_of_view(df, ["k"], "av", F.lit(2))) == [("a", 2, 20), (None, 2, 40)]
    assert rows(asof.as_of_view(df, ["k"], "av", F.lit(2), strict=True)) == [("a", 1, 10), (None, 1, 50)]
    assert asof.as_of_view(df.limit(0), ["k"], "av", F.lit(2)).count() == 0


def test_later_versions_never_change_an_earlier_view(spark):
    df = spark.createDataFrame([(k, av, k * av) for k in range(5) for av in range(9)], "k int, av int, v int")
    for t in range(9):
        assert rows(asof.as_of_view(df, ["k"], "av", F.lit(t))) == rows(asof.as_of_view(df.filter(F.col("av") <= t), ["k"], "av", F.lit(99)))


def test_guard_fails_on_a_row_from_the_future(spark):
    df = spark.createDataFrame([(1,), (2,)], "av int")
    assert asof.guard(df, "av", F.lit(2)).count() == 2
    with pytest.raises(Exception, match="not available"):
        asof.guard(df, "av", F.lit(1)).collect()


@pytest.mark.parametrize("forward, strict, want", [(False, False, [5, 3, None]), (False, True, [3, None, None]), (True, False, [5, 3, 3]), (True, True, [None, 5, 3])])
def test_as_of_join_on_equal_times(spark, forward, strict, want):
    left = spark.createDataFrame([("a", 5), ("a", 3), ("a", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 3, 3), ("a", 5, 5), ("b", 1, 9), ("a", None, 7)], "k string, rt int, v int")
    got = {r.t: r.v for r in asof.as_of_join(left, right, ["k"], "t", "rt", ["v"], forward=forward, strict=strict).collect()}
    assert [got[t] for t in (5, 3, 1)] == want


def test_nearest_match_takes_the_earlier_of_two(spark):
    left = spark.createDataFrame([("a", day(10)), ("b", day(10))], "k string, d date")
    right = spark.createDataFrame([("a", day(12), 2), ("a", day(8), 1), ("b", day(20), 3)], "k string, rd date, v int")
    assert rows(asof.nearest_match(left, right, ["k"], "d", "rd", 5, ["v"])) == [("a", day(10), 1, 2), ("b", day(10), None, None)]


def test_intervals_are_half_open(spark):
    iv = spark.createDataFrame([("a", 1, 3, "x"), ("a", 3, None, "y")], "k string, s int, e int, w string")
    pts = spark.createDataFrame([("a", t) for t in (0, 1, 2, 3, 9)], "k string, t int")
    assert rows(intervals.interval_join(pts, iv, ["k"], "t", "s", "e").select("t", "w")) == [(1, "x"), (2, "x"), (3, "y"), (9, "y")]
    assert intervals.conflicts(iv, ["k"], "s", "e").count() == 0
    bad = iv.unionByName(spark.createDataFrame([("a", 50, 60, "z")], iv.schema))
    assert rows(intervals.conflicts(bad, ["k"], "s", "e").select("w")) == [("z",)]
    assert rows(intervals.union(iv.select("k", F.col("s"), F.lit(5).alias("e")), ["k"], "s", "e")) == [("a", 1, 5, 2)]


def test_islands_of_one_and_repeats(spark):
    df = spark.createDataFrame([("a", o) for o in (1, 2, 2, 3, 7)], "k string, o long")
    assert rows(intervals.islands(df, ["k"], F.col("o"))) == [("a", 1, 3, 3), ("a", 7, 7, 1)]


def test_price_jump_compares_with_the_last_accepted_bar(spark):
    df = spark.createDataFrame([("a", day(i + 1), c) for i, c in enumerate([10.0, 100.0, 11.0, 90.0, 12.0])], "k string, session_date date, close double")
    assert rows(bars.price_jumps(df, "k", 0.5).select("close", "before")) == [(100.0, 10.0), (90.0, 11.0)]


def test_bar_findings(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5, 10), (1.0, 0.5, 2.0, 1.5, 0), (-1.0, 2.0, 0.5, 1.5, -1), (1.0, 2.0, 0.5, None, 5)], "open double, high double, low double, close double, volume int")
    got = [r[0] for r in df.select(bars.bar_findings()).collect()]
    assert got[0] == [] and "high_below_low" in got[1] and "zero_volume" in got[1] and {"non_positive", "negative_volume"} <= set(got[2]) and "non_finite" in got[3]


def series(spark, n=60):
    x = [("a", day(1) + dt.timedelta(i), 10 + math.sin(i) * 3 + i / 20, 11 + math.sin(i) * 3 + i / 20, 9 + math.sin(i) * 3 + i / 20) for i in range(n)]
    return spark.createDataFrame([(k, d, c, h, lo, c, 5) for k, d, c, h, lo in x], "k string, session_date date, open double, high double, low double, close double, volume int")


@pytest.mark.parametrize("make", [
    lambda df: recursive.ema(df, "k", "session_date", "close", 12),
    lambda df: recursive.rsi(df, "k", "session_date", "close"),
    lambda df: recursive.macd(df, "k", "session_date", "close"),
    lambda df: recursive.atr(df, "k", "session_date"),
    lambda df: recursive.adx(df, "k", "session_date"),
    lambda df: df.select("k", "session_date", windows.sma(F.col("close"), Window.partitionBy("k").orderBy("session_date"), 7)),
])
def test_indicators_are_causal(spark, make):
    """What comes later never changes a value."""
    df = series(spark)
    cut = day(1) + dt.timedelta(40)
    whole = {r[1]: r for r in make(df).collect()}
    part = {r[1]: r for r in make(df.filter(F.col("session_date") <= cut)).collect()}
    assert len(whole) == 60 and len(part) == 41 and all(whole[d] == part[d] for d in part)
    assert make(df.limit(0)).count() == 0
    assert make(df.filter(F.col("session_date") <= day(2))).count() == 2


def test_wilder_by_hand(spark):
    df = spark.createDataFrame([("a", day(i + 1), c) for i, c in enumerate([1.0, 2.0, 1.0, 3.0])], "k string, session_date date, close double")
    got = [r.rsi for r in recursive.rsi(df, "k", "session_date", "close", 2).orderBy("session_date").collect()]
    assert got[:2] == [None, None] and got[2] == pytest.approx(50.0) and got[3] == pytest.approx(100 - 100 / (1 + 1.25 / 0.25))


def test_ranks_share_ties_and_skip_nulls(spark):
    df = spark.createDataFrame([("m", x) for x in (1.0, 2.0, 2.0, 3.0, None)] + [("n", 5.0)], "m string, x double")
    got = rows(cross_section.cohort_rank(df, ["m"], "x"))
    assert got == sorted([("m", 1.0, 0.0), ("m", 2.0, 0.5), ("m", 2.0, 0.5), ("m", 3.0, 1.0), ("m", None, None), ("n", 5.0, None)], key=str)


def test_auc_of_a_perfect_and_a_constant_score(spark):
    df = spark.createDataFrame([("p", float(i), int(i > 4)) for i in range(10)] + [("c", 1.0, i % 2) for i in range(10)] + [("x", 1.0, 1)], "g string, s double, y int")
    assert {r.g: r.auc for r in cross_section.auc(df, ["g"], "s", "y").collect()} == {"p": 1.0, "c": 0.5, "x": None}


def test_total_return_takes_split_and_cash_of_one_day(spark):
    b = spark.createDataFrame([("a", day(1), 100.0), ("a", day(2), 50.0), ("a", day(3), 55.0)], "k string, session_date date, close double")
    a = spark.createDataFrame([("a", 1, "SPLIT", day(2), dt.datetime(2024, 1, 1), 2.0, None, 0), ("a", 2, "DIVIDEND", day(2), dt.datetime(2024, 1, 9), None, 1.0, 0)], "k string, action_id int, kind string, ex_date date, announced_at timestamp, ratio double, cash_amount double, tier int")
    assert [r.gross for r in actions.total_return(b, a, "k").orderBy("session_date").collect()] == [None, pytest.approx(1.02), pytest.approx(1.1)]
    known = actions.total_return(b, a, "k", F.lit("2024-01-05").cast("timestamp"))
    assert [r.gross for r in known.orderBy("session_date").collect()][1] == pytest.approx(1.0)
    adj = [r.adj_close for r in actions.adjusted_closes(b, a, "k").orderBy("session_date").collect()]
    assert adj[2] == 55.0 and adj[1] == 50.0 and adj[0] == pytest.approx(100 * 0.5 * 0.98)


def test_collapse_sources_against_a_loop(spark, sf):
    a = trades.actions(spark, sf)
    got = {r.action_id for r in actions.collapse_sources(a, "user_id").collect()}
    want, kept = set(), []
    for r in sorted(a.collect(), key=lambda r: (r.user_id, r.tier, r.announced_at, r.action_id)):
        same = [k for k in kept if k.user_id == r.user_id and k.kind == r.kind]
        if r.kind == "DIVIDEND" and any(k.ex_date == r.ex_date for k in same):
            continue
        if r.kind == "SPLIT" and any(abs((k.ex_date - r.ex_date).days) <= 5 and abs(k.ratio - r.ratio) <= 1e-9 for k in same):
            continue
        kept.append(r)
        want.add(r.action_id)
    assert got == want


def test_replay_weighs_exits_by_their_fractions(spark):
    log = spark.createDataFrame([("t", 1, "ENTRY", 10.0, 0.0, "ENTERED"), ("t", 2, "TARGET_1", 12.0, 0.5, "PARTIAL"), ("t", 3, "STOP", 9.0, 0.5, "STOPPED")], "t string, sequence_number int, event string, price double, fraction double, state string")
    r = simulate.replay(log, "t").first()
    assert (r.state, r.exit, r.n_events) == ("STOPPED", 10.5, 3) and r.ret == pytest.approx(0.05)


def test_undo_and_replay_meet(spark):
    e = [("a", 1, "ADD"), ("b", 2, "ADD"), ("a", 5, "DELETE"), ("c", 6, "ADD"), ("a", 8, "ADD")]
    ev = spark.createDataFrame(e, "k string, t int, kind string")
    now = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    back = {r.k for r in universe.undo(now, ev, ["k"], "t", F.lit(4)).filter("member").collect()}
    assert back == {"a", "b"}
    start = spark.createDataFrame([(k,) for k in back], "k string")
    assert {r.k for r in universe.replay(start, ev, ["k"], "t", F.lit(4), F.lit(9)).filter("member and consistent").collect()} == {"a", "b", "c"}


def test_succession_leaves_cycles_out(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7)], "o int, n int")
    assert rows(universe.succession_closure(e, "o", "n")) == [(1, 4, 3), (2, 4, 2), (3, 4, 1)]


def test_ttm_reasons(spark):
    q = spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("a", D(2020, 4, 1), 2.0), ("a", D(2020, 7, 1), 3.0), ("a", D(2020, 10, 1), 4.0), ("a", D(2021, 4, 1), 5.0)], "k string, period_end date, value double")
    got = [(r.ttm, r.ttm_reason) for r in fundamentals.trailing_year(q, ["k"]).orderBy("period_end").collect()]
    assert got == [(None, "NOT_ENOUGH_HISTORY")] * 3 + [(10.0, None), (None, "GAP")]


def test_unknown_checks_fail(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    assert rows(quality.funnel(df, [("SMALL", F.col("x") > 2)])) == [("ELIGIBLE", 1), ("SMALL", 2)]


def test_folds_do_not_leak(spark):
    folds = splits.plan_folds(spark, "2015-01-01", "2020-12-01", 24, 6, 6, 6, embargo=2)
    obs = spark.sql("select explode(sequence(date'2015-01-01', date'2020-12-01', interval 1 month)) as t").withColumns({"e": F.add_months("t", 12), "a": F.add_months("t", 12)})
    got = splits.assign(obs, folds, "t", "e", "a")
    assert splits.integrity(got, "t", "e", "a").filter("leaks > 0").count() == 0
    assert {r.role for r in got.select("role").distinct().collect()} >= {"TRAIN", "UNAVAILABLE", "EMBARGOED", "VALIDATION", "TEST"}


def test_equity_drawdown_counts_from_the_start(spark):
    d = spark.createDataFrame([("a", day(1), -0.5), ("a", day(2), 0.1)], "k string, d date, r double")
    r = stats.equity_stats(d, ["k"], "d", "r").first()
    assert r.max_drawdown == pytest.approx(0.5) and r.total_return == pytest.approx(-0.45) and r.cagr is None


def test_identifiers(spark):
    df = spark.createDataFrame([("037833100", "US0378331005"), ("037833101", "US0378331006"), ("", None)], "c string, i string")
    assert rows(df.select(S.cusip_valid(F.col("c")), S.isin_valid(F.col("i")))) == [(False, False), (False, False), (True, True)]


def test_repeated_hour_is_the_later_instant(spark):
    df = spark.sql("select timestamp'2021-11-07 01:30:00' as t union all select timestamp'2021-07-01 12:00:00'")
    got = rows(df.select(F.date_format(S.wall_clock_to_utc(F.col("t"), "America/New_York"), "yyyy-MM-dd HH:mm")))
    assert got == [("2021-07-01 16:00",), ("2021-11-07 06:30",)]


def test_names_and_week_keys(spark):
    df = spark.createDataFrame([("Café Ñandú, S.A. Holdings Inc.", D(2021, 1, 1))], "n string, d date")
    assert df.select(S.normal_name(F.col("n")), S.week_key(F.col("d"))).first()[:] == ("CAFE NANDU S A", "2020-W53")


def test_match_one_to_one_against_a_loop(spark):
    from tidemark.operators import review
    from tidemark.plans import reviews

    l = [("a", i, day(i * 3 % 28 + 1)) for i in range(8)]
    r = [("a", 100 + i, day(i * 5 % 28 + 1)) for i in range(6)] + [("b", 9, day(1))]
    left, right = spark.createDataFrame(l, "g string, x long, d date"), spark.createDataFrame(r, "g string, y long, e date")
    used, want = set(), set()
    for gap, x, y in sorted((abs((d - e).days), x, y) for g, x, d in l for h, y, e in r if g == h and abs((d - e).days) <= 9):
        if x not in used and y not in used:
            used |= {x, y}
            want.add((x, y, gap))
    got = review.match_one_to_one(left, right, "g", "x", "y", "d", "e", 9)
    assert {(r.x, r.y, r.days_apart) for r in got.collect()} == want
    assert reviews.match_discovery.__doc__


def test_class_sets_need_a_pool_of_their_size(spark):
    from tidemark.operators import review

    legs = spark.createDataFrame([("c", 1, ["B", "A"]), ("c", 2, ["A", "B"]), ("d", 1, ["A", "B"]), ("e", 1, ["A", "B"]), ("e", 2, ["A", "C"])], "clause string, place int, pool array<string>")
    assert rows(review.class_sets(legs, ["clause"], "place", "pool")) == [("c", 1, "A"), ("c", 2, "B")]


def test_matching_in_rounds_against_a_loop(spark):
    """Chains in which each pair taken frees or blocks the next, across bands of days, and a large group."""
    from tidemark.operators import review

    rng = __import__("random").Random(5)
    l = [(g, g * 10_000 + i, D(2020, 1, 1) + dt.timedelta(rng.randint(0, 300))) for g in range(3) for i in range(60)]
    r = [(g, g * 10_000 + 5_000 + i, D(2020, 1, 1) + dt.timedelta(rng.randint(0, 300))) for g in range(3) for i in range(50)]
    used, want = set(), set()
    for gap, x, y in sorted((abs((d - e).days), x, y) for g, x, d in l for h, y, e in r if g == h and abs((d - e).days) <= 7):
        if x not in used and y not in used:
            used |= {x, y}
            want.add((x, y, gap))
    got = review.match_one_to_one(spark.createDataFrame(l, "g int, x long, d date"), spark.createDataFrame(r, "g int, y long, e date"), "g", "x", "y", "d", "e", 7)
    assert {(m.x, m.y, m.days_apart) for m in got.collect()} == want


def test_match_discovery_against_a_loop(spark, sf):
    from tidemark import plans

    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"), "o_orderstatus").collect()
    by = {}
    for x in o:
        by.setdefault(x.o_custkey, {"F": [], "O": [], "P": []})[x.o_orderstatus].append((x.o_orderkey, x.d))
    want = set()
    for c, k in by.items():
        used = set()
        for gap, f, q in sorted((abs((d - e).days), f, q) for f, d in k["F"] for q, e in k["O"] + k["P"] if abs((d - e).days) <= 120):
            if f not in used and q not in used:
                used |= {f, q}
                want.add((c, f, q, gap))
    assert {tuple(r) for r in plans.QUERIES["match_discovery"](spark, sf).select("o_custkey", "f", "o", "days_apart").collect()} == want


def test_succession_with_cycles_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("w", "x")], "o string, n string")
    assert rows(universe.succession_closure(edges, "o", "n")) == [("a", "c", 2), ("b", "c", 1)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "o int, n int")
    assert rows(universe.succession_closure(chain, "o", "n").filter("o = 0")) == [(0, 70, 70)]


def test_ranks_and_quantiles_of_whole_columns(spark):
    import numpy as np
    import pandas as pd

    from tidemark.operators import ranks

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 4000), "x": np.where(rng.random(4000) < 0.4, 7.0, np.round(rng.normal(size=4000), 2)), "y": rng.normal(size=4000)})
    pdf.loc[rng.random(4000) < 0.1, "x"] = None
    pdf["z"] = pdf["x"] * 2 + rng.normal(size=4000) * 0.01
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "g long, x double, y double, z double")
    want = pdf.dropna(subset="x").drop_duplicates("x").set_index("x").index
    expected = dict(zip(pdf["x"].dropna(), pdf["x"].dropna().rank()))
    assert {r.x: r["rank"] for r in ranks.value_ranks(df, [], "x").collect()} == expected and len(want) == len(expected)
    q = {r.g: (r.a, r.b) for r in ranks.quantiles(df, ["g"], "x", {"a": 0.25, "b": 0.9}).collect()}
    for g, part in pdf.groupby("g"):
        assert q[g] == (pytest.approx(part["x"].quantile(0.25)), pytest.approx(part["x"].quantile(0.9)))
    got = {(r.a, r.b): r.rho for r in cross_section.redundancy(df, ["x", "y", "z"], threshold=0.0, least=1).collect()}
    corr = pdf[["x", "y", "z"]].rank().corr()
    assert got == {(a, b): pytest.approx(corr.loc[a, b]) for a, b in (("x", "y"), ("x", "z"), ("y", "z"))}
    few = spark.createDataFrame([(1.0, 5.0, 4.0), (2.0, None, 1.0), (3.0, 1.0, None), (4.0, 2.0, 3.0), (5.0, 4.0, 2.0), (None, 3.0, 5.0)], "a double, b double, c double")
    fewp = pd.DataFrame([(1.0, 5.0, 4.0), (2.0, None, 1.0), (3.0, 1.0, None), (4.0, 2.0, 3.0), (5.0, 4.0, 2.0), (None, 3.0, 5.0)], columns=list("abc")).rank().corr()
    assert {(r.a, r.b): r.rho for r in cross_section.redundancy(few, ["a", "b", "c"], 0.0, 1).collect()} == {(a, b): pytest.approx(fewp.loc[a, b]) for a, b in (("a", "b"), ("a", "c"), ("b", "c"))}


def test_offset_summary_leaves_out_classes_without_deviation(spark):
    ic = spark.createDataFrame([(i, 0.1 if i % 3 == 0 else 0.01 * (i % 7) - 0.02) for i in range(30)], "m int, ic double")
    r = cross_section.offset_summary(ic, "m", 3).first()
    import pandas as pd

    s = pd.Series([0.1 if i % 3 == 0 else 0.01 * (i % 7) - 0.02 for i in range(30)])
    classes = [s[k::3] for k in (1, 2)]
    assert (r.classes, r.months) == (2, 30) and r.mean_ic == pytest.approx(sum(c.mean() for c in classes) / 2)
    assert r.positive_share == pytest.approx((s > 1e-12).mean()) and r.mean_t == pytest.approx(sum(c.mean() / (c.std() / len(c) ** 0.5) for c in classes) / 2)


def test_technical_panel_against_pandas(spark):
    """The folded features and the rest of one series with a hole, against rolling pandas."""
    import numpy as np
    import pandas as pd

    from tidemark.operators import features

    rng = np.random.default_rng(11)
    n, spans = 60, features.Spans(month=2, quarter=5, half=7, year=9, short=3, middle=5, long=8, slope=2, wilder=4)
    close = 50 * np.exp(np.cumsum(rng.normal(size=n) * 0.03))
    pdf = pd.DataFrame({"o": [i + (i >= 40) for i in range(n)], "high": close * 1.02, "low": close * 0.97, "close": close, "volume": rng.integers(1, 99, n).astype(float)})
    df = spark.createDataFrame([("k", D(2024, 1, 1) + dt.timedelta(int(r.o)), int(r.o), r.high, r.low, r.close, r.volume) for r in pdf.itertuples()], "k string, d date, ordinal int, high double, low double, close double, volume double")
    got = features.technical_panel(df, "k", "d", spans).toPandas().sort_values("d").reset_index(drop=True)
    c, v, r = pdf["close"], pdf["volume"], np.log(pdf["close"] / pdf["close"].shift())
    tr = pd.concat([pdf["high"] - pdf["low"], (pdf["high"] - c.shift()).abs(), (pdf["low"] - c.shift()).abs()], axis=1).max(axis=1)[1:]

    def wilder(x, k):
        out, state = [None] * (k - 1), x[:k].mean()
        out.append(state)
        for value in x[k:]:
            state = (state * (k - 1) + value) / k
            out.append(state)
        return [None, *out]

    atr = pd.Series(wilder(tr, 4), dtype=float)
    up, dn = (pd.Series(wilder((s * c.diff()[1:]).clip(lower=0), 4), dtype=float) for s in (1, -1))
    clean = lambda w: pdf["o"] - pdf["o"].shift(w) == w
    want = {
        "ema_distance_short": c / c.ewm(span=3, adjust=False, min_periods=3).mean() - 1, "atr_pct": atr / c, "atr_normalized": atr / atr.rolling(9).mean(), "rsi": 100 - 100 / (1 + up / dn),
        "ret_quarter": (c / c.shift(5) - 1).where(clean(5)), "skew": r.rolling(5).skew().where(clean(5)), "kurtosis": r.rolling(5).kurt().where(clean(5)), "slope_long": c.rolling(8).mean().pct_change(2),
        "volume_z_quarter": (v - v.rolling(5).mean()) / v.rolling(5).std(), "drawdown_year": (c / c.rolling(9).max() - 1).where(clean(9)), "vol_half": (r.rolling(7).std() * 252**0.5).where(clean(7)),
    }
    for k, x in want.items():
        assert np.allclose(got[k].astype(float), x.astype(float), equal_nan=True), k
    why = {(x.d, x.feature): x.reason for x in features.with_reasons(features.technical_panel(df, "k", "d", spans), "k", "d", spans).collect()}
    assert why[D(2024, 1, 1), "rsi"] == "NOT_ENOUGH_HISTORY" and why[D(2024, 1, 1) + dt.timedelta(41), "ret_quarter"] == "PROVIDER_GAP" and why[D(2024, 1, 1) + dt.timedelta(60), "rsi"] is None
