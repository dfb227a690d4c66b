"""Repeated rows, days without bars, null closes and other inputs that once gave wrong numbers without a word."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import actions, cross_section, features, gates, recursive, review, targets

D = dt.date
ACTION = "k string, action_id int, kind string, ex_date date, announced_at timestamp, ratio double, cash_amount double"
BAR = "k string, session_date date, close double"


def split(day, ratio, said=dt.datetime(2020, 1, 1), k="a"):
    return (k, 1, "SPLIT", day, said, ratio, None)


def cash(day, amount, said=dt.datetime(2020, 1, 1), k="a"):
    return (k, 2, "DIVIDEND", day, said, None, amount)


def days(*closes, k="a", step=1):
    return [(k, D(2024, 1, 1) + dt.timedelta(step * i), c) for i, c in enumerate(closes)]


def column(df, name):
    return [r[name] for r in df.orderBy("session_date").collect()]


def test_a_repeated_span_is_not_squared(spark):
    spans = spark.createDataFrame([("a", D(2024, 1, 1), D(2024, 1, 9))] * 3 + [("a", None, D(2024, 1, 9)), ("b", D(2024, 1, 1), D(2024, 1, 9))], "k string, s date, e date")
    got = actions.split_between(spark.createDataFrame([split(D(2024, 1, 5), 2.0)], ACTION), spans, "k", "s", "e")
    assert sorted(r.split_factor for r in got.collect()) == [1.0, 1.0, 2.0, 2.0, 2.0]


def test_actions_on_days_without_a_bar_move_to_the_next(spark):
    bars = spark.createDataFrame(days(10.0, 6.0, 6.6, step=3), BAR)
    acts = spark.createDataFrame([cash(D(2024, 1, 2), 1.0), split(D(2024, 1, 3), 2.0), split(D(2024, 2, 1), 3.0)], ACTION)
    assert column(actions.total_return(bars, acts, "k"), "gross") == [None, pytest.approx((2 * 6.0 + 1.0) / 10), pytest.approx(1.1)]  # cash of before the split is per old share
    assert column(actions.adjusted_closes(bars, acts, "k"), "adj_close") == [pytest.approx(10 / 2 * (1 - 1 / 10)), 6.0, 6.6]
    after = actions.adjusted_closes(bars, acts, "k", F.lit("2024-03-01").cast("timestamp"))  # the last split has come by then
    assert column(after, "adj_close") == [pytest.approx(10 / 2 * 0.9 / 3), 2.0, pytest.approx(2.2)]
    before = actions.adjusted_closes(bars, acts, "k", F.lit("2024-01-31").cast("timestamp"))
    assert column(before, "adj_close")[2] == 6.6


def test_null_closes_are_stepped_over(spark):
    bars = spark.createDataFrame(days(10.0, None, 11.0, 5.0), BAR)
    got = actions.total_return(bars, spark.createDataFrame([split(D(2024, 1, 4), 2.0)], ACTION), "k")
    assert column(got, "gross") == [None, None, pytest.approx(1.1), pytest.approx(10 / 11)] and column(got, "tr_level")[1:3] == [1.0, pytest.approx(1.1)]
    got = actions.total_return(bars, spark.createDataFrame([cash(D(2024, 1, 2), 1.0)], ACTION), "k")
    assert column(got, "gross")[2] == pytest.approx(1.2)
    assert column(actions.adjusted_closes(bars, spark.createDataFrame([split(D(2024, 1, 2), 2.0)], ACTION), "k"), "adj_close") == [5.0, None, 11.0, 5.0]
    assert actions.total_return(bars.limit(0), spark.createDataFrame([], ACTION), "k").count() == 0


def test_returns_around_an_action_on_a_session(spark):
    """Price falls by the dividend: nothing gained; splits are continuous; what is announced later is not known."""
    bars = spark.createDataFrame(days(100.0, 100.0, 99.0, 99.0) + days(100.0, 102.0, 51.0, 52.0, k="b") + days(1.0, 1.1, 11.0, k="c"), BAR)
    acts = spark.createDataFrame([cash(D(2024, 1, 3), 1.0), split(D(2024, 1, 3), 2.0, k="b"), split(D(2024, 1, 3), 0.1, k="c")], ACTION)
    last = {r.k: r.tr_level for r in actions.total_return(bars, acts, "k").orderBy("session_date").collect()}
    assert last == {"a": pytest.approx(1.0), "b": pytest.approx(1.04), "c": pytest.approx(1.1)}
    late = spark.createDataFrame([split(D(2024, 1, 3), 2.0, dt.datetime(2024, 1, 4, 12), k="b")], ACTION)
    for at, first in (("2024-01-03 22:00", 100.0), ("2024-01-05 22:00", 50.0)):
        assert column(actions.adjusted_closes(bars.filter("k = 'b'"), late, "k", F.lit(at).cast("timestamp")), "adj_close")[0] == first


def test_one_null_close_does_not_void_the_panel(spark):
    rows = [("a", D(2024, 1, 1) + dt.timedelta(i), i, 12.0 + i % 5, 8.0 + i % 3, 10.0 + i % 4, 100.0 + i) for i in range(30)]
    whole = spark.createDataFrame(rows, "k string, d date, ordinal int, high double, low double, close double, volume double").withColumn("level", F.col("close"))
    hole = whole.withColumn("close", F.when(F.col("ordinal") != 12, F.col("close")))
    spans = features.Spans(month=2, quarter=5, half=7, year=9, short=3, middle=5, long=8, slope=2, wilder=3)
    made = ("ema_short", "ema_middle", "atr", "rsi")
    got = {r.d: tuple(r[c] for c in made) for r in features.folded(hole, "k", "d", spans).collect()}
    want = {r.d: tuple(r[c] for c in made) for r in features.folded(whole.filter("ordinal <> 12"), "k", "d", spans).collect()}
    assert got.pop(D(2024, 1, 13)) == (None,) * 4 and got == want and got[D(2024, 1, 30)][0] is not None
    none = whole.withColumn("close", F.lit(None).cast("double"))
    assert features.folded(none, "k", "d", spans).filter("ema_short is null and rsi is null").count() == 30


def test_repeated_points_stay(spark):
    names = spark.createDataFrame([("X", D(2020, 1, 1), None, 7)], "n string, s date, e date, t int")
    points = spark.createDataFrame([("X", D(2021, 1, 1))] * 2 + [("Y", D(2021, 1, 1)), (None, D(2021, 1, 1)), ("X", None)], "n string, at date")
    got = sorted(((r.n or "", r.t, r.status) for r in targets.resolve_at(points, names, "n", "at", "s", "e", "t").collect()), key=str)
    assert got == sorted([("X", 7, "EXACT")] * 2 + [("", None, "UNKNOWN"), ("X", None, "UNKNOWN"), ("Y", None, "UNKNOWN")], key=str)


def test_the_worst_row_of_a_dimension_counts(spark):
    rows = [("a", "prices", "COMPLETE"), ("a", "identity", "COMPLETE"), ("a", "sector", "COMPLETE"), ("b", "prices", "COMPLETE"), ("b", "prices", "missing"), ("b", "prices", "PARTIAL"), ("b", "identity", "COMPLETE"), ("b", "sector", "COMPLETE")]
    got = {r.k: (r.status, r.reasons) for r in gates.support_decision(spark.createDataFrame(rows, "k string, dimension string, status string"), "k", ["prices"], ["sector"]).collect()}
    assert got == {"a": ("SUPPORTED", ""), "b": ("NOT_SUPPORTED", "prices: missing")}


def test_odds_need_a_flag_that_varies(spark):
    df = spark.createDataFrame([("a", 1, i % 2) for i in range(80)] + [("b", i % 2, i % 4 // 2) for i in range(80)], "g string, f int, y int")
    got = {r.g: r for r in cross_section.odds_ratio(df, ["g"], "f", "y").collect()}
    assert got["a"].n == 80 and got["a"].odds_ratio is None and got["a"].rate_flag is None
    assert got["b"].odds_ratio == pytest.approx(1.0) and got["b"].rate_flag == got["b"].rate_no_flag == 0.5


def test_a_snapshot_hash_covers_every_digit(spark):
    df = spark.createDataFrame([("a", "f", 1.0, 1), ("b", "f", 1.0000001, 1), ("c", "f", 1.0, 1)], "k string, n string, v double, t int")
    got = {r.k: r.snapshot_hash for r in targets.freeze(df, ["k"], "n", "v", "t").collect()}
    assert got["a"] == got["c"] != got["b"]


def test_class_sets_are_of_one_statement(spark):
    legs = [("c", "ADD", D(2020, 1, 1), 1, ["B", "A"]), ("c", "ADD", D(2020, 1, 1), 2, ["A", "B"]), ("c", "REMOVE", D(2020, 1, 1), 3, ["A", "B"]), ("c", "ADD", D(2020, 2, 1), 4, ["A", "B"]), ("c", "ADD", None, 5, ["Z"]), ("c", "ADD", D(2020, 1, 1), 6, [])]
    got = review.class_sets(spark.createDataFrame(legs, "clause string, kind string, lo date, ticker int, pool array<string>"), ["clause", "kind", "lo"], "ticker", "pool")
    assert sorted((r.kind, r.ticker, r.security) for r in got.collect()) == [("ADD", 1, "A"), ("ADD", 2, "B"), ("ADD", 5, "Z")]


def test_ids_of_any_type_are_matched(spark):
    left = spark.createDataFrame([("g", "x1", D(2020, 1, 1))], "g string, l string, d date")
    right = spark.createDataFrame([("g", "y1", D(2020, 1, 3))], "g string, r string, e date")
    assert [tuple(r) for r in review.match_one_to_one(left, right, "g", "l", "r", "d", "e", 5).collect()] == [("g", "x1", "y1", 2)]


@pytest.mark.parametrize("n", [1, 2, 256, 257, 258, 1500])
def test_scans_in_blocks_are_plain_folds(spark, n):
    values = [float((i * 7919) % 101) for i in range(n)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, t int, v double")
    want = [values[0]]
    for v in values[1:]:
        want.append(want[-1] * (1 - 2 / 11) + v * (2 / 11))
    got = [r.ema for r in recursive.ema(df, "k", "t", "v", 10, masked=False).orderBy("t").collect()]
    assert got == want
