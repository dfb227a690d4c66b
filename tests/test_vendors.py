"""Vendor payloads as columns, and trailing years with holes."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import valuation
from tidemark.sources import vendors


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_chart_documents_and_rates(spark):
    q = {"open": [1.0, None, 3.0], "high": [2.0, None, 4.0], "low": [0.5, None, 2.5], "close": [1.5, None, 0.0], "volume": [10.0, None, 1.0]}
    doc = json.dumps({"chart": {"result": [{"timestamp": [86_400, 172_800, 259_200], "indicators": {"quote": [q]}}]}})
    df = one(spark, j=doc, bad="{", none="")
    r = df.select(vendors.chart_rows(F.col("j"), F.lit(-1)).alias("a"), vendors.rates(F.col("j"), F.lit(True)).alias("b"), vendors.chart_rows(F.col("bad"), F.lit(0)).alias("c")).first()
    assert [tuple(x) for x in r.a] == [(dt.date(1970, 1, 1), 1.0, 2.0, 0.5, 1.5, 10.0)]
    assert [(x.day, x.rate) for x in r.b] == [(dt.date(1970, 1, 2), pytest.approx(1 / 1.5))] and not r.c


def test_klines_and_tickers(spark):
    klines = [["0", "1", "2", "0.5", "1.5", "9", "99"], ["100", "2", "3", "1", "2.5", "8", "199"], ["200", "3", "3", "3", "3", "1", "299"]]
    closed, forming = vendors.closed_and_forming(F.col("k"), F.lit(250))
    r = one(spark, k=klines).select(closed.alias("c"), forming.alias("f")).first()
    assert (r.c.open_time, r.c.close, r.f.open_time) == (100, 2.5, 200)
    early = one(spark, k=klines[:1]).select(*[x.alias(n) for x, n in zip(vendors.closed_and_forming(F.col("k"), F.lit(5)), "cf")]).first()
    assert early.c is None and early.f.open_time == 0
    t = one(spark, j=json.dumps({"priceChange": "-1.5", "priceChangePercent": "-2", "highPrice": "9", "lowPrice": "8", "volume": "3", "quoteVolume": "27", "openTime": 0, "closeTime": 1000})).select(vendors.day_ticker(F.col("j")).alias("t")).first().t
    assert (t.change, t.quote_volume, t.window) == (-1.5, 27.0, "ROLLING_24H") and (t.close_time - t.open_time).total_seconds() == 1


def test_splits_suffixes_and_adjustments(spark):
    df = spark.createDataFrame([("3/2",), ("1/10",), ("x/2",), ("2",), ("0/1",), (None,), ("1/2/3",)], "s string")
    assert [r[0] for r in df.select(vendors.split_ratio(F.col("s"))).collect()] == [1.5, 0.1, None, None, None, None, None]
    names = spark.createDataFrame([("ENG.MC",), ("A.B.to",), ("^ibex",), ("AAPL",), (None,)], "s string")
    assert [r[0] for r in names.select(vendors.exchange_suffix(F.col("s"))).collect()][:4] == ["MC", "TO", "^IBEX", ""]
    ours = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 11.0), ("a", 3, 12.0)], "k string, d int, close double")
    theirs = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.5), ("a", 3, 6.0), ("b", 1, 1.0)], "k string, d int, adj_close double")
    assert [tuple(r) for r in vendors.close_ratio_report(ours, theirs, "k", "d").collect()] == [("a", 3, 3, 0.0)]


def test_trailing_years_need_four_quarters_in_a_row(spark):
    days = [dt.date(2020 + i // 4, 3 * (i % 4) + 1, 1) for i in range(10) if i != 6]
    rows = [("k", d, float(i + 1)) for i, d in enumerate(days)]
    t = valuation.trailing(spark.createDataFrame(rows, "k string, p date, revenue double"), ["k"], "p", ["revenue"])
    got = {r.p: r.revenue_ttm for r in t.collect()}
    assert got[days[3]] == 10.0 and got[days[5]] == 18.0 and got[days[6]] is None and got[days[8]] is None


def test_debt_and_stale_shares(spark):
    df = spark.createDataFrame([(5.0, 1.0, 2.0), (None, 1.0, 2.0), (None, None, 2.0)], "w double, n double, c double")
    assert [r[0] for r in df.select(valuation.total_debt(F.col("w"), F.col("n"), F.col("c"))).collect()] == [5.0, 3.0, None]
    cols = "price double, price_date date, shares double, shares_date date, split_factor double, debt double, cash double, equity double, " + ", ".join(f"{k}_ttm double" for k in ("net_income", "revenue", "fcf", "operating_income"))
    day = dt.date(2024, 1, 1)
    rows = [(10.0, day, 5.0, day, 2.0, 20.0, 10.0, 50.0, 4.0, 50.0, 5.0, -1.0), (10.0, day, 5.0, dt.date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (10.0, day, None, None, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    a, b, c = valuation.multiples(spark.createDataFrame(rows, cols)).collect()
    assert (a.market_cap, a.pe, a.price_to_book, a.ev, a.ev_to_operating_income, a.reason) == (100.0, 25.0, 2.0, 110.0, None, None)
    assert (b.market_cap, b.reason, c.reason) == (None, "stale_data", "missing_fundamental")
