"""Vendor payloads to columns: quotes, bars, splits and rates as they are sent, in JSON, by Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHART = "chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>>>>>"


def split_ratio(text: Column) -> Column:
    """new / old of 'new/old'; NULL where it is not two positive numbers."""
    parts = F.split(text, "/")
    new, old = (F.get(parts, i).try_cast("double") for i in (0, 1))
    return F.when((F.size(parts) == 2) & (new > 0) & (old > 0), new / old)


def without_adjustment(rows: DataFrame) -> DataFrame:
    """rows (open, high, low, close, volume adjusted for splits, close_raw) as they were traded, with imputed where the vendor's factor is not 1.

    Rows without a positive close or without the raw close are left out.
    """
    k = F.col("close_raw") / F.col("close")
    good = rows.filter((F.col("close") > 0) & F.col("close_raw").isNotNull())
    raw = good.withColumns({c: F.col(c) * k for c in ("open", "high", "low")} | {"volume": F.col("volume") / k, "imputed": F.abs(k - 1) > 1e-12})
    return raw.withColumn("close", F.col("close_raw")).drop("close_raw")


def chart_rows(json: Column, utc_offset: Column) -> Column:
    """The daily rows of a chart document: array<struct<day, open, high, low, close, volume>>, without those that have no positive close."""
    r = F.get(F.from_json(json, _CHART)["chart"]["result"], 0)
    q = F.get(r["indicators"]["quote"], 0)

    def row(ts: Column, i: Column) -> Column:
        return F.struct(F.to_date(F.timestamp_seconds(ts + utc_offset)).alias("day"), *[F.get(q[c], i).alias(c) for c in ("open", "high", "low", "close", "volume")])

    return F.filter(F.transform(r["timestamp"], row), lambda x: x["close"] > 0)


def rates(json: Column, inverted: Column) -> Column:
    """The daily dollars per unit of a chart document: array<struct<day, rate>>; inverted quotes are units per dollar."""
    return F.transform(chart_rows(json, F.lit(0)), lambda x: F.struct(x["day"].alias("day"), F.when(inverted, 1 / x["close"]).otherwise(x["close"]).alias("rate")))


def closed_and_forming(klines: Column, now_ms: Column) -> tuple[Column, Column]:
    """The last closed bar and the forming one of an array<array<string>> of exchange bars (open time, o, h, l, c, volume, close time, ...)."""
    bars = F.transform(klines, lambda k: F.struct(
        k[6].cast("bigint").alias("close_time"), k[0].cast("bigint").alias("open_time"), *[k[i].cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)]
    ))
    closed = F.filter(bars, lambda b: b["close_time"] <= now_ms)
    forming = F.filter(bars, lambda b: (b["close_time"] > now_ms) & (b["open_time"] <= now_ms))
    return F.array_max(closed), F.try_element_at(forming, F.lit(-1))


def day_ticker(json: Column) -> Column:
    """The rolling 24 hours of a ticker document, which is no daily bar."""
    raw = F.from_json(json, "priceChange string, priceChangePercent string, highPrice string, lowPrice string, volume string, quoteVolume string, openTime bigint, closeTime bigint")
    numbers = {"change": "priceChange", "change_pct": "priceChangePercent", "high": "highPrice", "low": "lowPrice", "volume": "volume", "quote_volume": "quoteVolume"}
    times = {"open_time": "openTime", "close_time": "closeTime"}
    return F.struct(*[raw[v].cast("double").alias(k) for k, v in numbers.items()], *[F.timestamp_millis(raw[v]).alias(k) for k, v in times.items()], F.lit("ROLLING_24H").alias("window"))


def exchange_suffix(symbol: Column) -> Column:
    """What follows the last dot of a symbol, in upper case; an index symbol is its own suffix, a plain one has none."""
    return F.when(F.startswith(symbol, F.lit("^")), F.upper(symbol)).when(F.contains(symbol, F.lit(".")), F.upper(F.substring_index(symbol, ".", -1))).otherwise("")


def close_ratio_report(ours: DataFrame, theirs: DataFrame, key: str, day: str, tolerance: float = 0.005) -> DataFrame:
    """(key, days, agree, worst): how far a vendor's adjusted closes, scaled to our last common close, follow ours."""
    both = ours.select(key, day, F.col("close").alias("a")).join(theirs.select(key, day, F.col("adj_close").alias("b")), [key, day]).filter((F.col("a") > 0) & (F.col("b") > 0))
    last = both.groupBy(key).agg(F.max_by(F.col("a") / F.col("b"), day).alias("__k"))
    gap = F.abs(F.col("b") * F.col("__k") / F.col("a") - 1)
    return both.join(last, key).groupBy(key).agg(F.count("*").alias("days"), F.count_if(gap <= tolerance).alias("agree"), F.max(gap).alias("worst"))
