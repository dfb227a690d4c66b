"""Recursive indicators: each value needs the one before, so that a key's series is folded in order.

A series is gathered per key into an array and folded in blocks by Spark's ``aggregate``; nothing leaves the
JVM. A key's bars are one row: a century of daily bars is 26,000. Nulls inside a series are skipped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _series(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    row = F.struct(F.col(order).alias("t"), *fields)
    return df.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("__s"))


#: Bars of a block: an array is copied once for each of its values, so that only blocks are built so.
BLOCK = 256


def _let(name: str, value: str, body: str) -> str:
    """body, in which name stands for value, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scan(array: str, init: str, step: str) -> str:
    """Every state of a fold over an array, as an array, init first.

    The states at the blocks' starts come from folds without an array; then each block is folded from its
    own. The steps are the same as those of one fold, and the work grows as the values times the block.
    """
    def one(previous: str) -> str:
        return step.replace("PREV", previous)

    part = f"slice(a, b * {BLOCK} + 1, {BLOCK})"
    blocks = f"sequence(0, cast(ceil(size(a) / {BLOCK}) as int) - 1)"
    starts = f"aggregate({blocks}, array({init}), (cs, b) -> concat(cs, array(aggregate({part}, element_at(cs, -1), (p, x) -> {one('p')}))))"
    each = f"slice(aggregate({part}, array(cs[b]), (acc, x) -> concat(acc, array({one('element_at(acc, -1)')}))), 2, {BLOCK})"
    whole = _let("cs", starts, f"concat(array(cs[0]), flatten(transform({blocks}, b -> {each})))")
    return _let("a", array, f"if(size(a) = 0, array({init}), {whole})")


def ema_of(array: str, n: int) -> str:
    """Exponential mean of an array of doubles, seeded with its first value."""
    a = 2.0 / (n + 1)
    return _scan(f"slice({array}, 2, greatest(size({array}) - 1, 0))", f"get({array}, 0)", f"PREV * {1 - a!r}D + x * {a!r}D")


#: States of Wilder's mean that are weighted sums of all values so far.
SUMMED = 64


def wilder_of(array: str, n: int) -> str:
    """Wilder's mean: the plain mean of the first n values, then (previous * (n - 1) + x) / n; nulls before.

    The first SUMMED states are the weighted sums that this amounts to, added up in order of time as in SQL: what is
    made of few values often lies at a tie of decimal digits, where the last bit decides. Those after are folded.
    """
    weights = f"array({', '.join(f'{math.pow((n - 1) / n, k) / n!r}D' for k in range(SUMMED))})"
    of_each = f"concat(array_repeat(wt[i - {n}], {n}), reverse(slice(wt, 1, i - {n})))"
    sums = f"transform(sequence({n}, least(size({array}), {n + SUMMED - 1})), i -> aggregate(zip_with(slice({array}, 1, i), {of_each}, (x, f) -> x * f), 0D, (s, v) -> s + v))"
    rest = _scan(f"slice({array}, {n + SUMMED}, greatest(size({array}) - {n + SUMMED - 1}, 0))", "element_at(h, -1)", f"(PREV * {n - 1} + x) / {n}")
    whole = _let("wt", weights, _let("h", sums, f"concat(array_repeat(cast(null as double), {n - 1}), slice(h, 1, size(h) - 1), {rest})"))
    return f"if(size({array}) < {n}, transform({array}, x -> cast(null as double)), {whole})"


def _out(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    zipped = F.explode(F.arrays_zip("__t", *columns))
    flat = df.withColumn("__t", F.expr("transform(__s, s -> s.t)")).select(key, zipped.alias("z"))
    return flat.select(key, F.col("z.__t").alias(order), *[F.col(f"z.{c}").alias(c) for c in columns])


def _arrays(df: DataFrame, arrays: dict[str, str]) -> DataFrame:
    for name, sql in arrays.items():
        df = df.withColumn(name, F.expr(sql))
    return df


def ema(df: DataFrame, key: str, order: str, value: str, n: int, masked: bool = True) -> DataFrame:
    """(key, order, ema); the first n - 1 are null if masked."""
    s = _series(df.filter(F.col(value).isNotNull()), key, order, [F.col(value).cast("double").alias("v")])
    s = _arrays(s, {"__v": "transform(__s, s -> s.v)", "__e": ema_of("__v", n)})
    cut = f"transform(__e, (x, i) -> if(i >= {n - 1}, x, null))" if masked else "__e"
    return _out(_arrays(s, {"ema": cut}), key, order, ["ema"])


def rsi(df: DataFrame, key: str, order: str, close: str, n: int = 14) -> DataFrame:
    s = _series(df.filter(F.col(close).isNotNull()), key, order, [F.col(close).cast("double").alias("v")])
    s = _arrays(s, {
        "__d": "transform(slice(__s, 2, greatest(size(__s) - 1, 0)), (s, i) -> s.v - __s[i].v)",
        "__up": "transform(__d, d -> greatest(d, 0D))", "__dn": "transform(__d, d -> greatest(-d, 0D))",
        "__au": wilder_of("__up", n), "__ad": wilder_of("__dn", n),
        "rsi": "concat(array(cast(null as double)), zip_with(__au, __ad, (u, d) -> if(d = 0, 100D, 100 - 100 / (1 + u / d))))",
    })
    return _out(s, key, order, ["rsi"])


def macd(df: DataFrame, key: str, order: str, close: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(key, order, macd, signal, hist): the signal starts at the first value of the line, the slow mean's n-th bar."""
    s = _series(df.filter(F.col(close).isNotNull()), key, order, [F.col(close).cast("double").alias("v")])
    pad = f"array_repeat(cast(null as double), least({slow - 1}, size(__v)))"
    s = _arrays(s, {
        "__v": "transform(__s, s -> s.v)", "__f": ema_of("__v", fast), "__l": ema_of("__v", slow),
        "__m": f"slice(zip_with(__f, __l, (a, b) -> a - b), {slow}, greatest(size(__v) - {slow - 1}, 0))",
        "__g": f"if(size(__m) = 0, cast(array() as array<double>), {ema_of('__m', signal)})",
        "macd": f"concat({pad}, __m)", "signal": f"concat({pad}, transform(__g, (x, i) -> if(i >= {signal - 1}, x, null)))",
        "hist": "zip_with(macd, signal, (a, b) -> a - b)",
    })
    return _out(s, key, order, ["macd", "signal", "hist"])


_RANGE = "greatest(s.h - s.l, abs(s.h - __s[i].c), abs(s.l - __s[i].c))"


def _hlc(df: DataFrame, key: str, order: str) -> DataFrame:
    whole = df.filter("high is not null and low is not null and close is not null")
    return _series(whole, key, order, [F.col(a).cast("double").alias(b) for a, b in (("high", "h"), ("low", "l"), ("close", "c"))])


def atr(df: DataFrame, key: str, order: str, n: int = 14) -> DataFrame:
    """Wilder's mean of the true range, which begins with the second bar."""
    s = _arrays(_hlc(df, key, order), {
        "__tr": f"transform(slice(__s, 2, greatest(size(__s) - 1, 0)), (s, i) -> {_RANGE})",
        "atr": f"concat(array(cast(null as double)), {wilder_of('__tr', n)})",
    })
    return _out(s, key, order, ["atr"])


def adx(df: DataFrame, key: str, order: str, n: int = 14) -> DataFrame:
    """(key, order, plus_di, minus_di, adx)."""
    tail = "slice(__s, 2, greatest(size(__s) - 1, 0))"
    up, dn = "(s.h - __s[i].h)", "(__s[i].l - s.l)"
    s = _arrays(_hlc(df, key, order), {
        "__tr": f"transform({tail}, (s, i) -> {_RANGE})",
        "__pd": f"transform({tail}, (s, i) -> if({up} > {dn} and {up} > 0, {up}, 0D))",
        "__md": f"transform({tail}, (s, i) -> if({dn} > {up} and {dn} > 0, {dn}, 0D))",
        "__at": wilder_of("__tr", n), "__ap": wilder_of("__pd", n), "__am": wilder_of("__md", n),
        "__p": "zip_with(__ap, __at, (p, t) -> try_divide(100 * p, t))", "__n": "zip_with(__am, __at, (p, t) -> try_divide(100 * p, t))",
        "__dx": f"slice(zip_with(__p, __n, (p, m) -> if(p + m = 0, 0D, 100 * abs(p - m) / (p + m))), {n}, greatest(size(__p) - {n - 1}, 0))",
        "__ax": f"if(size(__dx) = 0, cast(array() as array<double>), {wilder_of('__dx', n)})",
        "plus_di": "concat(array(cast(null as double)), __p)", "minus_di": "concat(array(cast(null as double)), __n)",
        "adx": f"concat(array_repeat(cast(null as double), least({n}, size(__s))), __ax)",
    })
    return _out(s, key, order, ["plus_di", "minus_di", "adx"])


def price_zones(df: DataFrame, key: str, price: str, width: str) -> DataFrame:
    """Greedy clusters of prices in order: a price joins the cluster whose running mean is within width, else opens one.

    (key, level, touches); width is one number per key.
    """
    s = df.groupBy(key).agg(F.sort_array(F.collect_list(F.col(price).cast("double"))).alias("__p"), F.max(width).cast("double").alias("__w"))
    fold = """aggregate(__p, cast(array() as array<struct<level:double,touches:int>>), (acc, x) ->
        if(size(acc) > 0 and abs(x - element_at(acc, -1).level) <= __w,
           concat(slice(acc, 1, size(acc) - 1), array(struct(
               (element_at(acc, -1).level * element_at(acc, -1).touches + x) / (element_at(acc, -1).touches + 1) as level, element_at(acc, -1).touches + 1 as touches))),
           concat(acc, array(struct(x as level, 1 as touches)))))"""
    return s.select(key, F.explode(F.expr(fold)).alias("z")).select(key, "z.*")
