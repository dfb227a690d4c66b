"""Results that lie at a tie of decimal digits, where the last bit of a double decides, round as those of the SQL twin do."""

import math
import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import recursive, windows


def test_slopes_equal_those_of_sql_bit_for_bit(spark):
    rng, rows = random.Random(4), []
    for k in range(300):
        day = 19700
        for _ in range(20):
            day += rng.choice((1, 1, 1, 2, 3))
            rows.append((k, day, rng.choice((round(rng.expovariate(0.02), 2), 0.0, 100.25))))
    df = spark.createDataFrame(rows, "k int, day int, close double")
    slope = windows.slope(F.col("close"), Window.partitionBy("k").orderBy("day"), 5, F.col("day"))
    got = {(r.k, r.day): r.x for r in df.select("k", "day", slope.alias("x")).collect()}
    c = duckdb.connect()
    c.register("bars", df.toPandas())
    want = c.execute("select k, day, case when count(close) over w = 5 then regr_slope(close, day) over w end from bars window w as (partition by k order by day rows 4 preceding)").fetchall()
    assert got == {(k, day): x for k, day, x in want}


def test_slope_of_infinite_missing_and_huge_values(spark):
    rows = [(1, 1.0), (2, None), (3, 3.0), (4, 4.0), (5, float("inf")), (6, 6.0), (7, 7.0), (8, 8.0), (9, 1e301), (10, 2e301)]
    got = [r.x for r in spark.createDataFrame(rows, "day int, x double").select(windows.slope(F.col("x"), Window.orderBy("day"), 2, F.col("day")).alias("x")).collect()]
    assert got[:4] == [None, None, None, 1.0] and all(x != x for x in got[4:6]) and got[6:8] == [1.0, 1.0] and got[8:] == [pytest.approx(1e301)] * 2


def test_ranges_equal_the_weighted_sums_of_sql(spark):
    """Each state is the sum of all values times their weights, in order of time; from SUMMED on, the fold goes on from there."""
    rng, n = random.Random(5), 3
    values = [[round(rng.expovariate(2), 2) for _ in range(size)] for size in (0, 2, 3, 4, 40, 66, 67, 300)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v array<double>").select("k", F.expr(recursive.wilder_of("v", n)).alias("m"))
    for k, got in df.collect():
        want = [None] * min(n - 1, len(values[k]))
        for i in range(n, len(values[k]) + 1):
            if i < n + recursive.SUMMED:
                total = 0.0
                for j, x in enumerate(values[k][:i], 1):
                    total += x * (math.pow((n - 1) / n, i - max(j, n)) / n)
                want.append(total)
            else:
                want.append((want[-1] * (n - 1) + values[k][i - 1]) / n)
        assert got == want


def test_rounding_keeps_the_sign_of_zero_as_sql_does(spark):
    values = [-1e-9, 1e-9, -0.0, 0.0, -0.00005, -0.000049, None, float("nan"), float("-inf"), 2.5]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded("v", 4).alias("x")).collect()]
    want = [duckdb.execute("select round(?::double, 4)", [v]).fetchone()[0] for v in values]
    assert list(map(str, got)) == list(map(str, want)) and str(got[0]) == "-0.0"
