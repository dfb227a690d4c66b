"""Prices of zero: queries equal their SQL, which divides as doubles do, and trades entered at zero have no return."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Events of thirty users, of whose values a seventh is zero; the first decision's closes of users 2 and 3 are zero."""
    folder, rng = str(tmp_path_factory.mktemp("zeros")), random.Random(8)
    rows = []
    for i in range(1800):
        ts = datetime(2024, 1, 1) + timedelta(minutes=24 * i, seconds=1)
        value = 0.0 if rng.random() < 0.14 else round(rng.expovariate(0.02), 2)
        rows.append((i, ts, rng.randrange(1, 31), rng.choice(["view", "click", "error", "signup", "purchase"]), value, "{}"))
    rows += [(5000 + u, datetime(2024, 1, 4, 23, 59, 30), u, "view", 0.0, "{}") for u in (2, 3)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def text(v):
    if isinstance(v, float):
        return str(v) if math.isnan(v) or math.isinf(v) else f"{v:.9g}" if v else "0"
    return str(v)


def both(spark, world, name):
    df = QUERIES[name](spark, world)
    got = sorted(tuple(map(text, r)) for r in df.select(*sorted(df.columns)).collect())
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{world}/events.parquet/*.parquet'")
    result = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    return got, sorted(tuple(text(r[names.index(n)]) for n in sorted(names)) for r in result.fetchall())


@pytest.mark.parametrize("name", ["horizon_targets", "benchmark_excess", "insights", "compound_momentum", "daily_features", "feature_snapshots", "research_dataset", "exact_horizon_returns", "rolling_vol", "zones_as_of", "total_return"])
def test_query_equals_its_sql_with_zeros(spark, world, name):
    got, want = both(spark, world, name)
    assert got == want


@pytest.mark.parametrize("name", ["state_machine_replay", "plan_counterfactual"])
def test_a_trade_entered_at_zero_has_no_return(spark, world, name):
    rows = QUERIES[name](spark, world).collect()
    entered = [r.user_id for r in QUERIES["state_machine_replay"](spark, world).filter("entry = 0").collect()]
    assert entered and all(r.ret is None for r in rows if r.user_id in entered)
    assert any(r.ret is not None for r in rows)


def test_metrics_of_a_trade_entered_at_zero(spark, world):
    rows = QUERIES["trade_metrics"](spark, world).collect()
    free = [r for r in rows if r.entry == 0]
    assert free and all((r.ret, r.mfe, r.mae) == (None, None, None) for r in free) and all(r.mfe is not None for r in rows if r.entry)


def test_rounding_parts_at_ties_as_sql_does(spark):
    """Midpoint over close, less 1, at what would be ties of the fifth digit if doubles were decimals."""
    pairs = [(round(m * 0.005, 3), c) for m in range(1, 30000, 7) for c in (0.64, 1.6, 32.0, 8.0, 12.8)]
    df = spark.createDataFrame(pairs, "m double, c double")
    got = [r.x for r in df.select(rounded(F.col("m") / F.col("c") - 1, 5).alias("x")).collect()]
    c = duckdb.connect()
    c.register("pairs", df.toPandas())
    want = [x for (x,) in c.execute("select round(m / c - 1, 5) from pairs").fetchall()]
    assert sorted(got) == sorted(want)
    assert got != [r.x for r in df.select(F.round(F.col("m") / F.col("c") - 1, 5).alias("x")).collect()]
