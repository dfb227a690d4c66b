"""Events of one user at one instant: bars, and what is made of them, equal their SQL, which takes the first."""

import random
from datetime import datetime, timedelta

import pytest

from tests.test_zero_prices import both


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Events of twenty users; every third is at the instant of the one before, of the same user."""
    folder, rng, rows = str(tmp_path_factory.mktemp("instants")), random.Random(9), []
    for i in range(1500):
        ts, user = datetime(2024, 1, 1) + timedelta(minutes=28 * i, seconds=1), rng.randrange(1, 21)
        if i % 3 == 1:
            ts, user = rows[-1][1], rows[-1][2]
        rows.append((i, ts, user, rng.choice(["view", "click", "error", "signup", "purchase"]), round(rng.expovariate(0.02) + 1, 2), "{}"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["daily_bars", "daily_features", "total_return"])
def test_query_equals_its_sql(spark, world, name):
    got, want = both(spark, world, name)
    assert got == want
