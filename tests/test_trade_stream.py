"""Bars in random batches give the log of the batch fold, over restarts and repeated batches."""

import datetime as dt
import random

import pytest

from tidemark.operators import machine as M
from tidemark.streaming import trades as T

D0 = dt.date(2024, 1, 1)
PLAN = "k int, entry_type string, entry_low double, entry_high double, stop double, target_1 double, target_2 double, target_3 double, invalidation double, expiration date, exit_policy string, fraction_1 double, fraction_2 double, fraction_3 double, decided date, cancel_on date, manual_on date, manual_price double"
BAR = "k int, session_date date, open double, high double, low double, close double"


def world(seed, trades=40, days=30):
    rng, plans, bars = random.Random(seed), [], []
    for k in range(trades):
        kind = rng.choice(["LIMIT", "ENTRY_ZONE", "STOP_BUY", "MARKET", "MARKET_REFERENCE", None])
        low = 100.0 if kind == "MARKET_REFERENCE" else rng.uniform(96, 100)
        policy = rng.choice(["TRACK_TARGETS_ONLY", "PARTIAL_FRACTIONS", None])
        fractions = (0.3, 0.3, 0.4) if policy == "PARTIAL_FRACTIONS" else (None,) * 3
        at = lambda p: D0 + dt.timedelta(rng.randrange(5, days)) if rng.random() < p else None
        plans.append((k, kind, low, 100.0, 90.0 if k % 13 else 99.9, 104.0, 108.0, 112.0, rng.choice([None, 88.0]), at(0.3), policy, *fractions, D0, at(0.1), at(0.1), 101.0))
        price = 100.0
        for i in range(days):
            o = price + rng.gauss(0, 1)
            c = o + rng.gauss(0, 2.5)
            bars.append((k, D0 + dt.timedelta(i + 1), o, max(o, c) + rng.random(), min(o, c) - rng.random(), c))
            price = c
    return plans, bars


def told(df):
    return sorted((r.k, r.sequence_number, r.session_date, r.event, r.price, r.fraction, r.state) for r in df.collect())


@pytest.mark.parametrize("seed", [2])
def test_random_batches_give_the_batch_log(spark, tmp_path, seed):
    rows, bars = world(seed)
    plans = spark.createDataFrame(rows, PLAN)
    whole = told(M.simulate(spark.createDataFrame(bars, BAR).join(plans, "k"), "k"))
    assert len({r[6] for r in whole}) >= 5
    source, folder, check = (str(tmp_path / n) for n in ("source", "states", "check"))
    rng, cuts = random.Random(seed), {}
    for k, day, *_ in bars:  # each trade's days are cut at places of its own
        cuts.setdefault(k, sorted(rng.sample(range(2, 30), 2)))
    part = lambda b: sum((b[1] - D0).days > c for c in cuts[b[0]])

    def run():
        stream = spark.readStream.schema(BAR).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(T.carry_on(plans, folder, "k")).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    for n in range(3):  # the stream ends and starts again between the parts
        spark.createDataFrame([b for b in bars if part(b) == n], BAR).coalesce(1).write.mode("append").parquet(source)
        run()
        so_far = [b for b in bars if part(b) <= n]
        if n == 1:
            assert told(T.current_log(spark, plans, folder, "k")) == told(M.simulate(spark.createDataFrame(so_far, BAR).join(plans, "k"), "k"))
    assert told(T.current_log(spark, plans, folder, "k")) == whole
    T.carry_on(plans, folder, "k")(spark.createDataFrame([b for b in bars if part(b) == 2], BAR), 2)  # the last batch once more
    assert told(T.current_log(spark, plans, folder, "k")) == whole


def test_a_late_bar_is_refused_and_trades_without_bars_wait(spark, tmp_path):
    rows, bars = world(3, trades=4, days=6)
    plans, folder = spark.createDataFrame(rows, PLAN), str(tmp_path / "states")
    assert told(T.current_log(spark, plans, folder, "k")) == told(M.log_of(M.advance(plans, None, spark.createDataFrame([], BAR), "k"), plans, "k"))
    fold = T.carry_on(plans, folder, "k")
    fold(spark.createDataFrame([b for b in bars if b[0] != 1 and b[1] <= D0 + dt.timedelta(3)], BAR), 0)
    with pytest.raises(Exception, match="folded through"):
        fold(spark.createDataFrame([b for b in bars if b[1] == D0 + dt.timedelta(3)], BAR), 1)
    fold(spark.createDataFrame([b for b in bars if b[1] > D0 + dt.timedelta(3) or b[0] == 1], BAR), 1)
    assert told(T.current_log(spark, plans, folder, "k")) == told(M.simulate(spark.createDataFrame(bars, BAR).join(plans, "k"), "k"))
