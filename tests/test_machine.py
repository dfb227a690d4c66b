"""The fold of trades against a plain loop over random plans, against stated cases, and its metrics."""

import datetime as dt
import random

import pytest

from tidemark.operators import machine, review, simulate
from tidemark.plans import QUERIES

D = dt.date
NAMES = list(machine.PLAN)
SCHEMA = "t long, session_date date, open double, high double, low double, close double, " + ", ".join(f"{c} {t}" for c, t in machine.PLAN.items())


def day(n):
    return D(2024, 1, 1) + dt.timedelta(n)


def plain(plan, bars):
    """The log of one trade, by the rules as they are stated."""
    p = dict.fromkeys(NAMES) | plan
    levels = [(n, p[f"target_{n}"]) for n in (1, 2, 3) if p[f"target_{n}"] is not None]
    policy = p["exit_policy"] or "LEGACY_HALF_AT_TP1"
    share = {1: 0.5, 2: 0.5} if p["target_2"] is not None else {1: 1.0}
    if policy != "LEGACY_HALF_AT_TP1":
        share = {n: (p[f"fraction_{n}"] or 0.0) if policy == "PARTIAL_FRACTIONS" else 0.0 for n in (1, 2, 3)}
    log, state, entry, left, touched, last = [], "WAITING_ENTRY", None, 1.0, set(), None

    def add(d, event, price=None, fraction=0.0, new=None):
        nonlocal state, left
        state, left = new or state, left - fraction
        log.append((d, event, price, fraction, state))

    def touch(d, opened, reached):
        for n, t in levels:
            if n not in touched and reached >= t:
                touched.add(n)
                part = min(share.get(n, 0.0), left)
                if part > 1e-12:
                    add(d, f"TARGET_{n}", max(opened, t), part, f"TP{n}" if left - part <= 1e-12 else "PARTIAL_TP")
                else:
                    add(d, f"TARGET_{n}", max(opened, t))

    def entered(d, o, h, low, c):
        if o <= p["stop"]:
            return add(d, "STOP_GAP", o, left, "STOPPED")
        touch(d, o, o)
        if left <= 1e-12:
            return None
        sells = any(n not in touched and h >= t and share.get(n, 0.0) > 1e-12 for n, t in levels)
        if low <= p["stop"]:
            if sells:
                return add(d, "AMBIGUOUS_INTRABAR", new="AMBIGUOUS_INTRABAR")
            touch(d, o, h)
            return add(d, "STOP", p["stop"], left, "STOPPED")
        touch(d, o, h)
        if left > 1e-12 and p["invalidation"] is not None and c < p["invalidation"]:
            add(d, "INVALIDATED", c, left, "INVALIDATED")
        return None

    if p["entry_type"] == "MARKET_REFERENCE":
        entry = last = p["entry_high"]
        add(p["decided"], "ENTRY", entry, new="ENTERED")
    for d, o, h, low, c in bars:
        if state not in machine.OPEN:
            break
        if entry is None:
            if p["cancel_on"] and d > p["cancel_on"]:
                break
            if p["expiration"] and d > p["expiration"]:
                add(d, "EXPIRED", new="EXPIRED")
                break
            if p["invalidation"] is not None and c < p["invalidation"]:
                add(d, "INVALIDATED", new="INVALIDATED")
                break
            top = p["entry_high"]
            if p["entry_type"] == "MARKET":
                fill = o
            elif p["entry_type"] == "STOP_BUY":
                fill = max(o, top) if h >= top else None
            else:
                fill = min(o, top) if low <= top else None
            if fill is None:
                continue
            entry = fill
            add(d, "ENTRY", fill, new="ENTERED")
            if fill <= p["stop"]:
                add(d, "STOP", fill, left, "STOPPED")
            elif fill == o:
                entered(d, o, h, low, c)
            elif low <= p["stop"] or any(h >= t for _, t in levels):
                add(d, "AMBIGUOUS_INTRABAR", new="AMBIGUOUS_INTRABAR")
            last = c
            continue
        if p["manual_on"] and d > p["manual_on"]:
            break
        if p["expiration"] and d > p["expiration"]:
            add(d, "EXPIRED", last, left, "EXPIRED")
            break
        entered(d, o, h, low, c)
        last = c
    if state in machine.OPEN and entry is None and p["cancel_on"]:
        add(p["cancel_on"], "CANCELLED", new="CANCELLED")
    if state in machine.OPEN and entry is not None and p["manual_on"]:
        add(p["manual_on"], "MANUAL_CLOSE", p["manual_price"], left, "CLOSED_MANUAL")
    return log


def run(spark, trades):
    """{trade: log} of trades (plan, bars), by the operator."""
    rows = [(i, *b, *(plan.get(c) for c in NAMES)) for i, (plan, bars) in enumerate(trades) for b in bars]
    out = {}
    for r in machine.simulate(spark.createDataFrame(rows, SCHEMA), "t").orderBy("t", "sequence_number").collect():
        out.setdefault(r.t, []).append((r.session_date, r.event, r.price, r.fraction, r.state))
    return out


def test_random_plans_against_a_loop(spark):
    rng, trades = random.Random(12), []
    for _ in range(1500):
        price, bars = 10.0, []
        for i in range(rng.randint(1, 14)):
            o = price + rng.choice([0, 0, 0.5, -0.5, 1.5, -1.5, 3, -3]) * rng.choice([0, 1])
            c = o + rng.choice([0, 1, -1, 0.5, -0.5, 2, -2])
            bars.append((day(i + 1), o, max(o, c) + rng.choice([0, 0.5, 1, 2]), min(o, c) - rng.choice([0, 0.5, 1, 2]), c))
            price = c
        kind = rng.choice(["LIMIT", "ENTRY_ZONE", "STOP_BUY", "MARKET", "MARKET_REFERENCE", None])
        top = rng.choice([9.0, 9.5, 10.0, 10.5])
        policy = rng.choice(["LEGACY_HALF_AT_TP1", "PARTIAL_FRACTIONS", "TRACK_TARGETS_ONLY", None])
        plan = {"entry_type": kind, "entry_low": top - 0.5 if kind == "ENTRY_ZONE" else top, "entry_high": top, "stop": rng.choice([7.0, 8.0, 8.4]), "target_1": rng.choice([11.0, 12.0]), "exit_policy": policy, "decided": day(0)}
        plan["target_2"] = rng.choice([None, 12.5, 14.0])
        plan["target_3"] = rng.choice([None, 15.0]) if plan["target_2"] else None
        if policy == "PARTIAL_FRACTIONS":
            plan |= {"fraction_1": rng.choice([0.0, 0.3, 1.0]), "fraction_2": 0.0, "fraction_3": None}
            if plan["target_2"] and plan["fraction_1"] < 1:
                plan["fraction_2"] = rng.choice([0.3, 0.7])
        plan |= {"invalidation": rng.choice([None, None, 8.5]), "expiration": rng.choice([None, day(6), day(9)]), "cancel_on": rng.choice([None, None, day(3)])}
        plan |= rng.choice([{}, {}, {"manual_on": day(5), "manual_price": 10.25}])
        trades.append((plan, bars))
    got, states = run(spark, trades), set()
    for i, (plan, bars) in enumerate(trades):
        want = plain({**plan, "entry_type": plan["entry_type"] or "LIMIT"}, bars)
        assert [(d, e, p, pytest.approx(f), s) for d, e, p, f, s in want] == got.get(i, []), (plan, bars)
        states |= {x[4] for x in want}
    assert states >= {"ENTERED", "PARTIAL_TP", "TP1", "TP2", "STOPPED", "INVALIDATED", "EXPIRED", "CLOSED_MANUAL", "AMBIGUOUS_INTRABAR", "CANCELLED"}


LIMIT = {"entry_type": "LIMIT", "entry_low": 10.0, "entry_high": 10.0, "stop": 9.0, "target_1": 12.0, "target_2": 14.0, "invalidation": 8.0, "expiration": day(9), "decided": day(0)}


@pytest.mark.parametrize("path, want", [
    ([(11, 11.5, 10.5, 11)], []),
    ([(11, 11, 9.5, 10), (10, 12.5, 9.5, 12)], ["ENTRY", "TARGET_1"]),
    ([(11, 11, 9.5, 10), (10, 15, 9.5, 12)], ["ENTRY", "TARGET_1", "TARGET_2"]),
    ([(11, 11, 8.5, 10)], ["ENTRY", "AMBIGUOUS_INTRABAR"]),
    ([(11, 11, 9.5, 10), (8.5, 9, 8, 9)], ["ENTRY", "STOP_GAP"]),
    ([(11, 11, 9.5, 10), (10, 12.5, 8.5, 12)], ["ENTRY", "AMBIGUOUS_INTRABAR"]),
    ([(11, 11, 10.5, 11)] * 9 + [(9.5, 9.9, 9.1, 9.5)], ["EXPIRED"]),
    ([(9.5, 10, 9.2, 9.8), (13, 13.5, 12.5, 13)], ["ENTRY", "TARGET_1"]),
])
def test_stated_cases(spark, path, want):
    bars = [(day(i + 1), *map(float, p)) for i, p in enumerate(path)]
    frame = spark.createDataFrame([(1, *b, *(LIMIT.get(c) for c in NAMES)) for b in bars], SCHEMA)
    log = machine.simulate(frame, "t")
    assert [r.event for r in log.orderBy("sequence_number").collect()] == want
    assert simulate.append_suffix(log.limit(1), log, "t").count() == max(0, len(want) - 1)
    assert machine.simulate(frame.limit(0), "t").count() == 0


def test_problems_of_plans(spark):
    def problem(**changed):
        plan = LIMIT | {"exit_policy": "TRACK_TARGETS_ONLY"} | changed
        return machine.validated(spark.createDataFrame([tuple(plan.get(c) for c in NAMES)], ", ".join(f"{c} {t}" for c, t in machine.PLAN.items()))).first().problem

    assert problem() is None
    assert [problem(entry_type="X"), problem(stop=10.0), problem(target_2=11.0), problem(target_3=13.0), problem(invalidation=-1.0), problem(exit_policy="X")] == ["ENTRY_TYPE", "LEVEL_ORDER", "TARGET_2", "TARGET_3", "INVALIDATION", "EXIT_POLICY"]
    assert problem(entry_type="MARKET_REFERENCE", entry_low=9.5) == "ONE_REFERENCE_PRICE" and problem(fraction_1=0.5) == "FRACTIONS_OF_ANOTHER_POLICY"
    assert problem(exit_policy="PARTIAL_FRACTIONS", fraction_3=0.5) == "FRACTION_WITHOUT_TARGET" and problem(exit_policy="PARTIAL_FRACTIONS", fraction_1=0.7, fraction_2=0.7) == "FRACTIONS"


def test_metrics_and_comparison(spark):
    bars = [(day(1), 10.0, 10.5, 9.5, 10.0), (day(2), 10.0, 12.5, 9.8, 12.0), (day(3), 12.0, 12.2, 8.5, 9.0)]
    frame = spark.createDataFrame([(1, *b, *(LIMIT.get(c) for c in NAMES)) for b in bars], SCHEMA)
    m = machine.metrics(machine.simulate(frame, "t"), frame, "t").first()
    assert (m.state, m.entry, m.exit, m.sold, m.bars_held) == ("STOPPED", 10.0, 10.5, 1.0, 3)
    assert (m.ret, m.realised_r, m.mfe, m.mae) == (pytest.approx(0.05), pytest.approx(0.5), pytest.approx(0.25), pytest.approx(-0.15))


def test_state_machine_queries_against_the_loop(spark, sf):
    """state_machine_log, state_machine_replay, trade_milestones, trade_metrics and plan_counterfactual over the whole table."""
    from tidemark.plans import trades

    paths = {}
    for r in trades.simulated(spark, sf).orderBy("user_id", "session_date").collect():
        paths.setdefault(r.user_id, []).append(r)

    def logs(stop):
        out = {}
        for u, rows in paths.items():
            plan = {c: rows[0][c] for c in NAMES if c in rows[0].__fields__} | {"stop": rows[0].entry * stop if stop else rows[0].stop}
            out[u] = plain(plan, [(r.session_date, r.open, r.high, r.low, r.close) for r in rows])
        return {u: x for u, x in out.items() if x}

    want, other = logs(None), {u: x for u, x in logs(0.85).items()}
    got = {}
    for r in QUERIES["state_machine_log"](spark, sf).orderBy("user_id", "sequence_number").collect():
        got.setdefault(r.user_id, []).append((r.session_date, r.event, r.price, r.fraction, r.state))
    assert {u: [(d, e, pytest.approx(p) if p is not None else None, pytest.approx(f), s) for d, e, p, f, s in x] for u, x in want.items()} == got

    def outcome(x):
        entry = next((p for _, e, p, _, _ in x if e == "ENTRY"), None)
        sold = sum(f for *_, f, _ in x)
        exit_ = sum(p * f for _, _, p, f, _ in x if p is not None) / sold if sold > 0 else None
        return x[-1][4], entry, exit_, exit_ / entry - 1 if entry and abs(sold - 1) < 1e-9 else None

    replayed = {r.user_id: (r.state, r.entry, r.exit, r.ret) for r in QUERIES["state_machine_replay"](spark, sf).collect()}
    close = lambda v: pytest.approx(v) if isinstance(v, float) else v
    assert {u: tuple(map(close, outcome(x))) for u, x in want.items()} == replayed
    stones = {r.user_id: (r.entered, r.first_target, r.ended) for r in QUERIES["trade_milestones"](spark, sf).collect()}
    first = lambda x, test: min((e[0] for e in x if test(e)), default=None)
    assert stones == {u: (first(x, lambda e: e[1] == "ENTRY"), first(x, lambda e: e[1] == "TARGET_1"), first(x, lambda e: e[4] not in machine.OPEN)) for u, x in want.items()}
    both = {r.user_id: (r.state, r.user_state, r.better) for r in QUERIES["plan_counterfactual"](spark, sf).collect()}
    for u in want.keys() | other.keys():
        a, b = (outcome(x[u]) if u in x else (None,) * 4 for x in (want, other))
        gap = b[3] - a[3] if a[3] is not None and b[3] is not None else None
        assert both[u] == (a[0], b[0], None if gap is None else "SAME" if abs(gap) < 1e-12 else "USER" if gap > 0 else "ORIGINAL")
    held = {r.user_id: r for r in QUERIES["trade_metrics"](spark, sf).collect()}
    assert held.keys() == {u for u, x in want.items() if outcome(x)[1]} and all(r.mae <= r.mfe for r in held.values() if r.mfe is not None)
    assert review.OPEN == machine.OPEN
