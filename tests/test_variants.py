"""Dimensions of rule variants against plain loops, and their verdicts."""

import random
from statistics import mean

import pytest

from tidemark.operators import variants as R

VARIANTS = {"base": ("c0", "s0"), "one": ("c1", "s1"), "two": ("c2", "s1")}
COLUMNS = "id string, horizon int, month int, ret double, reward double, region string, period string, s0 double, s1 double, c0 string, c1 string, c2 string, tie int"


@pytest.fixture(scope="module")
def world():
    rng, rows = random.Random(21), []
    for i in range(900):
        s0 = rng.choice([None, *map(float, range(6))])
        ret = None if rng.random() < 0.05 else rng.gauss(0.01 * (s0 or 0), 0.1)
        calls = [rng.choice(["UP", "UP", "DOWN", None]) for _ in range(3)]
        rows.append((f"k{rng.randrange(40)}", rng.choice([1, 2, 3, 6]), rng.randrange(24), ret, rng.choice([None, rng.random() - 0.4]), rng.choice(["n", "s", "tiny" if i < 20 else "n", None]), rng.choice(["before", "after", None]), s0, float(rng.randrange(4)), *calls, i))
    return rows


def ranks(xs):
    return [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]


def corr(a, b):
    ma, mb = mean(a), mean(b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5


def edge(rows, call, least):
    hit = [(r["ret"] or 0) > 0 for r in rows]
    up = [h for h, r in zip(hit, rows) if r[call] == "UP"]
    return mean(up) - mean(hit) if len(up) >= least else None


def share(es):
    es = [e for e in es if e is not None]
    return mean(e > 0 for e in es) if es else None


def plain(world):
    names, out = [c.split()[0] for c in COLUMNS.split(", ")], {}
    every = [dict(zip(names, r)) for r in world]
    for h in sorted({r["horizon"] for r in every}):
        rows = [r for r in every if r["horizon"] == h]
        first = {}
        for r in sorted(rows, key=lambda r: r["tie"]):
            first.setdefault((r["id"], r["month"]), r)
        for v, (call, score) in VARIANTS.items():
            split = lambda rs, k: [[r for r in rs if k(r) == x] for x in sorted({k(r) for r in rs if k(r) is not None})]
            paid = [r["reward"] for r in rows if r[call] == "UP" and r["reward"] is not None]
            periods = [edge(p, call, 10) for p in split(rows, lambda r: r["period"])]
            both = [r for r in rows if r[score] is not None and r["ret"] is not None]
            spreads = []
            for m in split(both, lambda r: r["month"]):
                k = max(1, len(m) // 5)
                best, worst = sorted(m, key=lambda r: (-r[score], -r["tie"]))[:k], sorted(m, key=lambda r: (r[score], r["tie"]))[:k]
                if len(m) >= 10 and mean(r[score] for r in best) > mean(r[score] for r in worst):
                    spreads.append(mean(r["ret"] for r in best) - mean(r["ret"] for r in worst))
            out[v, h] = {
                "edge": edge(rows, call, 10), "r": mean(paid) if len(paid) >= 10 else None, "robust": share(edge(p, call, 10) for p in split(list(first.values()), lambda r: r["month"] % h)),
                "region": share(edge(p, call, 30) for p in split(rows, lambda r: r["region"])), "temporal": min(periods) if len(periods) == 2 and None not in periods else None,
                "ic": corr(ranks([r[score] for r in both]), ranks([r["ret"] for r in both])) if len(both) >= 30 else None, "tb": mean(spreads) if spreads else None,
            }
    return out


def test_dimensions_and_verdicts_against_loops(spark, world):
    calls = spark.createDataFrame(world, COLUMNS).repartition(5)
    values = R.dimensions(calls, VARIANTS, "id", "horizon", "month", "ret", "reward", "region", "period", "tie").cache()
    got = {(r.variant, r.horizon, r.dimension): r.value for r in values.collect()}
    want = {(v, h, d): x for (v, h), ds in plain(world).items() for d, x in ds.items()}
    assert values.count() == len(got) and set(got) <= set(want)
    for k, x in want.items():
        assert got.get(k) == (None if x is None else pytest.approx(x, abs=1e-9)), k
    assert sum(x is not None for x in want.values()) > 60

    told = {(r.variant, r.dimension): r for r in R.compared(values, "base", ["one", "two"]).collect()}
    assert len(told) == 14
    for v in ("one", "two"):
        verdicts = {}
        for d, t in R.TOLERANCES.items():
            pairs = [(want["base", h, d], want[v, h, d]) for h in (1, 2, 3, 6)]
            a, b = ([x for x in xs if x is not None] for xs in zip(*pairs))
            moved = [y - x for x, y in pairs if x is not None and y is not None]
            delta = mean(b) - mean(a) if moved else None
            verdicts[d] = "INCONCLUSIVE" if not moved else "IMPROVES" if delta >= t and mean(x > 0 for x in moved) >= 0.6 else "DEGRADES" if -delta >= t and mean(x < 0 for x in moved) >= 0.6 else "INCONCLUSIVE"
            assert told[v, d].verdict == verdicts[d]
        up, down = (list(verdicts.values()).count(x) for x in ("IMPROVES", "DEGRADES"))
        assert {r.overall for (w, _), r in told.items() if w == v} == {"IMPROVES" if up >= 3 and not down else "DEGRADES" if down >= 2 else "INCONCLUSIVE"}


def test_the_calls_are_counted_in_one_scan(spark, world, tmp_path):
    spark.createDataFrame(world, COLUMNS).write.parquet(f"{tmp_path}/calls")
    calls = spark.read.parquet(f"{tmp_path}/calls")
    found = R.cells(calls, {v: c for v, (c, _) in VARIANTS.items()}, "id", "horizon", "month", "ret", "reward", "region", "period", "tie")
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert R.dimensions(calls.limit(0), VARIANTS, "id", "horizon", "month", "ret", "reward", "region", "period", "tie").count() == 0
