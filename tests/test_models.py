"""Models from sums of products against plain solvers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.plans import panel


def plain_ridge(x, y, penalty):
    xc, yc = x - x.mean(0), y - y.mean()
    k = np.linalg.solve(xc.T @ xc + penalty * np.eye(x.shape[1]), xc.T @ yc)
    return k, y.mean() - x.mean(0) @ k


def plain_logistic(x, y, penalty):
    a, k = np.c_[x, np.ones(len(x))], np.r_[np.zeros(x.shape[1]), np.log(y.mean() / (1 - y.mean()))]
    pen = np.r_[np.full(x.shape[1], penalty), 0.0]
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ k))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(pen), a.T @ (y - p) - pen * k)
        k = k + step
        if np.abs(step).max() < 1e-12:
            break
    return k[:-1], k[-1]


def table(spark, groups, k=4, n=300, seed=1):
    rng = np.random.default_rng(seed)
    rows, data = [], {}
    for g in groups:
        x = rng.standard_normal((n, k)) * np.arange(1, k + 1) + 100.0 * g
        y = x @ rng.standard_normal(k) + rng.standard_normal(n)
        z = (rng.random(n) < 1 / (1 + np.exp(-(x - x.mean(0)) @ np.linspace(-0.5, 0.5, k)))).astype(int)
        data[g] = (x, y, z)
        rows += [(g, *map(float, a), float(b), int(c)) for a, b, c in zip(x, y, z)]
    return spark.createDataFrame(rows, "g int, " + ", ".join(f"f{i} double" for i in range(k)) + ", y double, z int"), data


FEATURES = ["f0", "f1", "f2", "f3"]


@pytest.mark.parametrize("penalty", [0.0, 2.5])
def test_ridge_equals_a_plain_solver(spark, penalty):
    df, data = table(spark, [0, 1, 2])
    holes = spark.createDataFrame([(0, None, 1.0, 1.0, 1.0, 1.0, 1), (1, 1.0, 1.0, 1.0, 1.0, None, 0)], df.schema)
    got = {r.g: r for r in M.ridge(df.unionByName(holes), ["g"], FEATURES, "y", penalty).collect()}
    for g, (x, y, _) in data.items():
        k, level = plain_ridge(x, y, penalty)
        assert got[g].n == 300 and np.allclose(got[g].coefficients, k, rtol=0, atol=1e-8) and got[g].intercept == pytest.approx(level, abs=1e-6)
    one = M.ridge(df.filter("g = 1"), [], ["f0"], "y", penalty).first()
    assert one.coefficients[0] == pytest.approx(plain_ridge(data[1][0][:, :1], data[1][1], penalty)[0][0], abs=1e-9)


def test_what_cannot_be_solved_is_null(spark):
    rows = [("dependent", float(i), 2.0 * i, float(i % 3), i % 2) for i in range(50)] + [("constant", 1.0, float(i), float(i), 1) for i in range(50)] + [("one", 1.0, 2.0, 3.0, 0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double, z int")
    free, held = ({r.g: r for r in M.ridge(df, ["g"], ["a", "b"], "y", p).collect()} for p in (0.0, 1.0))
    assert all(free[g].coefficients is None and free[g].intercept is None for g in free)
    assert held["constant"].coefficients[0] == pytest.approx(0.0) and held["one"].coefficients == [0.0, 0.0] and held["one"].intercept == 3.0
    chance = {r.g: r for r in M.logistic(df, ["g"], ["a", "b"], "z").collect()}
    assert chance["constant"].coefficients is None and chance["one"].coefficients is None and chance["dependent"].coefficients is not None
    assert M.ridge(df.limit(0), ["g"], ["a"], "y").count() == 0 == M.logistic(df.limit(0), ["g"], ["a"], "z").count()


def test_logistic_equals_a_plain_solver(spark):
    df, data = table(spark, [0, 1], seed=3)
    centred = df.select("g", "z", *[(F.col(c) - 100.0 * F.col("g")).alias(c) for c in FEATURES])
    got = {r.g: r for r in M.logistic(centred, ["g"], FEATURES, "z", 0.7).collect()}
    for g, (x, _, z) in data.items():
        k, level = plain_logistic(x - 100.0 * g, z, 0.7)
        assert np.allclose(got[g].coefficients, k, rtol=0, atol=1e-8) and got[g].intercept == pytest.approx(level, abs=1e-8) and 2 < got[g].rounds < 20


def test_fold_predictions_against_a_plain_solver(spark, sf):
    """Every fold: medians, limits and scales of training rows, both models, and the rows after them."""
    rows = panel._assigned(spark, sf).select("fold", "id", "month", "role", "before", "n_orders", "ahead").toPandas()
    got = {}
    for r in panel.fold_predictions(spark, sf).collect():
        got.setdefault(r.fold, {})[r.id, r.month] = (r.predicted, r.p)
    seen = 0
    for fold, part in rows.groupby("fold"):
        x, role = part[["before", "n_orders"]].to_numpy(float), part.role.to_numpy()
        y = part.ahead.to_numpy(float)
        train = role == "TRAIN"
        med = np.nanmedian(x[train], axis=0)
        known = [x[train][:, i][~np.isnan(x[train][:, i])] for i in range(2)]
        lo, hi = (np.array([np.quantile(v, q) for v in known]) for q in (0.01, 0.99))
        full = np.clip(np.where(np.isnan(x), med, x), lo, hi)
        sd = full[train].std(axis=0)
        z = (full - full[train].mean(axis=0)) / np.where(sd == 0, 1, sd)
        use = train & ~np.isnan(y)
        k, level = plain_ridge(z[use], y[use], 1.0)
        c, at = plain_logistic(z[use], (y[use] > 0).astype(int), 1.0)
        late = ~train
        assert len(got.get(int(fold), {})) == late.sum()
        for i, m, s, p in zip(part.id[late], part.month[late], z[late] @ k + level, 1 / (1 + np.exp(-(z[late] @ c + at)))):
            a, b = got[int(fold)][i, m if isinstance(m, dt.date) else m.date()]
            assert a == pytest.approx(s, abs=1e-7) and b == pytest.approx(p, abs=1e-7)
            seen += 1
    assert seen > 100
