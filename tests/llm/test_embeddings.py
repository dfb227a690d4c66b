"""Centroid clustering, embedding near-dedup and hard negatives against plain versions."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import clusters, embed_dedup, negatives, queries

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_embedding_near_dedup", "op13_hard_negatives"])
def test_queries_equal_their_sql(spark, sf, name):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    told = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == cols
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(tuple(r[names.index(k)] for k in cols) for r in told.fetchall())


# ---------------------------------------------------------------- clusters


def plain_lloyd(rows, k, rounds, dim, seed=2):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for turn in range(rounds + 1):
        owned = [min((square(x, c), n) for n, c in enumerate(centroids)) for _, x in kept]
        if turn < rounds:
            for n in range(len(centroids)):
                mine = [x for (_, x), (_, m) in zip(kept, owned) if m == n]
                if mine:
                    centroids[n] = [sum(col) // len(mine) for col in zip(*mine)]
    per = Counter()
    for d, n in owned:
        per[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i is None, i or 0), n, d, per[n], sum(per.values()), digest[n]) for (i, _), (d, n) in zip(kept, owned))


def cluster(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as cluster", "1 as distance", "2 as x")
    got = clusters.centroid_clusters(df, **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in got.collect())


def test_clusters_against_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(4) + (i % 5)).tolist()) for i in range(400)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(400, 600)]  # a third are copies, more than the clusters
    rows += [(7, rows[7][1]), (7, [0.0, -3.0, 2.0, 1.0]), (None, [9.0, 9.0, 9.0, 9.0]), (None, None)]
    rows += [(700, None), (701, [1.0, 2.0]), (702, [1.0, NAN, 1.0, 1.0]), (703, [1.0, INF, 1.0, 1.0]), (704, [1.0, None, 1.0, 1.0]), (705, []), (706, [-0.0, -0.001, 1e3, -1e3])]
    for k in (1, 12):
        assert cluster(spark, rows, k=k, rounds=5, dim=4) == plain_lloyd(rows, k, 5, 4)


def test_ties_few_vectors_and_none(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(9)] + [(20, [0.5, 0.0])]
    assert cluster(spark, rows, k=6, rounds=3, dim=2) == plain_lloyd(rows, 6, 3, 2)
    assert cluster(spark, rows[:2], k=6, rounds=3, dim=2) == plain_lloyd(rows[:2], 6, 3, 2)
    assert cluster(spark, [(1, None)], k=6, rounds=3, dim=2) == []


def test_large_components(spark):
    rows = [(i, [(i - 20) * 1000.5 + 400_000, -(i % 7) * 70_000.25]) for i in range(40)]
    assert cluster(spark, rows, k=5, rounds=5, dim=2) == plain_lloyd(rows, 5, 5, 2)
    with pytest.raises(Exception, match="too large"):
        cluster(spark, [(1, [1e9, 0.0])], k=1, rounds=1, dim=2)


def test_only_what_can_change_is_compared_and_nothing_is_missed():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, c = rng.integers(-9, 9, (200, 3)), rng.integers(-9, 9, (8, 3))
        owner, distance = clusters.reassign(x, np.full(200, -1), np.zeros(200, np.int64), c, np.ones(8, bool))
        moved = rng.random(8) < 0.4
        c = np.where(moved[:, None], rng.integers(-9, 9, (8, 3)), c)
        best, least = clusters.reassign(x, owner, distance, c, moved)
        d = ((x[:, None] - c) ** 2).sum(axis=2)
        assert (best == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


# ---------------------------------------------------------------- near-dedup


def plain_links(rows, cosine=0.95):
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [None if not g else np.array(v, float) / np.abs(v).max() for g, (_, v) in zip(good, rows)]
    unit = [None if u is None else u / math.sqrt((u * u).sum()) for u in unit]
    near = [[j for j, w in enumerate(unit) if j != i and u is not None and w is not None and len(u) == len(w) and u @ w >= cosine] for i, u in enumerate(unit)]
    comp = list(range(len(rows)))
    while True:
        new = [min([c, *(comp[j] for j in near[i])]) for i, c in enumerate(comp)]
        if new == comp:
            break
        comp = new
    least = {}
    for c, (i, _) in zip(comp, rows):
        least[c] = i if least.get(c) is None else least[c] if i is None else min(least[c], i)
    return sorted(map(str, ((i, len(n), least[c], i == least[c]) for (i, _), n, c in zip(rows, near, comp))))


def dedup(spark, rows, kind="long"):
    df = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>").selectExpr("*", "1 as c", "'q' as comp", "2 as n_links", "3 as v")
    got = embed_dedup.near_duplicate_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(str(tuple(r)) for r in got.collect())


def around(rng, center, cosine, n):
    """n vectors at a cosine of a unit vector."""
    noise = rng.standard_normal((n, len(center)))
    noise -= (noise @ center)[:, None] * center
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return cosine * center + math.sqrt(1 - cosine * cosine) * noise


@pytest.mark.parametrize("small", [False, True])
def test_links_against_all_pairs(spark, monkeypatch, small):
    """Balls, groups wider than a ball, chains, copies, scaled copies and bad vectors; also with least windows, runs and blocks."""
    if small:
        for name, value in (("WINDOW", 8), ("RUN", 64), ("BLOCK", 16), ("SMALL", 4)):
            monkeypatch.setattr(embed_dedup, name, value)
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((4, 64))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    rows = [*around(rng, centers[0], 0.996, 150), *around(rng, centers[1], 0.979, 60), *rng.standard_normal((80, 64)), *[centers[2] * 3.0] * 40, centers[2] * 1e200, centers[2] * 1e-200]
    angle = np.linspace(0, 2.0, 12)  # a chain: neighbours link, ends do not
    rows += [math.cos(a) * centers[3] + math.sin(a) * (centers[0] - (centers[0] @ centers[3]) * centers[3]) for a in angle]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(rows)), rows)]
    bad = [None, [], [0.0] * 64, [1.0, NAN], [INF] * 64, [None] * 64]
    rows += [(900 + i, v) for i, v in enumerate(bad)] + [rows[0], (None, rows[0][1]), (None, None), (None, [-7.0, 1.0]), (960, [1.0, 2.0]), (961, [1.0, 2.1]), (962, [-0.0, 1.0]), (963, [0.0, 1.0])]
    assert dedup(spark, rows) == plain_links(rows)


def test_string_ids_and_no_rows(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.01]), ("c", [0.0, 1.0])]
    assert dedup(spark, rows, "string") == plain_links(rows)
    assert dedup(spark, []) == [] and dedup(spark, [(1, None)]) == plain_links([(1, None)])
    assert dedup(spark, [(3, [1.0])]) == plain_links([(3, [1.0])])


def test_pairs_at_the_least_cosine_are_found(spark):
    """1,500 pairs just above the cosine among 30,000 vectors: nothing else helps to find them."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((30_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(1500):
        x[i + 1500] = around(rng, x[i], 0.9502, 1)[0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = embed_dedup.near_duplicate_vectors(df).filter("n_links > 0").collect()
    assert all(r.n_links == 1 and r.component_id == r.vec_id % 1500 for r in got) and len(got) >= 0.95 * 3000


def test_a_large_group_does_not_become_pairs(spark):
    rng = np.random.default_rng(8)
    center = np.eye(64)[0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(around(rng, center, 0.996, 3000).tolist())], "c long, v array<double>")
    pairs = embed_dedup.likely_pairs(df, 3000, 0.95).count()
    assert pairs < 3000 * 2 * embed_dedup.passes(3000)


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows, every=10):
    size = Counter(len(v) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)).most_common()
    size = min((-n, s) for s, n in size)[1] if size else 0
    byid = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            byid.setdefault(i, []).append((label, [math.floor(256 * x) for x in v]))
    one, out = {i: min(v) for i, v in byid.items()}, []
    for a in one:
        if a % every:
            continue
        label, x = one[a]
        score = sorted((-sum(p * q for p, q in zip(x, y)), i) for i, (_, y) in one.items() if i != a)
        for p, i in [s for s in score if one[s[1]][0] == label][:5]:
            for rank, (s, n) in enumerate([s for s in score if one[s[1]][0] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10], 1):
                out.append((a, i, rank, n, -p, -s))
    return sorted(out)


def mine(spark, rows, every=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "'x' as x", "2 as cell", "3 as part")
    got = negatives.hard_negatives(df, f"id % {every} = 0")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("limits", [{}, {"PART_VALUES": 200, "GROUP_VALUES": 40, "LEAST_SAMPLED": 30, "GROUPS": 7, "PARTS": 1}])
@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_negatives_against_all_pairs(spark, monkeypatch, limits, spread):
    """Tight clusters, where rings leave most rows out, and none; a third of the rows of one label and one vector; ties, repeated ids, bad rows."""
    for name, value in limits.items():
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(9)
    centers = 2 * rng.standard_normal((6, 8))
    rows = [(i, (centers[i % 6] + spread * rng.standard_normal(8)).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    rows += [(300 + i, centers[0].tolist(), 1 if i % 50 else 2) for i in range(150)]
    rows += [rows[0], (10, rows[3][1], 0), (20, rows[20][1], -1), (None, rows[1][1], 1), (901, rows[1][1], None), (910, None, 1), (920, [NAN] * 8, 1), (930, [None] * 8, 1), (940, [1.0], 1), (950, [], 1), (960, [0.0] * 8, 1), (970, [1.0] * 8, 99)]
    want = plain_negatives(rows)
    assert mine(spark, rows) == want and len(want) > 300


def test_rings_leave_rows_out_and_no_answer(spark):
    """The plane's rings are narrower than its cells where vectors are clustered."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * (4 * rng.standard_normal((20, 8))[rng.integers(0, 20, 2000)] + 0.1 * rng.standard_normal((2000, 8)))).astype(np.int64)
    plane = negatives.Plane(np.arange(2000), np.zeros(2000, np.int64), x, 2000, float((x * x).sum(axis=1).max()))
    cell, r = plane.cells(x)
    score = x[:50] @ x.T
    low = np.sort(score, axis=1)[:, -6]
    inner, outer = plane.rings(x[:50], low, None)
    served = (inner[:, cell] <= r) & (r <= outer[:, cell])
    assert served[score >= low[:, None]].all() and served.mean() < 0.6


def test_negatives_of_few_rows(spark):
    assert mine(spark, []) == [] and mine(spark, [(0, [1.0, 1.0], 1)]) == []
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (3, [-1.0, 0.0], 2), (10, [0.0, 0.0], 1)]
    assert mine(spark, rows) == plain_negatives(rows)
    with pytest.raises(Exception, match="too large"):
        mine(spark, [(0, [1e9], 1)])
