import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.llm import ann

QUERY = "id % 50 = 0"


def brute(rows, k=5):
    good = {}
    size = max(len(v) for _, v in rows if v)
    for i, v in rows:
        if i is not None and v and len(v) == size and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v, np.float64))
    out = {}
    for q in good:
        if q % 50 == 0:
            for a in good[q][:1]:
                scores = sorted((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i) for i, bs in good.items() if i != q for b in bs[:1])
                out[q] = scores[:k]
    return out


def isotropic(rng, n, dim=64):
    return rng.standard_normal((n, dim)).astype("f4")


def clustered(rng, n, dim=64):
    return (rng.standard_normal((n // 40, dim))[rng.integers(0, n // 40, n)] + 0.6 * rng.standard_normal((n, dim))).astype("f4")


def recall(spark, x, folder):
    """Share of the true nearest five that are found, by blocks of exact scores; the scores found are held against them."""
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}), f"{folder}/v.parquet")
    got = ann.nearest_neighbours(spark.read.parquet(f"{folder}/v.parquet").repartition(8), QUERY).toPandas().sort_values(["query_id", "rank"])
    y, hits, asked = x.astype(np.float64), 0, len(range(0, len(x), 50))
    y /= np.linalg.norm(y, axis=1)[:, None]
    found = {q: (g["vec_id"].to_numpy(), g["score"].to_numpy()) for q, g in got.groupby("query_id")}
    for at in range(0, len(x), 5000):
        some = list(range(at, min(at + 5000, len(x)), 50))
        scores = y[some] @ y.T
        for q, score in zip(some, scores):
            score[q] = -2
            best, (ids, told) = np.argpartition(-score, 5)[:5], found[q]
            assert len(ids) == 5 and np.allclose(score[ids], told, atol=1e-12)
            hits += len(set(best) & set(ids))
    return hits / (5 * asked)


@pytest.mark.parametrize("make", [isotropic, clustered])
def test_recall(spark, tmp_path, make):
    assert recall(spark, make(np.random.default_rng(7), 40_000), tmp_path) >= 0.9


def test_recall_where_depths_come_from_a_sample(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 2_000)
    assert recall(spark, clustered(np.random.default_rng(8), 20_000), tmp_path) >= 0.9


def test_very_large_and_small_components(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [1e-200, 1e-200]), (3, [3e-310, 0.0]), (50, [-1e308, -1e308])]
    got = {}
    for r in ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), QUERY).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
    half = round(math.sqrt(0.5), 12)
    assert got == {0: [(1, 1.0), (3, 1.0), (2, half), (50, -half)], 50: [(0, -half), (1, -half), (3, -half), (2, -1.0)]}
    bad = spark.createDataFrame([(0, [0.0, 0.0]), (50, [float("nan"), 1.0]), (100, None)], "vec_id long, embedding array<double>")
    assert ann.nearest_neighbours(bad, QUERY).count() == 0


@pytest.mark.parametrize("part", [8192, 16])
def test_copies_ties_and_bad_vectors(spark, monkeypatch, part):
    monkeypatch.setattr(ann, "PART", part)
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, -1.0] if i % 3 == 0 else rng.standard_normal(3).astype("f4").tolist()) for i in range(300)]
    rows += [(1000, None), (1050, [0.0, 0.0, 0.0]), (1100, [1.0, None, 2.0]), (1150, [1.0, float("nan"), 0.0]), (1200, [float("inf"), 1.0, 0.0]), (1250, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    rows += [rows[0], rows[3], (301, [-0.0, 0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("k", ann.F.lit("clash"))
    got = {}
    for r in ann.nearest_neighbours(vectors, QUERY).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    want = brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 1.0])], schema)
    assert [tuple(r)[:3] for r in ann.nearest_neighbours(few, QUERY).orderBy("query_id", "rank").collect()] == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.nearest_neighbours(few.limit(0), QUERY).count() == 0
    assert ann.nearest_neighbours(few.filter("vec_id = 0"), QUERY).count() == 0
