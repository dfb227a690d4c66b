"""Centroid clustering by delta Lloyd.

The assignment of every vector (its cluster and squared distance) is a table of the shared folder, and
the sums and counts of the clusters are kept between rounds. A round looks only at what moved: a vector
whose centroid stayed is compared with the centroids that changed; one whose centroid came no farther
likewise, since all others are as far as before; only a vector whose own centroid went away from it is
compared with all. Vectors that change their cluster are transfers: minus their components from the old
sum and plus to the new, added up within tasks first, so that some rows a task and cluster leave it. All
numbers are integers, and sums are exact in any order, also when a lost executor's tasks run again.

The driver holds k centroids, their sums and counts, and nothing of the vectors. A round reads the
assignments and writes them once; a round in which no centroid changes ends the rounds, as nothing
would move after it.

Defined cases: vectors that are null, of another length than ``dim``, or that hold null or non-finite
components are left out; repeated rows, and rows of equal ids, are vectors of their own; null ids are
clustered, and as starting centroids they come after all others; equal hashes are ordered by their
components; equally near centroids: the smaller number; an empty cluster keeps its centroid; fewer
vectors than k make fewer clusters; components of 2**19 and more are an error, since distances would not
fit a long; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .vectors import finite, ints, products, whole

K, ROUNDS, DIM = 40, 5, 64


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vectors, centroids) exact squared distances."""
    return (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * products(x, centroids)


def _least(d: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the number of the least distance (numbers ascend, so the first is the smaller) and that distance."""
    at = d.argmin(axis=1)
    return numbers[at], d[np.arange(len(d)), at]


def reassign(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clusters and distances after the centroids in ``changed`` (a mask) moved; owner -1: none yet."""
    numbers = np.arange(len(centroids))
    new = owner >= 0
    now = distance.copy()
    moved = new & changed[owner]
    gap = x[moved] - centroids[owner[moved]]
    now[moved] = (gap * gap).sum(axis=1)
    alone = ~new | (now > distance)  # its own centroid went away: any other may be nearer
    best, least = owner.copy(), now
    some = numbers[changed]
    if len(some) and not alone.all():
        rest = np.flatnonzero(~alone)
        number, d = _least(distances(x[rest], centroids[some]), some)
        nearer = (d < least[rest]) | ((d == least[rest]) & (number < best[rest]))
        best[rest[nearer]], least[rest[nearer]] = number[nearer], d[nearer]
    if alone.any():
        best[alone], least[alone] = _least(distances(x[alone], centroids), numbers)
    return best, least


def _assign(centroids: np.ndarray, changed: np.ndarray) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                owner = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                best, least = reassign(ints(batch.column(1), centroids.shape[1]), owner, batch.column(3).to_numpy(zero_copy_only=False), centroids, changed)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.int32()), pa.array(least, pa.int64()), pa.array(owner, pa.int32())], names=["id", "x", "cluster", "distance", "was"])

    return run


def _transfers(k: int, dim: int) -> Callable:
    """(cluster, n, sums) of what a task's vectors bring to clusters and take from them; column order x, cluster, was."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = ints(batch.column(0), dim)
                to, was = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                for sign, cluster in ((1, to), (-1, was)):
                    for c in np.unique(cluster[cluster >= 0]).tolist():
                        n[c] += sign * int((cluster == c).sum())
                        sums[c] += sign * x[cluster == c].sum(axis=0)
        some = np.flatnonzero((n != 0) | sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _moved(state: DataFrame, k: int, dim: int) -> tuple[list[int], list[list[int]]]:
    """The transfers of a round by cluster: of counts, and of sums of each component. k * (dim + 1) numbers come to the driver."""
    parts = state.filter("was <> cluster").select("x", "cluster", "was").mapInArrow(_transfers(k, dim), "cluster int, n long, sums array<long>")
    cells = parts.select("cluster", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "value"))
    n, sums = [0] * k, [[0] * dim for _ in range(k)]
    for r in cells.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        if r["at"]:
            sums[r["cluster"]][r["at"] - 1] = int(r["value"])
        else:
            n[r["cluster"]] = int(r["value"])
    return n, sums


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = 2) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    v = F.col(vector_col)
    kept = vectors.filter(finite(v) & (F.size(v) == dim)).select(F.col(id_col).alias("id"), whole(v).alias("x"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select("x", order.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    k = len(first)
    out = [vectors.schema[id_col], T.StructField("x", T.ArrayType(T.IntegerType())), *(T.StructField(c, t) for c, t in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("was", T.IntegerType())))]
    out[0] = T.StructField("id", out[0].dataType)
    centroids = np.array([r["x"] for r in first], np.int64).reshape(k, dim)
    changed, n, sums = np.ones(k, bool), [0] * k, [[0] * dim for _ in range(k)]
    state = kept.select("id", "x", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    for turn in range(rounds + 1 if k else 0):
        state = written(state.select("id", "x", "cluster", "distance").mapInArrow(_assign(centroids, changed), T.StructType(out)), "clusters")
        if turn == rounds:
            break
        dn, ds = _moved(state, k, dim)
        n, sums = [a + b for a, b in zip(n, dn)], [[a + b for a, b in zip(s, t)] for s, t in zip(sums, ds)]
        now = np.array([[a // m for a in s] if m else c for s, m, c in zip(sums, n, centroids.tolist())], np.int64).reshape(k, dim)
        changed, centroids = (now != centroids).any(axis=1), now
        if not changed.any():
            break
    told = dict(state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()) if k else {}
    inertia = [int(told.get(c, 0)) for c in range(k)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = [F.get(F.array(*map(F.lit, values)), F.col("cluster")) if k else F.lit(None) for values in ([str(i) for i in inertia], digests)]
    return state.select(
        F.col("id").alias(id_col), F.col("cluster").cast("int").alias("cluster"), "distance",
        per[0].cast("long").alias("cluster_inertia"), F.lit(str(sum(inertia))).cast("long").alias("inertia"), per[1].cast("string").alias("centroid_sha256"),
    )
