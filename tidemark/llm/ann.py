"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives a vector a string of 63 hash bits, the sides of random hyperplanes, and keeps the
vectors in the order of their strings. A query descends every tree to its longest prefix match, and
then all trees ascend together, one bit at a time, until the entries that share the prefix are enough;
these are its candidates, and their exact cosines decide. How far a query must ascend is read from the
same forest over a bounded sample; with up to ``SAMPLE`` vectors that is the forest itself.

All vectors are indexed. The sorted arrays are dealt out by the leading bits of the strings, a cell
of a tree to a group; cells that the sample shows to be large are split, and the queries that reach
them go to each part. Copies of a vector are searched for once: their class is indexed under its
smallest id, with as many of its smallest ids as a result can hold.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, nor do rows with a null id; a row's own id is never its neighbour,
also when the row is repeated; components may have any finite size; ties go to the smaller id; fewer candidates than asked for are all
returned; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

TREES, BITS, SAMPLE = 32, 63, 65_536
#: Vectors of a cell's part.
PART = 8192
#: Entries to gather for a query: all for small tables, and a share that falls as the table grows.
GATHER, GATHER_POWER = 3.4, 0.82


def planes(dim: int, trees: int = TREES, seed: int = 41) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * BITS))


def strings(x: np.ndarray, trees: int = TREES) -> np.ndarray:
    """(n, trees) hash strings, as integers whose highest of 63 bits is the first."""
    sides = (x @ planes(x.shape[1], trees) > 0).reshape(len(x), trees, BITS)
    return sides.astype(np.uint64) @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))


def _matrix(column: pa.Array) -> np.ndarray:
    """Of a list column without nulls and with lists of one length.

    Each vector is scaled by the power of two that brings its largest component under 1, which changes
    no cosine and keeps squares of very large and very small components in range.
    """
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    _, power = np.frexp(np.abs(rows).max(axis=1))
    return np.ldexp(rows, -power[:, None])


def gathered(n: int) -> int:
    return min(n, math.ceil(GATHER * n**GATHER_POWER))


class Forest:
    """Sorted strings of a sample of m out of n vectors, a row for each tree."""

    def __init__(self, sample: np.ndarray, n: int):
        self.sorted, self.n, self.m = np.sort(sample, axis=0).T.copy(), n, max(len(sample), 1)
        self.need = gathered(n) * self.m / max(n, 1) if gathered(n) < n else math.inf
        #: Leading bits that tell cells apart.
        self.cell_bits = max(0, math.ceil(math.log2(max(n, 1) / (PART / 2))))
        self.parts = {}
        for t, row in enumerate(self.sorted):
            cell, count = np.unique(row >> np.uint64(BITS - self.cell_bits), return_counts=True)
            for c, k in zip(cell.tolist(), count.tolist()):
                if (p := math.ceil(k * n / self.m / PART)) > 1:
                    self.parts[t, c] = p

    def depth(self, hashed: np.ndarray) -> np.ndarray:
        """For each query, how many leading bits to share: as many as leave enough entries over all trees."""
        low, high = np.zeros(len(hashed), int), np.full(len(hashed), BITS)
        while (low < high).any():
            mid = (low + high + 1) // 2
            shift = (BITS - mid).astype(np.uint64)
            count = np.zeros(len(hashed))
            for t, row in enumerate(self.sorted):
                first = hashed[:, t] >> shift << shift
                count += np.searchsorted(row, first + (np.uint64(1) << shift)) - np.searchsorted(row, first)
            enough = count >= self.need
            low, high = np.where(enough, mid, low), np.where(enough, high, mid - 1)
        return low


def _index_rows(forest: Forest) -> Callable:
    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            hashed = strings(_matrix(batch.column(1)))
            salt = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for t in range(TREES):
                cells = (hashed[:, t] >> np.uint64(BITS - forest.cell_bits)).astype(np.int64)
                parts = np.array([forest.parts.get((t, c), 1) for c in cells.tolist()], np.uint64)
                arrays = [np.full(len(keys), t, np.int32), cells, (salt % parts).astype(np.int32), keys, hashed[:, t].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), batch.column(1)], names=["tree", "cell", "part", "k", "h", "v"])

    return deal


def _query_rows(forest: Forest) -> Callable:
    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashed = strings(_matrix(batch.column(1)))
            depths = forest.depth(hashed)
            for i, depth in enumerate(depths.tolist()):
                rows = []
                spread = 1 << max(0, forest.cell_bits - depth)
                for t in range(TREES):
                    cell = int(hashed[i, t]) >> (BITS - forest.cell_bits)
                    first = cell // spread * spread
                    rows += [(t, c, p, int(hashed[i, t]), depth) for c in range(first, first + spread) for p in range(forest.parts.get((t, c), 1))]
                t, c, p, h, d = (np.array(x) for x in zip(*rows))
                same = np.full(len(rows), i)
                arrays = [pa.array(t, pa.int32()), pa.array(c, pa.int64()), pa.array(p, pa.int32()), batch.column(0).take(pa.array(same)), pa.array(h, pa.int64()), pa.array(d, pa.int32()), batch.column(1).take(pa.array(same))]
                yield pa.RecordBatch.from_arrays(arrays, names=["tree", "cell", "part", "q", "h", "depth", "v"])

    return deal


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _search(nearest: int) -> Callable:
    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if index.num_rows and queries.num_rows:
            h = index.column("h").to_numpy()
            order = np.argsort(h, kind="stable")
            h, keys, x = h[order], index.column("k").to_numpy()[order], _matrix(index.column("v").combine_chunks())[order]
            norms = _norms(x)
            qs, qh, depths, qx = queries.column("q").to_numpy(), queries.column("h").to_numpy(), queries.column("depth").to_numpy(), _matrix(queries.column("v").combine_chunks())
            shift = (BITS - depths).astype(np.int64)
            first = qh >> shift << shift
            low, high = np.searchsorted(h, first), np.searchsorted(h, first + ((np.int64(1) << shift) - 1), side="right")
            for q, v, norm, a, b in zip(qs, qx, _norms(qx), low.tolist(), high.tolist()):
                score = (x[a:b] * v).sum(axis=1) / (norms[a:b] * norm)
                some = np.arange(b - a)
                if b - a > nearest:
                    some = np.flatnonzero(score >= np.partition(score, b - a - nearest)[b - a - nearest])
                best = some[np.lexsort((keys[a:b][some], -score[some]))[:nearest]]
                out.append((np.full(len(best), q), keys[a:b][best], score[best]))
        q, k, s = (np.concatenate(c) for c in zip(*out)) if out else ([], [], [])
        return pa.table({"q": pa.array(q, pa.int64()), "k": pa.array(k, pa.int64()), "score": pa.array(s, pa.float64())})

    return search


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(~bad & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size(v) == (lengths["n"] if lengths else 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def nearest_neighbours(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row where is_query, a condition on the column ``id``."""
    rows = _valid(vectors, id_col, vector_col)
    place = Window.partitionBy("v").orderBy("id")
    # Of a class of copies, the k + 1 smallest ids can be in a result. Ranks up to a limit are cut before the shuffle, too.
    ranked = rows.withColumn("at", F.dense_rank().over(place)).filter(F.col("at") <= k + 1).distinct()
    members = checkpoint(ranked.withColumn("k", F.min("id").over(Window.partitionBy("v"))))
    index = members.filter("at = 1").select("k", "v").distinct()
    asked = checkpoint(rows.filter(is_query).distinct().join(index, "v").select("id", "k"))
    n = index.count()
    picked = F.pmod(F.xxhash64(F.lit(5).cast("long"), "k"), F.lit(1_000_000)) < math.ceil(min(1.0, SAMPLE / max(n, 1)) * 1_000_000)

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in strings(_matrix(batch.column(0)))], pa.binary())], names=["h"])

    sample = index.filter(picked).select("v").mapInArrow(hashes, "h binary").limit(2 * SAMPLE).toPandas()["h"]
    forest = Forest(np.frombuffer(b"".join(sample), np.uint64).reshape(-1, TREES), n)
    kind = dict(members.dtypes)["v"]
    dealt = index.mapInArrow(_index_rows(forest), f"tree int, cell long, part int, k long, h long, v {kind}")
    sent = index.join(asked.select("k").distinct(), "k", "left_semi").mapInArrow(_query_rows(forest), f"tree int, cell long, part int, q long, h long, depth int, v {kind}")
    cell = ["tree", "cell", "part"]
    found = dealt.groupBy(*cell).cogroup(sent.groupBy(*cell)).applyInArrow(_search(k + 1), "q long, k long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "k")
    found = found.groupBy("q", "k").agg(F.max("score").alias("score")).withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1)
    hits = found.join(members.select("k", F.col("id").alias("vec_id")), "k").select(F.col("q").alias("k"), "vec_id", "score")
    pairs = asked.join(hits, "k").filter("vec_id <> id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))
    pairs = pairs.groupBy("id", "vec_id").agg(F.max("score").alias("score"))
    return pairs.select(F.col("id").alias("query_id"), rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
