"""Hard negatives by a Voronoi-partitioned nearest-neighbour join.

Inner products become distances: each vector gets one more component, sqrt(M^2 - |x|^2) with M the
largest norm, and an anchor gets zero there; then the larger the product, the nearer the vector. Pivots
are rows of a bounded sample. Every row lies in the cell of its nearest pivot, at a known distance of it,
and anchors are grouped by neighbouring cells. A score that an anchor must at least reach (its k-th best
in the sample, which the whole table can only raise) is a radius around it; by the triangle inequality
only a ring of each cell can lie in it, and the rings of a group's anchors together say which rows the
group might be served by. Those rows are sent to the group, dealt over parts of bounded size, and joined
there exactly; the best of each part meet in a rank by anchor.

There are two such joins: the first gives the positives, of the anchor's own label, without an upper
bound; the second the negatives, of other labels, in a window of scores that the positives set, so that
rings have an inner edge, too. All scores are exact integers, rings are widened by more than rounding can
move them, and no candidate is ever cut: results are those of comparing all pairs.

Bounds: the driver holds the sample (``MOST_SAMPLED`` rows), a count for each cell, and a ring for each
cell and group. A task of the joins holds ``PART_VALUES`` numbers of rows and ``GROUP_VALUES`` of
anchors, whatever cell, label or group of copies they come from. Vectors without any structure (many
dimensions, no clusters) leave rings wide, and every row goes to every group: then the work is anchors
times rows, as a matrix product.

Defined cases: rows with a null id or label, a null vector, null or non-finite components, or of another
length than most take no part; ids and labels are whole numbers; rows that share an id count as one, the
one with the smallest label and vector; a row is never its own positive; equal scores are ordered by the
smaller id; anchors without another row of their label have no positives, and positives whose window
holds nothing have no negatives; windows of negative scores are empty; components of 2**19 and more, or
a squared norm of 2**55 and more, are an error; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import finite, ints, products, whole

POSITIVES, NEGATIVES = 5, 10
#: Lower and upper share of a positive's score, in hundredths.
WINDOW = (30, 90)
LEAST_SAMPLED, MOST_SAMPLED = 2048, 32_768
MOST_PIVOTS = 512
#: Numbers (rows times components) that a part holds, and a group of anchors.
PART_VALUES, GROUP_VALUES = 1 << 22, 1 << 20
#: At least so many groups and parts, so that small tables are spread, too.
GROUPS, PARTS = 4, 8
_NONE = -(1 << 62)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    some = np.arange(len(score))
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def _window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of a negative, for positives' scores."""
    low, high = WINDOW
    return -(-low * positive // 100), high * positive // 100


class Plane:
    """Pivots, the sample, and the geometry of the augmented vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, rows: int, norm2: float):
        order = np.argsort(ids)
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.dim, self.norm2 = x.shape[1], norm2
        n = min(len(x), max(4, min(MOST_PIVOTS, round(math.sqrt(rows) / 4))))
        picked = np.random.default_rng(13).permutation(len(x))[:n]
        self.pivots = self.x[picked].astype(np.float64)
        self.added = self._added(self.pivots)
        #: More than rounding moves a distance: squares are right to some 2**-50 of norm2.
        self.slack = 1e-6 * math.sqrt(norm2) + 1e-9

    def _added(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0.0))

    def _distances(self, x: np.ndarray, added: np.ndarray) -> np.ndarray:
        square = (x * x).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * (x @ self.pivots.T) + (added[:, None] - self.added) ** 2
        return np.sqrt(np.maximum(square, 0.0))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows: the nearest pivot and the distance to it."""
        d = self._distances(x.astype(np.float64), self._added(x.astype(np.float64)))
        at = d.argmin(axis=1)
        return at, d[np.arange(len(x)), at]

    def from_anchors(self, x: np.ndarray) -> np.ndarray:
        return self._distances(x.astype(np.float64), np.zeros(len(x)))

    def radius(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance from each anchor at which a row has the score; infinite where there is none."""
        square = (x.astype(np.float64) ** 2).sum(axis=1) + self.norm2 - 2.0 * score
        return np.where(score == _NONE, np.inf, np.sqrt(np.maximum(square, 0.0)))

    def rings(self, x: np.ndarray, low: np.ndarray, high: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, cells) least and largest distance to its pivot at which a row can serve an anchor that asks for scores from low to high."""
        d, far = self.from_anchors(x), self.radius(x, low)[:, None]
        near = 0.0 if high is None else self.radius(x, high)[:, None]
        return np.maximum(np.maximum(d - far, near - d), 0.0) - self.slack, d + far + self.slack

    def chain(self) -> list[int]:
        """The pivots in an order in which each is followed by its nearest that is left."""
        left, order = set(range(len(self.pivots))), [0]
        left.discard(0)
        while left:
            rest = np.array(sorted(left))
            gap = ((self.pivots[rest] - self.pivots[order[-1]]) ** 2).sum(axis=1) + (self.added[rest] - self.added[order[-1]]) ** 2
            order.append(int(rest[gap.argmin()]))
            left.discard(order[-1])
        return order


def _rows(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, x) of the rows that take part, ids possibly repeated."""
    v = F.col(vector_col)
    rows = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite(v) & (F.size(v) > 0))
    lengths = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = lengths["n"] if lengths else 0
    return rows.filter(F.size(v) == dim).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole(v).alias("x"))


def _one_per_id(rows: DataFrame) -> DataFrame:
    """Only ids that a count finds twice are regrouped; it moves ids, not vectors."""
    repeated = written(rows.groupBy("id").count().filter("count > 1").select("id"), "repeated")
    if repeated.isEmpty():
        return rows
    one = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x")
    return rows.join(repeated, "id", "left_anti").select("id", "label", "x").unionByName(one)


def _place(plane: Plane) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, r = plane.cells(ints(batch.column("x"), plane.dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(r)], names=["id", "label", "x", "cell", "r"])

    return run


def _first_bounds(plane: Plane) -> Callable:
    """Adds to anchors (id, label, x) their cell and the least score of a positive."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels = (batch.column(c).to_numpy() for c in ("id", "label"))
            x = ints(batch.column("x"), plane.dim)
            low = np.full(len(x), _NONE, np.int64)
            for i, score in enumerate(products(x, plane.x)):
                own = score[(plane.labels == labels[i]) & (plane.ids != ids[i])]
                if len(own) >= POSITIVES:
                    low[i] = np.partition(own, len(own) - POSITIVES)[len(own) - POSITIVES]
            cell = plane.from_anchors(x).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "x")), pa.array(cell, pa.int32()), pa.array(low)], names=["id", "label", "x", "cell", "low"])

    return run


def _second_bounds(plane: Plane) -> Callable:
    """Turns the positives' scores ps of anchors into the windows (lows, highs) of their negatives; a low is raised to the k-th best of the sample."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels = (batch.column(c).to_numpy() for c in ("id", "label"))
            x, lows, highs = ints(batch.column("x"), plane.dim), [], []
            for i, (score, ps) in enumerate(zip(products(x, plane.x), batch.column("ps").to_pylist())):
                other = score[(plane.labels != labels[i]) & (plane.ids != ids[i])]
                low, high = _window(np.array(ps, np.int64))
                for j in range(len(ps)):
                    under = other[(other >= low[j]) & (other <= high[j])]
                    if len(under) >= NEGATIVES:
                        low[j] = np.partition(under, len(under) - NEGATIVES)[len(under) - NEGATIVES]
                lows.append(low), highs.append(high)
            added = [pa.array(v, pa.list_(pa.int64())) for v in (lows, highs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "x", "grp", "pids", "ps")), *added], names=["id", "label", "x", "grp", "pids", "ps", "lows", "highs"])

    return run


def _groups(plane: Plane, counts: dict[int, int]) -> tuple[dict[int, tuple[int, int]], int]:
    """For each cell with anchors, its first group and over how many its anchors are dealt; and the number of groups."""
    total = sum(counts.values())
    size = max(1, min(GROUP_VALUES // plane.dim, math.ceil(total / GROUPS)))
    first, at, held = {}, 0, 0
    for cell in plane.chain():
        n = counts.get(cell, 0)
        if not n:
            continue
        if held and held + n > size:
            at, held = at + 1, 0
        spread = math.ceil(n / size)
        first[cell] = (at, spread)
        at, held = (at + spread, 0) if spread > 1 else (at, held + n)
    return first, at + 1


def _rings(plane: Plane, groups: int) -> Callable:
    """(grp, cell, low, high): the ring of each cell that anchors (grp, x, low, high) of a task might be served by."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, outer = np.full((groups, len(plane.pivots)), np.inf), np.full((groups, len(plane.pivots)), -np.inf)
        for batch in batches:
            if batch.num_rows:
                x, g = ints(batch.column("x"), plane.dim), batch.column("grp").to_numpy()
                high = batch.column("high")
                a, b = plane.rings(x, batch.column("low").to_numpy(), None if high.null_count else high.to_numpy())
                some = a <= b
                np.minimum.at(inner, g, np.where(some, a, np.inf))
                np.maximum.at(outer, g, np.where(some, b, -np.inf))
        g, c = np.nonzero(inner <= outer)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(c, pa.int32()), pa.array(inner[g, c]), pa.array(outer[g, c])], names=["grp", "cell", "low", "high"])

    return run


def _mix(ids: np.ndarray) -> np.ndarray:
    """Hashes of ids that deal evenly."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def _deal(inner: np.ndarray, outer: np.ndarray, parts: np.ndarray) -> Callable:
    """A copy of each row for each group that it might serve, with a part of the group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, r = (batch.column(c).to_numpy() for c in ("cell", "r"))
            for g in range(len(parts)):
                some = np.flatnonzero((inner[g, cell] <= r) & (r <= outer[g, cell]))
                if len(some):
                    kept = batch.take(pa.array(some))
                    part = _mix(kept.column("id").to_numpy()) % np.uint64(parts[g])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), g), pa.int32()), pa.array(part.astype(np.int32)), *(kept.column(c) for c in ("id", "label", "x"))], names=["grp", "part", "id", "label", "x"])

    return run


def _sides(rows: pa.Table, anchors: pa.Table, dim: int):
    return (rows.column("id").to_numpy(), rows.column("label").to_numpy(), ints(rows.column("x").combine_chunks(), dim)), (anchors.column("id").to_numpy(), anchors.column("label").to_numpy(), ints(anchors.column("x").combine_chunks(), dim))


#: Anchors whose products with a part are held at a time.
_AT_ONCE = 64


def _join_positives(dim: int) -> Callable:
    def join(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            (ids, labels, x), (aid, alabel, ax) = _sides(rows, anchors, dim)
            low = anchors.column("low").to_numpy()
            for label in np.intersect1d(labels, alabel):
                some, asked = np.flatnonzero(labels == label), np.flatnonzero(alabel == label)
                y, yid = x[some], ids[some]
                for at in range(0, len(asked), _AT_ONCE):
                    for i, score in zip(asked[at : at + _AT_ONCE], products(ax[asked[at : at + _AT_ONCE]], y)):
                        hit = np.flatnonzero((score >= low[i]) & (yid != aid[i]))
                        hit = hit[_best(score[hit], yid[hit], POSITIVES)]
                        out.append((np.full(len(hit), aid[i]), yid[hit], score[hit]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("id", "pid", "p"), columns)})

    return join


def _join_negatives(dim: int) -> Callable:
    def join(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            (ids, labels, x), (aid, alabel, ax) = _sides(rows, anchors, dim)
            asked = [anchors.column(c).to_pylist() for c in ("pids", "ps", "lows", "highs")]
            for at in range(0, len(aid), _AT_ONCE):
                for i, score in enumerate(products(ax[at : at + _AT_ONCE], x), at):
                    windows = [w for w in zip(*(a[i] for a in asked)) if w[2] <= w[3]]
                    if not windows:
                        continue
                    wide = np.flatnonzero((score >= min(w[2] for w in windows)) & (score <= max(w[3] for w in windows)) & (labels != alabel[i]))
                    s, k = score[wide], ids[wide]
                    for pid, p, low, high in windows:
                        hit = np.flatnonzero((s >= low) & (s <= high))
                        hit = hit[_best(s[hit], k[hit], NEGATIVES)]
                        out.append((np.full(len(hit), aid[i]), np.full(len(hit), pid), np.full(len(hit), p), k[hit], s[hit]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), columns)})

    return join


def _served(plane: Plane, placed: DataFrame, per_cell: np.ndarray, anchors: DataFrame, groups: int) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors (with grp, low and high, the scores that they ask for), both dealt by (grp, part)."""
    rings = anchors.select("grp", "x", "low", "high").mapInArrow(_rings(plane, groups), "grp int, cell int, low double, high double")
    inner, outer = np.full((groups, len(per_cell)), np.inf), np.full((groups, len(per_cell)), -np.inf)
    for r in rings.groupBy("grp", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        inner[r["grp"], r["cell"]], outer[r["grp"], r["cell"]] = r["low"], r["high"]
    rows = ((inner <= outer) * per_cell).sum(axis=1)
    parts = np.maximum(PARTS, np.ceil(rows / max(1, PART_VALUES // plane.dim))).astype(np.int64)
    dealt = placed.mapInArrow(_deal(inner, outer, parts), "grp int, part int, id long, label long, x array<int>")
    wide = F.get(F.array(*[F.lit(int(p)) for p in parts]), F.col("grp"))
    sent = anchors.drop("low", "high") if "lows" in anchors.columns else anchors.drop("high")
    return dealt, sent.withColumn("part", F.explode(F.sequence(F.lit(0), (wide - 1).cast("int"))))


def hard_negatives(vectors: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where is_anchor, a condition on the column ``id``."""
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = vectors.sparkSession
    rows = _one_per_id(written(_rows(vectors, id_col, label_col, vector_col), "rows"))
    norm2 = F.aggregate("x", F.lit(0.0), lambda a, e: a + e.cast("double") * e)
    told = rows.agg(F.count("*").alias("n"), F.max(norm2).alias("m"), F.max(F.size("x")).alias("dim")).first()
    if not told["n"]:
        return spark.createDataFrame([], schema)
    if told["m"] >= 2.0**55:
        raise ArithmeticError("products of these vectors are too large for exact windows")
    wanted = min(MOST_SAMPLED, max(LEAST_SAMPLED, told["n"] // 16))
    picked = F.pmod(F.xxhash64(F.lit(13).cast("long"), "id"), F.lit(1_000_000)) < math.ceil(min(1.0, wanted / told["n"]) * 1_000_000)
    sample = rows.filter(picked).limit(2 * MOST_SAMPLED).toArrow()
    if not sample.num_rows:
        sample = rows.limit(1).toArrow()
    plane = Plane(sample.column("id").to_numpy(), sample.column("label").to_numpy(), ints(sample.column("x").combine_chunks(), told["dim"]), told["n"], told["m"])
    placed = written(rows.mapInArrow(_place(plane), "id long, label long, x array<int>, cell int, r double"), "placed")
    per_cell = np.zeros(len(plane.pivots), np.int64)
    for r in placed.groupBy("cell").count().collect():
        per_cell[r["cell"]] = r["count"]
    found = placed.filter(is_anchor).select("id", "label", "x").mapInArrow(_first_bounds(plane), "id long, label long, x array<int>, cell int, low long")
    anchors = written(found, "anchors")
    first, groups = _groups(plane, dict(anchors.groupBy("cell").count().collect()))
    by_cell = [first.get(c, (0, 1)) for c in range(len(plane.pivots))]
    at, spread = (F.get(F.array(*[F.lit(v[i]) for v in by_cell]), F.col("cell")) for i in (0, 1))
    anchors = anchors.withColumn("grp", (at + F.pmod(F.xxhash64("id"), spread)).cast("int"))
    key = ["grp", "part"]

    dealt, sent = _served(plane, placed, per_cell, anchors.select("id", "label", "x", "grp", "low", F.lit(None).cast("long").alias("high")), groups)
    near = dealt.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_join_positives(plane.dim), "id long, pid long, p long")
    best = Window.partitionBy("id").orderBy(F.desc("p"), "pid")
    near = near.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= POSITIVES)
    near = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "pid", "p"))).alias("of"))
    near = near.select("id", F.col("of.pid").alias("pids"), F.col("of.p").alias("ps"))

    bounds = "id long, label long, x array<int>, grp int, pids array<long>, ps array<long>, lows array<long>, highs array<long>"
    asked = written(anchors.select("id", "label", "x", "grp").join(near, "id").mapInArrow(_second_bounds(plane), bounds), "windows")
    some = F.filter(F.arrays_zip("lows", "highs"), lambda w: w["lows"] <= w["highs"])
    asked = asked.withColumn("some", some).filter(F.size("some") > 0).withColumns({"low": F.array_min("some.lows"), "high": F.array_max("some.highs")}).drop("some")
    dealt, sent = _served(plane, placed, per_cell, asked, groups)
    found = dealt.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_join_negatives(plane.dim), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
