"""Near-duplicate vectors by sorted projection passes.

A vector's sketch has a bit for each of 256 random hyperplanes. In a pass, vectors are ordered by a
string of 63 of these bits, another choice and order of bits for each pass, and every vector is
compared with the ``WINDOW`` next ones in that order by the bits in which their sketches differ. Likely
pairs of all passes are united, and their cosines, taken from the vectors themselves, decide. The
number of passes follows from the number of vectors (``passes``): a pair at exactly the wanted cosine
meets in at least one window with probability ``RECALL``; nearer pairs do so more surely.

A run of near copies in the order does not become all its pairs. Each vector points at the first one
of its window that is closer than half the wanted angle, pointers are followed to a root, and pairs
within a root's run are left out: what the passes give has to connect what belongs together, and no
more. The links themselves are counted per component, with exact cosines of all its members:

* within a component, vectors closer than half the wanted angle to the component's hub form a ball, in
  which, by the triangle inequality, all are linked with each other: they are counted, not compared;
* all other pairs of a component are compared in blocks, and only the counts of each vector leave a
  task. So no link within a component is missed, whatever the window is.

Equal vectors are one class from the beginning, counted by its rows. Groups of near copies of any size
cost a product with their hub each; a component that is large and not a ball, such as a long chain of
neighbours, costs the square of what lies outside its ball, dealt over tasks by pairs of blocks.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing
and are their own component; vectors of different lengths have no cosine and do not link; repeated
rows, and rows that share an id, are vectors of their own; rows with a null id link like others, have
a component by the ids beside them (null if there is none) and are kept only if that is null; components may have any finite
size; ids keep their type; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_rank, join_counted, written
from .components import connected_components
from .vectors import finite, reals

COSINE = 0.95
#: Bits of a sketch, bits of a pass's string, vectors that each is compared with on either side, and the chance of a pair at COSINE to be met.
BITS, STRING, WINDOW, RECALL = 256, 63, 64, 0.98
#: Rows of a pass that a task compares at a time, and vectors of a block whose cosines are taken at a time.
RUN, BLOCK = 4096, 1024
#: Components up to this size are packed together, so that small ones do not make a task's group each.
SMALL = 256


def _flips(cosine: float) -> float:
    """The chance that a bit of two vectors at a cosine differs."""
    return math.acos(cosine) / math.pi


def passes(n: int, cosine: float = COSINE) -> int:
    """As many as make a pair at the cosine share a prefix that only a window's vectors have, in one of them, with probability RECALL."""
    shared = max(0.0, math.log2(max(n, 1) / WINDOW)) + 1
    once = (1 - _flips(cosine)) ** shared
    return max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - once)))


def likely(cosine: float) -> int:
    """Differing bits that a pair at the cosine exceeds once in 10,000 times."""
    p = _flips(cosine)
    return math.ceil(BITS * p + 3.8 * math.sqrt(BITS * p * (1 - p)))


def half(cosine: float) -> float:
    """The cosine of half the angle, less what rounding can move."""
    return math.sqrt((1 + cosine) / 2) + 1e-9


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, sketch) of (class, vector); planes are drawn for each length."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = batch.column(1).value_lengths().to_numpy()
        for dim in np.unique(sizes).tolist():
            some = batch.filter(pa.array(sizes == dim))
            if dim not in planes:
                planes[dim] = np.random.default_rng((12, dim)).standard_normal((dim, BITS))
            bits = np.packbits(reals(some.column(1)) @ planes[dim] > 0, axis=1)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(bits), dim), pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary())], names=["c", "dim", "sketch"])


def _strings(count: int) -> Callable:
    """A row for each pass of (c, dim, sketch), with the string as a number."""
    orders = [np.random.default_rng((120, i)).permutation(BITS)[:STRING] for i in range(count)]
    worth = np.uint64(1) << np.arange(STRING - 1, -1, -1, dtype=np.uint64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = np.unpackbits(_bytes(batch.column(2)), axis=1)
                for i, order in enumerate(orders):
                    string = (bits[:, order].astype(np.uint64) @ worth).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), i), pa.int32()), batch.column(1), pa.array(string), batch.column(0), batch.column(2)], names=["pass", "dim", "string", "c", "sketch"])

    return run


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BITS // 8)


def roots(pointer: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Pointers (to an earlier place or oneself) followed as long as a row stays near what it reaches."""
    root = pointer.copy()
    while True:
        farther = root[root]
        step = (farther != root) & near(np.arange(len(root)), farther)
        if not step.any():
            return root
        root = np.where(step, farther, root)


def _windows(pair_bits: int, ball_bits: int) -> Callable:
    """Likely pairs of a run of RUN rows and the WINDOW rows after it, in order of place."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        c, dim, kind = (table.column(n).to_numpy() for n in ("c", "dim", "pass"))
        words = _bytes(table.column("sketch").combine_chunks()).view(np.uint64)
        n = len(c)

        def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            d = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
            return np.where((dim[a] == dim[b]) & (kind[a] == kind[b]), d, BITS + 1)

        pointer, a, b = np.arange(n), [], []
        for step in range(min(WINDOW, n - 1), 0, -1):  # the farthest first, so that the first of the window is what remains
            left = np.arange(n - step)
            bits = differing(left, left + step)
            some = left[bits <= pair_bits]
            a.append(some), b.append(some + step)
            close = left[bits <= ball_bits] + step
            pointer[close] = np.minimum(pointer[close], close - step)
        root = roots(pointer, lambda x, y: differing(x, y) <= ball_bits)
        a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
        apart = root[a] != root[b]
        ends = np.flatnonzero(root != np.arange(n))
        a, b = np.concatenate([a[apart], root[ends]]), np.concatenate([b[apart], ends])
        return pa.table({"a": pa.array(np.minimum(c[a], c[b]), pa.int64()), "b": pa.array(np.maximum(c[a], c[b]), pa.int64())})

    return run


def _cosines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, cosine) of (a, b, v, w), vectors of one length in a row."""
    for batch in batches:
        sizes = batch.column(2).value_lengths().to_numpy()
        for dim in np.unique(sizes).tolist():
            some = batch.filter(pa.array(sizes == dim))
            x, y = reals(some.column(2)), reals(some.column(3))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array((x * y).sum(axis=1) / (_norms(x) * _norms(y)))], names=["a", "b", "cosine"])


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _with_cosine(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs (a, b). An end that very many pairs have is joined by broadcast."""
    ends = pairs.groupBy("b").agg(F.count("*").alias("pairs"))
    other = ends.join(classes.select(F.col("c").alias("b"), F.col("v").alias("w")), "b")
    both = join_counted(pairs, other, "b", "pairs", pairs.count()).join(classes.select(F.col("c").alias("a"), "v"), "a")
    return both.select("a", "b", "v", "w").mapInArrow(_cosines, "a long, b long, cosine double")


def likely_pairs(classes: DataFrame, n: int, cosine: float) -> DataFrame:
    """(a, b), a < b: pairs of classes (c, v) that windows of the passes give, enough to connect what belongs together."""
    sketched = classes.select("c", "v").mapInArrow(_sketches, "c long, dim int, sketch binary")
    rows = sketched.mapInArrow(_strings(passes(n, cosine)), "pass int, dim int, string long, c long, sketch binary")
    placed = global_rank(rows, [F.col(k) for k in ("pass", "dim", "string", "c")], "place")
    run = F.floor(F.col("place") / RUN)
    reaches = F.when((F.col("place") % RUN < WINDOW) & (run > 0), F.array(run, run - 1)).otherwise(F.array(run))
    runs = placed.select("place", "pass", "dim", "c", "sketch", F.explode(reaches).alias("run"))
    return runs.groupBy("run").applyInArrow(_windows(likely(cosine), math.ceil(BITS * _flips(half(cosine)) * 1.4)), "a long, b long").distinct()


def _block_counts(cosine: float) -> Callable:
    """(c, linked): rows that each vector is linked with, by the pairs of this group's two blocks, for each component in it."""

    def run(table: pa.Table) -> pa.Table:
        comp, side, c, rows = (table.column(n).to_numpy() for n in ("comp", "side", "c", "n"))
        out_c, out_n = [], []
        order = np.lexsort((c, side, comp))
        vectors = table.column("v").combine_chunks()
        for some in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):  # a component's vectors have one length
            x = reals(vectors.take(pa.array(some)))
            x /= _norms(x)[:, None]
            at, n, who = side[some], rows[some], c[some]
            left, right = at <= 0, at >= 0  # side 0: a block with itself
            near = (x[left] @ x[right].T >= cosine) & (who[left][:, None] != who[right])
            out_c.append(who[left]), out_n.append(near @ n[right])
            if at.any():
                out_c.append(who[right]), out_n.append(near.T @ n[left])
        return pa.table({"c": pa.array(np.concatenate(out_c), pa.int64()), "linked": pa.array(np.concatenate(out_n), pa.int64())})

    return run


def _link_counts(members: DataFrame, classes: int, cosine: float) -> DataFrame:
    """(c, linked): rows of other classes that each class of members (comp, of, outside, c, n, v, ball) is linked with, but for pairs within a ball.

    Vectors outside the ball are blocks that meet each other and those of the ball; blocks of the ball do not meet.
    """
    def blocks(rows):
        return F.greatest(F.lit(1), F.ceil(rows / BLOCK)).cast("int")

    outer, inner = blocks(F.col("outside")), blocks(F.col("of") - F.col("outside"))
    own = F.when(F.col("ball"), outer + F.pmod(F.xxhash64("c"), inner)).otherwise(F.pmod(F.xxhash64("c"), outer)).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("ball"), outer - 1).otherwise(outer + inner - 1))
    met = F.transform(others, lambda o: F.struct(F.least("own", o).alias("one"), F.greatest("own", o).alias("two"), F.when(o == F.col("own"), 0).when(F.col("own") < o, -1).otherwise(1).alias("side")))
    bins = max(64, classes // 4096)
    bin_ = F.when(F.col("of") <= SMALL, F.pmod(F.xxhash64(F.lit(1).cast("long"), "comp"), F.lit(bins))).otherwise(F.col("comp") + bins)
    dealt = members.withColumn("own", own).select("comp", "c", "n", "v", bin_.alias("bin"), F.explode(met).alias("m")).select("bin", "m.*", "comp", "c", "n", "v")
    counted = dealt.groupBy("bin", "one", "two").applyInArrow(_block_counts(cosine), "c long, linked long")
    return counted.groupBy("c").agg(F.sum("linked").alias("linked"))


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) of each row."""
    v = F.col(vector_col)
    good = F.coalesce(finite(v) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(good, v).alias("v"))
    grouped = rows.filter("v is not null").groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("c"), "v", "first", "n"), "classes")
    n, total = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    pairs = written(_with_cosine(written(likely_pairs(classes, n, cosine), "pairs"), classes).filter(F.col("cosine") >= cosine), "links")
    edges = connected_components(pairs.select("a", "b"))
    nodes = edges.select("a", "b").unionByName(edges.select("b", "b").distinct().toDF("a", "b")).select(F.col("a").alias("c"), F.col("b").alias("comp"))
    sizes = nodes.groupBy("comp").agg(F.count("*").alias("size"))
    nodes = written(join_counted(nodes, sizes, "comp", "size", n).select("c", "comp", "size"), "nodes")

    # The hub of a component: the vector with the most links found. Those within half the angle of it are its ball.
    found = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).groupBy("c").agg(F.count("*").alias("found"))
    hubs = nodes.join(found, "c").groupBy("comp").agg(F.max_by("c", F.struct("found", "c")).alias("hub"), F.first("size").alias("size"))
    to_hub = join_counted(nodes.select("c", "comp"), hubs, "comp", "size", n).filter("c <> hub").select(F.col("c").alias("a"), F.col("hub").alias("b"))
    in_ball = _with_cosine(written(to_hub, "to_hub"), classes).filter(F.col("cosine") >= half(cosine)).select(F.col("a").alias("c"))
    in_ball = written(in_ball.unionByName(hubs.select(F.col("hub").alias("c"))).withColumn("ball", F.lit(True)), "ball")
    described = nodes.join(in_ball, "c", "left").withColumn("ball", F.coalesce("ball", F.lit(False))).join(classes.select("c", "n", "first"), "c")
    per = described.groupBy("comp").agg(F.min("first").alias("component"), F.sum(F.when(F.col("ball"), F.col("n")).otherwise(0)).alias("in_ball"), F.count_if(~F.col("ball")).alias("outside"), F.count("*").alias("of"))
    members = written(join_counted(described, per, "comp", "of", n), "members")
    # A component that is one ball needs no comparison.
    compared = _link_counts(members.filter("outside > 0").join(classes.select("c", "v"), "c"), n, cosine)
    linked = members.join(compared, "c", "left").select("c", "component", (F.coalesce("linked", F.lit(0)) + F.when(F.col("ball"), F.col("in_ball") - F.col("n")).otherwise(0)).alias("linked"))
    told = classes.select("c", "v", "n", "first").join(linked, "c", "left")
    told = told.select("v", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("component").isNull() & F.col("linked").isNull(), F.col("first")).otherwise(F.col("component")).alias("component_id"), "n")
    out = join_counted(rows.filter("v is not null"), told, "v", "n", total).select("id", "n_links", "component_id")
    out = out.unionByName(rows.filter("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
