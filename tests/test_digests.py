"""Digests of series: equal whatever the partitions, unequal for any change, and the place where two part."""

import hashlib
import random

import pytest

from tidemark.operators import digests as G
from tidemark.plans import digests as plan


def text(*values):
    return "".join("-" if v is None else f"{len(str(v))}:{v}" for v in values)


def plain(rows, chunk, fan):
    """The digest of rows (order, values...) by loops: equal rows stand once with their number, at the place of the first."""
    rows = sorted((r[0], text(*r[1:])) for r in rows)
    chunks, i = {}, 0
    while i < len(rows):
        n = rows.count(rows[i])
        chunks.setdefault(i // chunk, []).append(f"{rows[i][1]}*{n}")
        i += n
    level = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in chunks.items()}
    while any(k > 0 for k in level):
        up = {}
        for k in sorted(level):
            up.setdefault(k // fan, []).append(level[k])
        level = {k: hashlib.sha256("".join(v).encode()).hexdigest() for k, v in up.items()}
    return level[0]


SCHEMA = "k string, t int, a string, b double"


def series(seed, n, k="x"):
    rng = random.Random(seed)
    return [(k, rng.randrange(n), rng.choice(["p", "q", "", None]), rng.choice([1.5, None, 2.0])) for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_equal_under_any_partitions(spark, parts):
    rows = series(1, 300, "x") + series(2, 90, "y") + [("z", 1, "a", 1.0)] * 40 + series(3, 5, None)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(min(parts, 8)))
    try:
        got = {r.k: (r.rows, r.digest) for r in G.series_digest(df, ["k"], "t", ["a", "b"], 16, 3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k in ("x", "y", "z", None):
        own = [r[1:] for r in rows if r[0] == k]
        assert got[k] == (len(own), plain(own, 16, 3))


def test_any_change_changes_it_and_is_found(spark):
    rows = [("x", i // 2, f"v{i}", float(i)) for i in range(100)] + [("y", i, "same", 1.0) for i in range(30)] + [("r", 5, "dup", 1.0)] * 3
    a = spark.createDataFrame(rows, SCHEMA)
    cases = {
        "changed": [r if r[2] != "v70" else ("x", 35, "w", 1.0) for r in rows], "dropped": [r for r in rows if r[2] != "v99"], "added": [*rows, ("x", 99, "late", 1.0)],
        "null": [r if r[2] != "v10" else ("x", 5, "v10", None) for r in rows], "once more": [*rows, ("r", 5, "dup", 1.0)],
    }
    for name, other in cases.items():
        b = spark.createDataFrame(other, SCHEMA)
        got = {r.k: (r.place, r.left, r.right) for r in G.first_difference(a, b, ["k"], "t", ["a", "b"], 8).collect()}
        want = {}
        for k in "xyr":
            l, r = (sorted((x[1], text(*x[2:])) for x in rs if x[0] == k) for rs in (rows, other))
            at = next((i for i in range(max(len(l), len(r))) if l[i : i + 1] != r[i : i + 1]), None)
            if at is not None:
                want[k] = (at, l[at][1] if at < len(l) else None, r[at][1] if at < len(r) else None)
        assert got == want, name
        same = {r.k: r.digest for r in G.series_digest(a, ["k"], "t", ["a", "b"], 8, 2).collect()}
        assert {r.k for r in G.series_digest(b, ["k"], "t", ["a", "b"], 8, 2).collect() if same[r.k] != r.digest} == set(want)
    assert G.series_digest(a.limit(0), ["k"], "t", ["a"]).count() == 0 == G.first_difference(a, a, ["k"], "t", ["a", "b"]).count()


def test_series_digest_against_a_loop(spark, sf):
    rows = {}
    for r in plan._events(spark, sf).collect():
        rows.setdefault(r.event_type, []).append((r.us, r.user_id, r.cents))
    got = {r.event_type: (r.rows, r.digest) for r in plan.series_digest(spark, sf).collect()}
    assert got == {k: (len(v), plain(v, plan.CHUNK, plan.FAN)) for k, v in rows.items()} and len(got) > 1
