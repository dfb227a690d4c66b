"""Digests of long ordered series: one hash that says whether two are equal, and where they part if not.

A series is cut into chunks of ``CHUNK`` rows by place, each chunk is hashed, and the hashes are hashed again
in runs of ``FAN`` until one is left. Places come from counts by range, so that a series of any length is
spread over tasks and its hash does not depend on how; a task hashes a chunk at a time. Equal rows are
counted and stand once. Two series are compared by their chunks, and only the first chunk that differs is
looked into.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .ranks import running_before

CHUNK, FAN = 4096, 1024


def row_text(columns: Sequence[str]) -> Column:
    """The columns as one text that tells nulls from empty and where each ends."""
    return F.concat(*[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns])


def _placed(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """(keys, o struct of order and text, n equal rows, n_before): different rows in order, with the rows before each."""
    rows = df.select(*keys, F.struct(F.col(order).alias("at"), row_text(columns).alias("text")).alias("o"))
    return running_before(rows.groupBy(*keys, "o").agg(F.count("*").alias("n")), keys, "o", ["n"])


def chunk_digests(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """(keys, chunk, rows, first, digest) of each chunk; first is the order of its first row."""
    placed = _placed(df, keys, order, columns).withColumn("chunk", F.floor(F.col("n_before") / chunk))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_before", "o.text", "n"))), lambda r: F.concat(r["text"], F.lit("*"), r["n"].cast("string"))), "\n")
    return placed.groupBy(*keys, "chunk").agg(F.sum("n").alias("rows"), F.min("o.at").alias("first"), F.sha2(text, 256).alias("digest"))


def series_digest(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(keys, rows, digest): one for each series of df, over columns in order; ties of order are put in order of their text, and null keys are series."""
    safe = [f"__k{i}" for i in range(len(keys))]
    named = df.withColumns({s: F.struct(F.col(k).alias("v")) for s, k in zip(safe, keys)})  # nulls are equal in a struct
    now = cut(chunk_digests(named, safe, order, columns, chunk).select(*safe, F.col("chunk").alias("i"), "rows", "digest"))
    done = now.limit(0)
    while True:  # a series that has one digest left is done, however long others are
        top = now.groupBy(*safe).agg(F.max("i").alias("__top"))
        at = cut(now.join(top, safe))
        done = done.unionByName(at.filter("__top = 0").drop("__top"))
        more = at.filter("__top > 0")
        if more.isEmpty():
            break
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "digest"))), lambda d: d["digest"]), "")
        # A chunk of many equal rows leaves places without a chunk; runs are by place, so that this does not matter.
        now = cut(more.groupBy(*safe, F.floor(F.col("i") / fan).alias("i")).agg(F.sum("rows").alias("rows"), F.sha2(text, 256).alias("digest")))
    now = done
    return now.select(*[F.col(f"{s}.v").alias(k) for s, k in zip(safe, keys)], "rows", "digest")


def first_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """(keys, place, left, right): for each series that differs, the first place (from 0) at which it does and the rows' texts; NULL where one has ended.

    Series of equal rows are not in the result. Keys are not null.
    """
    sides = [_placed(df, keys, order, columns).withColumn("chunk", F.floor(F.col("n_before") / chunk)) for df in (a, b)]
    sides = [cut(s) for s in sides]
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_before", "o.text", "n"))), lambda r: F.concat(r["text"], F.lit("*"), r["n"].cast("string"))), "\n")
    hashed = [s.groupBy(*keys, "chunk").agg(F.sha2(text, 256).alias("digest")) for s in sides]
    both = hashed[0].withColumnRenamed("digest", "l").join(hashed[1].withColumnRenamed("digest", "r"), [*keys, "chunk"], "full_outer")
    where = cut(both.filter(~F.col("l").eqNullSafe(F.col("r"))).groupBy(*keys).agg(F.min("chunk").alias("chunk")))
    rows = [s.join(where, [*keys, "chunk"]).select(*keys, "n_before", F.struct("o.text", "n").alias(side)) for s, side in zip(sides, ("left", "right"))]
    met = rows[0].join(rows[1], [*keys, "n_before"], "full_outer").filter(~F.col("left").eqNullSafe(F.col("right")))
    first = met.groupBy(*keys).agg(F.min_by(F.struct(F.col("n_before").alias("place"), "left", "right"), "n_before").alias("d"))
    # Rows that are equal but for how often they stand part where the fewer end.
    l, r = F.col("d.left"), F.col("d.right")
    same = F.coalesce(l["text"] == r["text"], F.lit(False))
    place = F.col("d.place") + F.when(same, F.least(l["n"], r["n"])).otherwise(0)
    return first.select(*keys, place.alias("place"), F.when(~same | (l["n"] > r["n"]), l["text"]).alias("left"), F.when(~same | (r["n"] > l["n"]), r["text"]).alias("right"))
