"""Queries of digests: the events of a kind are one long series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import digests as G
from ..sources.tables import table
from .registry import query

CHUNK, FAN = 128, 4
TEXT = "coalesce(length(user_id :: VARCHAR) || ':' || user_id, '-') || coalesce(length(cents :: VARCHAR) || ':' || cents, '-')"
ROWS = "e AS (SELECT event_type, epoch_us(ts) AS us, user_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"

def _events(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"), "event_id")


@query(f"""WITH {ROWS}, g AS (SELECT event_type, us, {TEXT} AS text, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY us, text) - n AS before FROM g)
    SELECT event_type, CAST(before // {CHUNK} AS BIGINT) AS chunk, CAST(sum(n) AS BIGINT) AS rows, min(us) AS first, sha256(string_agg(text || '*' || n, chr(10) ORDER BY before)) AS digest FROM p GROUP BY event_type, before // {CHUNK}""")
def chunk_digests(spark, sf):
    return G.chunk_digests(_events(spark, sf), ["event_type"], "us", ["user_id", "cents"], CHUNK)


@query(f"""WITH {ROWS}, g AS (SELECT event_type, us, {TEXT} AS text, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY us, text) - n AS before FROM g),
    x AS (SELECT *, CASE WHEN us % 997 = 0 THEN text || '!' ELSE text END AS other FROM p), d AS (SELECT event_type, min(before) AS place FROM x WHERE other <> text GROUP BY 1)
    SELECT event_type, CAST(place AS BIGINT) AS place FROM d""")
def first_difference(spark, sf):
    """Where each series parts from a copy in which some events have another value."""
    e = _events(spark, sf)
    changed = e.withColumn("cents", F.when(F.col("us") % 997 == 0, F.col("cents") + 1).otherwise(F.col("cents")))
    return G.first_difference(e, changed, ["event_type"], "us", ["user_id", "cents"], CHUNK).select("event_type", "place")


@query()
def series_digest(spark, sf):
    """No SQL twin: the levels of digests are as many as the series is long; a test holds them against a loop, and the chunks have one."""
    return G.series_digest(_events(spark, sf), ["event_type"], "us", ["user_id", "cents"], CHUNK, FAN)
