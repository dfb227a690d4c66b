"""Queries of bitemporal views, as-of joins, intervals and universes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, bars as B, intervals, universe
from ..sources.tables import table
from .registry import query
from .series import BARS, bars

T = "1997-06-30"


@query(f"""SELECT l_orderkey, l_partkey, CAST(l_shipdate AS DATE) AS shipped, l_linenumber FROM lineitem WHERE l_shipdate <= TIMESTAMP '{T}'
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1""")
def asof_view_latest_revision(spark, sf):
    lines = table(spark, sf, "lineitem")
    ties = [F.col(c).desc() for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    view = asof.as_of_view(lines, ["l_orderkey"], "l_shipdate", F.lit(T).cast("timestamp"), ties)
    return view.select("l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("shipped"), "l_linenumber")


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_shipdate, max(l_shipdate) FILTER (l_shipdate <= TIMESTAMP '{T}') OVER (PARTITION BY l_orderkey) AS m FROM lineitem)
    SELECT CASE WHEN l_shipdate > TIMESTAMP '{T}' THEN 'later' WHEN l_shipdate = m THEN 'visible' ELSE 'superseded' END AS role, count(*) AS n FROM v GROUP BY 1""")
def explain_versions(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    return asof.versions_at(lines, ["l_orderkey"], "l_shipdate", F.lit(T).cast("timestamp")).groupBy("role").agg(F.count("*").alias("n"))


def _sides(spark, sf):
    e = table(spark, sf, "events")
    buys = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    views = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    return buys, views


@query("""SELECT p.event_id, p.user_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_join_backward(spark, sf):
    buys, views = _sides(spark, sf)
    return asof.as_of_join(buys, views, ["user_id"], "ts", "view_ts", ["view_value"]).select("event_id", "user_id", "view_value")


@query("""SELECT p.event_id, p.user_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts <= v.ts""")
def asof_join_forward(spark, sf):
    buys, views = _sides(spark, sf)
    return asof.as_of_join(buys, views, ["user_id"], "ts", "view_ts", ["view_value"], forward=True).select("event_id", "user_id", "view_value")


@query("""SELECT p.event_id, p.user_id, CASE WHEN p.ts - v.ts <= INTERVAL 6 HOUR THEN v.value END AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts""")
def asof_join_tolerance(spark, sf):
    buys, views = _sides(spark, sf)
    return asof.as_of_join(buys, views, ["user_id"], "ts", "view_ts", ["view_value"], tolerance_seconds=6 * 3600, strict=True).select("event_id", "user_id", "view_value")


ORDERS = "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders"


@query(f"""WITH o AS ({ORDERS}), l AS (SELECT * FROM o WHERE o_orderkey % 10 = 0), r AS (SELECT * FROM o WHERE o_orderkey % 10 <> 0)
    SELECT l.o_orderkey, arg_min(r.o_totalprice, row(abs(r.d - l.d), r.d, r.o_totalprice)) AS near_price, min(abs(r.d - l.d)) AS days_apart
    FROM l LEFT JOIN r ON l.o_custkey = r.o_custkey AND abs(r.d - l.d) <= 60 GROUP BY ALL""")
def nearest_within_days(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"), "o_totalprice")
    left = o.filter("o_orderkey % 10 = 0").select("o_orderkey", "o_custkey", "d")
    right = o.filter("o_orderkey % 10 <> 0").select("o_custkey", F.col("d").alias("rd"), F.col("o_totalprice").alias("near_price"))
    return asof.nearest_match(left, right, ["o_custkey"], "d", "rd", 60, ["near_price"]).select("o_orderkey", "near_price", F.col("days_apart").cast("long").alias("days_apart"))


@query("""WITH iv AS (SELECT user_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to, event_type FROM events WHERE event_type IN ('signup', 'error')),
    p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
    SELECT p.event_id, p.user_id, iv.event_type AS during FROM p JOIN iv ON p.user_id = iv.user_id AND iv.valid_from <= p.ts AND (iv.valid_to IS NULL OR p.ts < iv.valid_to)""")
def interval_membership(spark, sf):
    e = table(spark, sf, "events")
    iv = intervals.from_events(e.filter("event_type in ('signup', 'error')"), ["user_id"], "ts").select("user_id", "valid_from", "valid_to", F.col("event_type").alias("during"))
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return intervals.interval_join(clicks, iv, ["user_id"], "ts", "valid_from", "valid_to").select("event_id", "user_id", "during")


SPANS = "SELECT o_custkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 20 + CAST(o_orderkey % 90 AS INT) AS e FROM orders"


def _spans(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_custkey", d.alias("s"), F.date_add(d, (F.col("o_orderkey") % 90).cast("int") + 20).alias("e"))


@query(f"""WITH i AS ({SPANS}), n AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < s THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM n)
    SELECT o_custkey, min(s) AS s, max(e) AS e, count(*) AS pieces FROM g GROUP BY o_custkey, run""")
def interval_union(spark, sf):
    return intervals.union(_spans(spark, sf), ["o_custkey"], "s", "e")


@query(f"""WITH i AS ({SPANS}), n AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
    SELECT o_custkey, count(*) AS n FROM n WHERE reach > s GROUP BY o_custkey""")
def interval_conflicts(spark, sf):
    return intervals.conflicts(_spans(spark, sf), ["o_custkey"], "s", "e").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_custkey, o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d, o_orderkey AS k, lead(CAST(o_orderdate AS DATE)) OVER w AS e FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    n AS (SELECT *, CASE WHEN lag(p) OVER w = p THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY d, k)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY d, k ROWS UNBOUNDED PRECEDING) AS run FROM n)
    SELECT o_custkey, p, min(d) AS d, CASE WHEN bool_or(e IS NULL) THEN NULL ELSE max(e) END AS e, count(*) AS pieces FROM r GROUP BY o_custkey, run, p""")
def merge_equal_segments(spark, sf):
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("p"), F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("k"))
    o = o.withColumn("e", F.lead("d").over(Window.partitionBy("o_custkey").orderBy("d", "k")))
    return intervals.merge_equal(o, ["o_custkey"], ["d", "k"], ["p"], "d", "e")


def _member_events(spark, sf):
    e = table(spark, sf, "events").filter("event_type in ('signup', 'error')")
    return e.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "signup", "ADD").otherwise("DELETE").alias("kind"))


MEMBERS = """me AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN 'ADD' ELSE 'DELETE' END AS kind FROM events WHERE event_type IN ('signup', 'error')),
    mt AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM me),
    mv AS (SELECT * FROM mt WHERE (was IS NULL AND kind = 'ADD') OR was <> kind),
    ms AS (SELECT user_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to, kind FROM mv),
    membership AS (SELECT user_id, valid_from, valid_to FROM ms WHERE kind = 'ADD')"""


@query(f"""WITH {MEMBERS} SELECT user_id, CAST(valid_from AS DATE) AS valid_from, CAST(valid_to AS DATE) AS valid_to, CASE WHEN valid_to IS NULL THEN 'ACTIVE' ELSE 'CLOSED' END AS status FROM membership""")
def event_sourced_intervals(spark, sf):
    m = universe.build_membership(_member_events(spark, sf), ["user_id"], "ts", ["event_id"])
    return m.withColumns({"valid_from": F.to_date("valid_from"), "valid_to": F.to_date("valid_to")})


@query(f"""WITH {MEMBERS} SELECT user_id, event_id, CASE WHEN kind = 'ADD' THEN 'ALREADY_PRESENT' ELSE 'NOT_PRESENT' END AS error FROM mt
    WHERE (kind = 'ADD' AND was = 'ADD') OR (kind = 'DELETE' AND (was IS NULL OR was = 'DELETE'))""")
def event_sequence_errors(spark, sf):
    return universe.sequence_errors(_member_events(spark, sf), ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", "error")


@query(f"""WITH {MEMBERS}, g AS (SELECT user_id % 3 AS g, valid_from, valid_to FROM membership),
    s AS (SELECT g, CAST(valid_from AS DATE) AS day, 1 AS d FROM g UNION ALL SELECT g, CAST(valid_to AS DATE), -1 FROM g WHERE valid_to IS NOT NULL), p AS (SELECT g, day, sum(d) AS d FROM s GROUP BY ALL)
    SELECT g, day AS "at", CAST(sum(d) OVER (PARTITION BY g ORDER BY day) AS BIGINT) AS members FROM p""")
def universe_size(spark, sf):
    m = universe.build_membership(_member_events(spark, sf), ["user_id"], "ts", ["event_id"])
    m = m.select((F.col("user_id") % 3).alias("g"), F.to_date("valid_from").alias("valid_from"), F.to_date("valid_to").alias("valid_to"))
    return universe.size_over_time(m, ["g"])


@query(f"""WITH {MEMBERS}, a AS (SELECT DISTINCT user_id FROM membership WHERE valid_from <= TIMESTAMP '2024-01-25' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-25')),
    d AS (SELECT user_id, sum(CASE WHEN kind = 'ADD' THEN -1 ELSE 1 END) AS d FROM mv WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-25' GROUP BY 1),
    b AS (SELECT coalesce(a.user_id, d.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 0 ELSE 1 END + coalesce(d, 0) AS s FROM a FULL JOIN d USING (user_id))
    SELECT user_id, s = 1 AS member, s IN (0, 1) AS consistent FROM b""")
def set_undo(spark, sf):
    """The set of 25 January walked back to the 10th; test_pit checks that it equals the set of the 10th."""
    e = _member_events(spark, sf)
    m = universe.build_membership(e, ["user_id"], "ts", ["event_id"])
    now = F.lit("2024-01-25").cast("timestamp")
    turns = m.select("user_id", F.col("valid_from").alias("ts"), F.lit("ADD").alias("kind")).unionByName(m.filter("valid_to is not null").select("user_id", F.col("valid_to").alias("ts"), F.lit("DELETE").alias("kind")))
    anchor = universe.members_at(m, now).select("user_id").distinct()
    return universe.undo(anchor, turns.filter(F.col("ts") <= now), ["user_id"], "ts", F.lit("2024-01-10").cast("timestamp"))


EDGES = "e AS (SELECT s_suppkey AS old, s_suppkey + 1 + s_nationkey % 3 AS new FROM supplier WHERE s_suppkey % 7 <> 0)"


@query(f"""WITH RECURSIVE {EDGES}, c AS (SELECT old, new, 1 AS steps FROM e UNION ALL SELECT c.old, e.new, c.steps + 1 FROM c JOIN e ON c.new = e.old)
    SELECT old, arg_max(new, steps) AS final, CAST(max(steps) AS BIGINT) AS steps FROM c GROUP BY old""")
def succession_closure(spark, sf):
    e = table(spark, sf, "supplier").filter("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1 + F.col("s_nationkey") % 3).alias("new"))
    return universe.succession_closure(e, "old", "new")


@query("""WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber % 2 = 0), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber % 3 = 0)
    SELECT l_orderkey, l_partkey, 'ONLY_A' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT l_orderkey, l_partkey, 'ONLY_B' FROM (FROM b EXCEPT FROM a)""")
def composition_difference(spark, sf):
    """Two compositions of every order: its lines of even numbers, and those of numbers divisible by three."""
    lines = table(spark, sf, "lineitem")
    a, b = (lines.filter(f"l_linenumber % {k} = 0").select("l_orderkey", "l_partkey").distinct() for k in (2, 3))
    return universe.set_difference(a, b, ["l_orderkey"], "l_partkey")


@query("""WITH p AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT c_custkey AS o_custkey, CASE WHEN n = 1 THEN v END AS o_orderpriority, CASE WHEN n IS NULL THEN 'NONE' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNIQUE' END AS status FROM customer LEFT JOIN p ON c_custkey = o_custkey""")
def one_candidate_join(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return universe.one_candidate(c, table(spark, sf, "orders").filter("o_orderstatus = 'P'"), ["o_custkey"], "o_orderpriority")


@query(f"""WITH {BARS}, q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT DISTINCT session_date + ((session_date - DATE '2024-01-01') * 80) :: INT - 10500 AS session_date FROM bars)
    SELECT d, (SELECT min(session_date) FROM s WHERE session_date >= d) AS next_session, (SELECT max(session_date) FROM s WHERE session_date < d) AS last_before FROM q""")
def session_shifts(spark, sf):
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    day = F.col("session_date")
    spread = F.date_add(day, F.datediff(day, F.lit("2024-01-01")) * 80 - 10500)
    s = B.calendar(bars(spark, sf).select(spread.alias("session_date")), "session_date")
    return B.session_shift(B.session_shift(d, "d", s, "next_session"), "d", s, "last_before", forward=False, strict=True)


@query("""WITH m AS (SELECT o_custkey, (extract(year FROM o_orderdate) * 12 + extract(month FROM o_orderdate)) :: INT AS o FROM orders GROUP BY 1, 2),
    g AS (SELECT *, o - row_number() OVER (PARTITION BY o_custkey ORDER BY o) AS g FROM m), r AS (SELECT o_custkey, min(o) AS first, max(o) AS last, count(*) AS length FROM g GROUP BY o_custkey, g)
    SELECT * FROM r WHERE length >= 3""")
def consecutive_runs(spark, sf):
    o = table(spark, sf, "orders")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return intervals.islands(o, ["o_custkey"], month).filter("length >= 3")
