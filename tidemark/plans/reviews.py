"""Queries of plans, their observation, labels and uncertain membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import machine as M
from ..operators import review as V
from ..operators import simulate as T
from ..sources.tables import table
from .registry import query
from .series import BARS, bars
from .trades import PATH, _path, simulated


@query("""SELECT c_custkey, round(e, 4) AS entry, round(e - r, 4) AS stop, round(e + r * 1.5, 4) AS target_1, round(e + r * 2, 4) AS target_2, round(e + r * 3, 4) AS target_3
    FROM (SELECT c_custkey, c_acctbal * (76 / 77 :: DOUBLE) AS e, CASE WHEN c_nationkey > 0 THEN c_nationkey * (13 / 6 :: DOUBLE) END AS r FROM customer)""")
def trade_levels(spark, sf):
    c = table(spark, sf, "customer")
    made = c.select("c_custkey", *V.trade_levels(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), {"stop_atr": 13 / 6, "pullback": 1 / 77}))
    return made.select("c_custkey", *[F.round(x, 4).alias(x) for x in made.columns[1:]])


@query(f"""WITH {BARS}, {PATH}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session_date) AS n FROM p)
    SELECT user_id, 'T+' || n AS label, session_date AS day, close, round(close / entry - 1, 6) AS ret FROM n WHERE n IN (1, 5, 20)""")
def trade_observations(spark, sf):
    return V.observations(_path(spark, sf), "user_id", "session_date", [1, 5, 20]).withColumn("ret", F.round("ret", 6))


@query("""SELECT c_custkey, CASE WHEN k >= 3 THEN CASE WHEN h / k >= 0.8 THEN 'Strong' WHEN h / k >= 0.5 THEN 'Moderate' ELSE 'Weak' END END AS label FROM
    (SELECT c_custkey, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT AS k, coalesce(a::INT, 0) + coalesce(b::INT, 0) + coalesce(c::INT, 0) + coalesce(d::INT, 0) AS h FROM
        (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal > 1000 END AS a, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal > 4000 END AS b, c_nationkey < 15 AS c, c_mktsegment < 'F' AS d FROM customer))""")
def evidence_labels(spark, sf):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    checks = [F.when(k % 3 > 0, bal > 1000), F.when(k % 5 > 0, bal > 4000), F.col("c_nationkey") < 15, F.col("c_mktsegment") < "F"]
    return table(spark, sf, "customer").select("c_custkey", V.evidence_label(checks).alias("label"))


LEGS = "legs AS (SELECT user_id, CASE WHEN event_type = 'signup' THEN 'ADD' ELSE 'DELETE' END AS kind, CAST(ts AS DATE) AS lo, CAST(ts AS DATE) + CAST(event_id % 3 AS INT) AS hi, event_id % 3 = 0 AS exact FROM events WHERE event_type IN ('signup', 'error'))"
COLLAPSED = f"""{LEGS}, n AS (SELECT *, CASE WHEN lag(kind) OVER w = kind THEN 0 ELSE 1 END AS new FROM legs WINDOW w AS (PARTITION BY user_id ORDER BY lo, hi, kind)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY lo, hi, kind ROWS UNBOUNDED PRECEDING) AS run FROM n),
    col AS (SELECT user_id, kind, coalesce(min(lo) FILTER (exact), min(lo)) AS lo, coalesce(min(hi) FILTER (exact), max(hi)) AS hi, bool_or(exact) AS exact, count(*) AS n FROM r GROUP BY user_id, run, kind)"""


def _legs(spark, sf):
    e, d = table(spark, sf, "events").filter("event_type in ('signup', 'error')"), F.to_date("ts")
    return e.select("user_id", F.when(F.col("event_type") == "signup", "ADD").otherwise("DELETE").alias("kind"), d.alias("lo"), F.date_add(d, (F.col("event_id") % 3).cast("int")).alias("hi"), (F.col("event_id") % 3 == 0).alias("exact"))


@query(f"WITH {COLLAPSED} SELECT user_id, kind, lo, hi, exact, n FROM col")
def collapse_duplicates(spark, sf):
    return V.collapse_duplicates(_legs(spark, sf), "user_id")


@query(f"""WITH {COLLAPSED}, a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-05'), d AS (SELECT user_id, max(row(hi, lo, kind))[3] AS last FROM col WHERE hi <= DATE '2024-01-15' GROUP BY 1),
    o AS (SELECT DISTINCT user_id FROM col WHERE lo <= DATE '2024-01-15' AND hi > DATE '2024-01-15'), u AS (SELECT user_id FROM a UNION SELECT user_id FROM d UNION SELECT user_id FROM o)
    SELECT user_id, CASE WHEN user_id IN (FROM o) THEN 'UNCERTAIN' WHEN coalesce(last = 'ADD', user_id IN (FROM a)) THEN 'IN' ELSE 'OUT' END AS state FROM u LEFT JOIN d USING (user_id)""")
def certain_members(spark, sf):
    anchor = table(spark, sf, "events").filter("event_type = 'signup' and ts < '2024-01-05'").select("user_id").distinct()
    return V.certain_members(anchor, V.collapse_duplicates(_legs(spark, sf), "user_id"), "user_id", F.lit("2024-01-15").cast("date"))


def match_discovery(spark, sf):
    """No SQL twin: which pair takes a row depends on those before it; tests hold it against a plain loop."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"), "o_orderstatus")
    left, right = o.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("f"), "d"), o.filter("o_orderstatus <> 'F'").select("o_custkey", F.col("o_orderkey").alias("o"), F.col("d").alias("d2"))
    return V.match_one_to_one(left, right, "o_custkey", "f", "o", "d", "d2", 120)


def trade_milestones(spark, sf):
    return V.milestones(M.simulate(simulated(spark, sf), "user_id"), "user_id")


def plan_counterfactual(spark, sf):
    """Each trade under its plan and under one with a nearer stop."""
    p = simulated(spark, sf)
    mine = p.withColumn("stop", F.col("entry") * 0.85)
    return V.compare_plans(T.replay(M.simulate(p, "user_id"), "user_id"), T.replay(M.simulate(mine, "user_id"), "user_id"), "user_id")


for _f in (match_discovery, trade_milestones, plan_counterfactual):
    query()(_f)
