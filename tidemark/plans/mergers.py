"""Queries of value along mergers: users are securities, and most are acquired by the next one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mergers as M
from ..operators import names as N
from ..sources.tables import table
from .registry import query
from .series import BARS, bars

#: A user ends with the first click from a day on that depends on its number; four of five do, three of them for shares of the next.
ACTS = """last AS (SELECT user_id, min(CAST(ts AS DATE)) AS day FROM events WHERE event_type = 'click' AND user_id % 5 <> 4 AND ts >= TIMESTAMP '2024-01-08' + INTERVAL 4 DAY * (user_id % 5) GROUP BY 1),
    acts AS (
        SELECT user_id, 0 AS action_id, CASE WHEN user_id % 5 < 3 THEN 'STOCK_ACQUISITION' WHEN user_id % 2 = 0 THEN 'CASH_ACQUISITION' ELSE 'BANKRUPTCY' END AS kind, day AS ex_date, CASE WHEN user_id % 5 < 3 THEN 0.5 + user_id % 5 END :: DOUBLE AS ratio,
            CASE WHEN user_id % 5 = 3 AND user_id % 2 = 0 THEN 10.0 END :: DOUBLE AS cash_amount, CASE WHEN user_id % 5 < 3 THEN user_id + 1 END AS target_key, NULL :: DOUBLE AS value_per_share FROM last
        UNION ALL SELECT user_id, 1, 'DELISTING', day, NULL, NULL, NULL, NULL FROM last WHERE user_id % 10 = 0
        UNION ALL SELECT user_id, 2, 'BANKRUPTCY', day, NULL, NULL, NULL, NULL FROM last WHERE user_id % 15 = 1
        UNION ALL SELECT user_id, event_id, 'SPLIT', CAST(ts AS DATE), 2.0, NULL, NULL, NULL FROM events WHERE event_type = 'signup'
        UNION ALL SELECT user_id, event_id, 'CASH_DIVIDEND', CAST(ts AS DATE), NULL, value / 100, NULL, NULL FROM events WHERE event_type = 'error'
        UNION ALL SELECT user_id, event_id, 'SPINOFF', CAST(ts AS DATE), 0.1, NULL, user_id + 2, CASE WHEN event_id % 2 = 0 THEN 0.5 END FROM events WHERE event_type = 'purchase' AND event_id % 7 = 0),
    t AS MATERIALIZED (SELECT user_id, ex_date AS day, arg_min(kind, row(kind = 'DELISTING', action_id)) AS kind, arg_min(coalesce(ratio, -1), row(kind = 'DELISTING', action_id)) AS ratio, arg_min(coalesce(cash_amount, -1), row(kind = 'DELISTING', action_id)) AS cash,
            arg_min(coalesce(target_key, -1), row(kind = 'DELISTING', action_id)) AS target, count(DISTINCT kind) FILTER (kind <> 'DELISTING') > 1 AS conflict
        FROM acts WHERE kind IN ('CASH_ACQUISITION', 'STOCK_ACQUISITION', 'BANKRUPTCY', 'DELISTING', 'MERGER') GROUP BY 1, 2),
    steps AS (SELECT * FROM t WHERE kind = 'STOCK_ACQUISITION' AND NOT conflict),
    ch AS (SELECT user_id AS k, NULL :: DATE AS since, user_id AS holder, 1.0 :: DOUBLE AS factor, [user_id] AS path, NULL :: VARCHAR AS problem FROM steps
        UNION ALL SELECT ch.k, s.day, s.target, ch.factor * s.ratio, list_append(ch.path, s.target), CASE WHEN list_contains(ch.path, s.target) THEN 'CYCLE' WHEN e.day < s.day THEN 'TARGET_GONE' END
        FROM ch JOIN steps s ON s.user_id = ch.holder AND (ch.since IS NULL OR s.day >= ch.since) LEFT JOIN t e ON e.user_id = s.target WHERE ch.problem IS NULL),
    h AS MATERIALIZED (SELECT k, since, lead(since) OVER (PARTITION BY k ORDER BY len(path)) AS until, holder, factor, problem FROM ch)"""


def _worth(source: str, target: str, day: str) -> str:
    """source with worth and trouble: the value of a share of target on day, through what it has become."""
    return f"""SELECT x.*, coalesce(h.problem, NULL) AS trouble, CASE WHEN h.problem IS NULL THEN coalesce(h.factor, 1) * (SELECT arg_max(b.close, b.session_date) FROM bars b WHERE b.user_id = coalesce(h.holder, x.{target}) AND b.session_date BETWEEN x.{day} - 7 AND x.{day}) END AS worth
        FROM {source} x LEFT JOIN h ON h.k = x.{target} AND (h.since IS NULL OR h.since <= x.{day}) AND (h.until IS NULL OR x.{day} < h.until)"""


def actions(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    u, none = F.col("user_id"), F.lit(None)
    start = F.date_add(F.lit("2024-01-08").cast("date"), (4 * (u % 5)).cast("int"))
    last = e.filter((F.col("event_type") == "click") & (u % 5 != 4) & (F.col("day") >= start)).groupBy("user_id").agg(F.min("day").alias("ex_date"))
    kind = F.when(u % 5 < 3, "STOCK_ACQUISITION").when(u % 2 == 0, "CASH_ACQUISITION").otherwise("BANKRUPTCY")

    def rows(df, action, kind, ratio=none, cash=none, target=none, value=none):
        return df.select("user_id", action.cast("long").alias("action_id"), kind.alias("kind"), "ex_date", F.col("ex_date").cast("timestamp").alias("announced_at"), ratio.cast("double").alias("ratio"), cash.cast("double").alias("cash_amount"), target.cast("long").alias("target_key"), value.cast("double").alias("value_per_share"))

    daily = e.withColumn("ex_date", F.col("day"))
    of = lambda what: daily.filter(F.col("event_type") == what)
    parts = [
        rows(last, F.lit(0), kind, F.when(u % 5 < 3, 0.5 + u % 5), F.when((u % 5 == 3) & (u % 2 == 0), 10.0), F.when(u % 5 < 3, u + 1)), rows(last.filter(u % 10 == 0), F.lit(1), F.lit("DELISTING")), rows(last.filter(u % 15 == 1), F.lit(2), F.lit("BANKRUPTCY")),
        rows(of("signup"), F.col("event_id"), F.lit("SPLIT"), F.lit(2.0)), rows(of("error"), F.col("event_id"), F.lit("CASH_DIVIDEND"), cash=F.col("value") / 100),
        rows(of("purchase").filter("event_id % 7 = 0"), F.col("event_id"), F.lit("SPINOFF"), F.lit(0.1), target=u + 2, value=F.when(F.col("event_id") % 2 == 0, 0.5)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH RECURSIVE {BARS}, {ACTS} SELECT k AS user_id, since, until, holder, round(factor, 6) AS factor, problem FROM h""")
def merger_chains(spark, sf):
    """What a share of each acquired user becomes, step by step."""
    held = M.holdings(M.terminals(actions(spark, sf), "user_id"), "user_id")
    return held.withColumn("factor", F.round("factor", 6))


@query(f"""WITH RECURSIVE {BARS}, {ACTS},
    o AS (SELECT b.* FROM bars b LEFT JOIN t USING (user_id) WHERE t.day IS NULL OR session_date < t.day),
    a AS (SELECT acts.*, (SELECT min(o.session_date) FROM o WHERE o.user_id = acts.user_id AND o.session_date >= ex_date) AS bar FROM acts LEFT JOIN t USING (user_id) WHERE (t.day IS NULL OR ex_date < t.day) AND acts.kind IN ('SPLIT', 'CASH_DIVIDEND', 'SPINOFF')),
    d AS (SELECT user_id, bar, ex_date, coalesce(product(ratio) FILTER (kind = 'SPLIT'), 1) AS s, coalesce(sum(cash_amount) FILTER (kind = 'CASH_DIVIDEND'), 0) AS c FROM a WHERE kind <> 'SPINOFF' AND bar IS NOT NULL GROUP BY 1, 2, 3),
    cum AS (SELECT *, c * product(s) OVER (PARTITION BY user_id, bar ORDER BY ex_date) AS old FROM d), p AS (SELECT user_id, bar AS session_date, product(s) AS s, sum(old) / product(s) AS c FROM cum GROUP BY 1, 2),
    k AS (SELECT user_id, bar AS session_date, sum(coalesce(value_per_share, ratio * worth)) AS ik, count(*) FILTER (coalesce(value_per_share, ratio * worth) IS NULL) > 0 AS un, max(trouble) AS tr FROM ({_worth("(SELECT * FROM a WHERE kind = 'SPINOFF' AND bar IS NOT NULL)", 'target_key', 'bar')}) GROUP BY 1, 2),
    e AS (SELECT user_id, day AS session_date, kind, conflict, trouble, CASE WHEN conflict THEN NULL WHEN kind = 'CASH_ACQUISITION' THEN cash WHEN kind = 'STOCK_ACQUISITION' THEN ratio * worth WHEN kind = 'BANKRUPTCY' THEN 0 END AS paid FROM ({_worth('t', 'target', 'day')})),
    r AS (SELECT o.user_id, o.session_date, o.close, s, c, ik, CASE WHEN un THEN coalesce(tr, 'UNVALUED') END AS problem, NULL :: VARCHAR AS kind, NULL :: DOUBLE AS paid FROM o LEFT JOIN p USING (user_id, session_date) LEFT JOIN k USING (user_id, session_date)
        UNION ALL SELECT user_id, session_date, NULL, NULL, NULL, NULL, CASE WHEN conflict THEN 'CONFLICT' WHEN kind IN ('DELISTING', 'MERGER') THEN NULL WHEN paid IS NULL THEN coalesce(trouble, 'UNVALUED') END, kind, paid FROM e),
    b4 AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
    g AS (SELECT *, CASE WHEN problem IS NULL THEN CASE WHEN kind IS NOT NULL THEN paid ELSE coalesce(s, 1) * (close + coalesce(c, 0)) + coalesce(ik, 0) END / nullif(before, 0) END AS gross FROM b4 WHERE kind IS NULL OR before IS NOT NULL)
    SELECT user_id, session_date, round(gross, 6) AS gross, kind AS note, problem, max(problem) OVER w IS NULL AND count(gross) OVER w > 0 AS known,
        round(CASE WHEN max(problem) OVER w IS NULL THEN ln(nullif(abs(product(coalesce(gross, 1)) OVER w), 0)) END, 4) AS log_level FROM g WINDOW w AS (PARTITION BY user_id ORDER BY session_date)""")
def total_return_in_kind(spark, sf):
    """Total return of every user through splits, cash, spun-off shares and its end, with what cannot be valued."""
    r = M.total_return_in_kind(bars(spark, sf), actions(spark, sf), "user_id")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("tr_level").isNotNull() & (F.count("gross").over(w) > 0)
    level = F.abs("tr_level")
    return r.select("user_id", "session_date", F.round("gross", 6).alias("gross"), "note", "problem", known.alias("known"), F.round(F.when(level > 0, F.ln(level)), 4).alias("log_level"))


#: Customers are listed under their number; urgent orders change the name of whoever holds their customer's number into a near one, so that names are used again.
NAMES = """first AS (SELECT 'L:' || c_custkey || ':T' || c_custkey || ':1992-01-01' AS node, 'T' || c_custkey AS name, DATE '1992-01-01' AS since, c_custkey :: VARCHAR AS security, NULL :: VARCHAR AS old FROM customer),
    nodes AS MATERIALIZED (FROM first UNION ALL SELECT 'C:' || o_orderkey, 'T' || (o_custkey + 1 + o_orderkey % 3), CAST(o_orderdate AS DATE), NULL, 'T' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'),
    lastof AS MATERIALIZED (SELECT name, since, max(node) AS parent FROM nodes GROUP BY 1, 2),
    pa AS MATERIALIZED (SELECT n.node, n.since, l.parent FROM (SELECT * FROM nodes WHERE old IS NOT NULL) n ASOF LEFT JOIN lastof l ON l.name = n.old AND n.since > l.since),
    gr AS MATERIALIZED (SELECT *, CASE WHEN parent IS NULL THEN 'UNKNOWN_NAME' WHEN row_number() OVER (PARTITION BY parent ORDER BY since, node) > 1 THEN 'NOT_HELD' END AS own FROM pa),
    up AS (SELECT node, node AS cur, 0 AS hops, NULL :: VARCHAR AS problem FROM nodes UNION ALL SELECT up.node, g.parent, hops + 1, coalesce(up.problem, CASE WHEN hops = 0 THEN g.own WHEN g.own IS NOT NULL THEN 'NOT_HELD' END) FROM up JOIN gr g ON g.node = up.cur WHERE g.parent IS NOT NULL),
    top AS (SELECT node, arg_max(cur, hops) AS root, arg_max(coalesce(problem, ''), hops) AS problem FROM up GROUP BY 1),
    hist AS MATERIALIZED (SELECT n.node, n.name, n.since, least((SELECT min(g.since) FROM gr g WHERE g.parent = n.node AND g.own IS NULL), lead(n.since) OVER (PARTITION BY n.name ORDER BY n.since, n.node)) AS until, r.security,
            CASE WHEN g.own = 'UNKNOWN_NAME' THEN 'UNKNOWN_NAME' WHEN top.problem <> '' THEN top.problem WHEN r.security IS NULL THEN 'NOT_HELD' ELSE 'HELD' END AS status
        FROM nodes n JOIN top USING (node) LEFT JOIN nodes r ON r.node = top.root LEFT JOIN gr g ON g.node = n.node)"""


def _history(spark, sf, as_of=None):
    c = table(spark, sf, "customer")
    name = F.concat(F.lit("T"), F.col("c_custkey").cast("string"))
    listings = c.select(F.col("c_custkey").alias("security"), name.alias("name"), F.lit("1992-01-01").cast("date").alias("since"))
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    t = lambda x: F.concat(F.lit("T"), x.cast("string"))
    day = F.to_date("o_orderdate")
    changes = o.select(F.col("o_orderkey").alias("change"), t(F.col("o_custkey")).alias("old"), t(F.col("o_custkey") + 1 + F.col("o_orderkey") % 3).alias("new"), day.alias("day"), day.alias("known"))
    return N.name_history(listings, changes, as_of)


@query(f"WITH RECURSIVE {NAMES} SELECT node, name, since, until, CASE WHEN status = 'HELD' THEN security END AS security, status FROM hist")
def name_history(spark, sf):
    """Every taking of a name and whose it was."""
    return _history(spark, sf)


@query(f"""WITH RECURSIVE {NAMES.replace("WHERE o_orderpriority = '1-URGENT'", "WHERE o_orderpriority = '1-URGENT' AND o_orderdate <= TIMESTAMP '1999-06-30'")},
    q AS (SELECT name, since, arg_max(row(node, until, security, status), node) AS h FROM hist GROUP BY 1, 2)
    SELECT o.o_orderkey, h[1] AS node, CASE WHEN h IS NULL THEN 'UNKNOWN' WHEN h[4] <> 'HELD' THEN 'REFUSED' WHEN h[2] <= CAST(o.o_orderdate AS DATE) THEN 'LEFT' ELSE 'HELD' END AS status,
        CASE WHEN h[4] = 'HELD' AND (h[2] IS NULL OR h[2] > CAST(o.o_orderdate AS DATE)) THEN h[3] END AS security
    FROM orders o ASOF LEFT JOIN q ON q.name = 'T' || o.o_custkey AND CAST(o.o_orderdate AS DATE) >= q.since""")
def names_as_of(spark, sf):
    """Who held each order's name on its day, as known by the middle of 1999: later links have no part."""
    history = _history(spark, sf, F.lit("1999-06-30").cast("date"))
    points = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker"), F.to_date("o_orderdate").alias("at"))
    return N.names_as_of(points, history, "ticker", "at").select("o_orderkey", "node", "status", "security")
