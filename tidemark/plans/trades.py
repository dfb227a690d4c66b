"""Queries of corporate actions, trades, positions and append-only logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import log, rounded
from ..operators import actions as A
from ..operators import machine as M
from ..operators import simulate as T
from ..sources.tables import table
from .registry import query
from .series import BARS, bars

#: Actions made of events: sign-ups are splits, errors dividends; clicks of late days end a series.
ACTIONS = """act AS (SELECT user_id, event_id AS action_id, CASE WHEN event_type = 'signup' THEN 'SPLIT' ELSE 'DIVIDEND' END AS kind, CAST(ts AS DATE) AS ex_date, ts AS announced_at,
        CASE WHEN event_type = 'signup' THEN 2.0 :: DOUBLE END AS ratio, CASE WHEN event_type = 'error' THEN value / 100 END AS cash_amount, event_id % 3 AS tier
    FROM events WHERE event_type IN ('signup', 'error')),
    day AS (SELECT user_id, ex_date AS session_date, coalesce(product(ratio) FILTER (kind = 'SPLIT'), 1) AS s, coalesce(sum(cash_amount) FILTER (kind = 'DIVIDEND'), 0) AS d FROM act GROUP BY 1, 2)"""


def actions(spark, sf):
    e = table(spark, sf, "events").filter("event_type in ('signup', 'error')")
    split = F.col("event_type") == "signup"
    return e.select(
        "user_id", F.col("event_id").alias("action_id"), F.when(split, "SPLIT").otherwise("DIVIDEND").alias("kind"), F.to_date("ts").alias("ex_date"), F.col("ts").alias("announced_at"),
        F.when(split, 2.0).alias("ratio"), F.when(~split, F.col("value") / 100).alias("cash_amount"), (F.col("event_id") % 3).alias("tier"),
    )


def _r(df, *names, digits=4):
    return df.withColumns({n: rounded(n, digits) for n in names})


@query(f"""WITH {BARS}, {ACTIONS}, g AS (SELECT b.user_id, b.session_date, coalesce(s, 1) * (close + coalesce(d, 0)) / nullif(lag(close) OVER w, 0) AS gross
        FROM bars b LEFT JOIN day USING (user_id, session_date) WINDOW w AS (PARTITION BY b.user_id ORDER BY b.session_date))
    SELECT user_id, session_date, round(gross, 7) AS gross, round(ln(product(coalesce(gross, 1)) OVER (PARTITION BY user_id ORDER BY session_date)), 4) AS log_level FROM g""")
def total_return(spark, sf):
    df = A.total_return(bars(spark, sf), actions(spark, sf), "user_id")
    return _r(_r(df.select("user_id", "session_date", "gross", log(F.col("tr_level")).alias("log_level")), "log_level"), "gross", digits=7)


@query(f"""WITH {BARS}, {ACTIONS}, g AS (SELECT b.user_id, b.session_date, close, coalesce(1 / s, 1) * coalesce(1 - d * s / nullif(lag(close) OVER w, 0), 1) AS f
        FROM bars b LEFT JOIN day USING (user_id, session_date) WINDOW w AS (PARTITION BY b.user_id ORDER BY b.session_date))
    , a AS (SELECT user_id, session_date, close * coalesce(product(f) OVER (PARTITION BY user_id ORDER BY session_date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS a FROM g)
    SELECT user_id, session_date, CASE WHEN a > 0 THEN round(ln(a), 6) END AS log_adj_close FROM a""")
def split_adjust(spark, sf):
    df = A.adjusted_closes(bars(spark, sf), actions(spark, sf), "user_id")
    return df.select("user_id", "session_date", F.when(F.col("adj_close") > 0, rounded(F.ln("adj_close"), 6)).alias("log_adj_close"))


#: Bars of views only, without a close on some days, so that most actions fall on days that have none.
GAPS = """gap AS (SELECT user_id, CAST(ts AS DATE) AS session_date, CASE WHEN arg_max(event_id, ts) % 7 <> 0 THEN arg_max(abs(value) + 1, ts) END AS close FROM events WHERE event_type = 'view' GROUP BY 1, 2)"""
#: Actions on the next bar with a close; cash before a later split of that bar is put into its shares.
PLACED = """seen AS (SELECT d.*, (SELECT min(b.session_date) FROM gap b WHERE b.user_id = d.user_id AND b.close IS NOT NULL AND b.session_date >= d.session_date) AS bar FROM day d),
    cum AS (SELECT *, d * product(s) OVER (PARTITION BY user_id, bar ORDER BY session_date) AS old FROM seen WHERE bar IS NOT NULL),
    on_bar AS (SELECT user_id, bar AS session_date, product(s) AS s, sum(old) / product(s) AS d FROM cum GROUP BY 1, 2),
    b AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM gap)"""


def _gap_bars(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'view'")
    per = e.groupBy("user_id", F.to_date("ts").alias("session_date")).agg(F.max_by(F.struct("event_id", "value"), "ts").alias("l"))
    return per.select("user_id", "session_date", F.when(F.col("l.event_id") % 7 != 0, F.abs("l.value") + 1).alias("close"))


@query(f"""WITH {GAPS}, {ACTIONS}, {PLACED}, g AS (SELECT b.user_id, b.session_date, coalesce(s, 1) * (close + coalesce(d, 0)) / before AS gross FROM b LEFT JOIN on_bar USING (user_id, session_date))
    SELECT user_id, session_date, round(gross, 7) AS gross, round(ln(product(coalesce(gross, 1)) OVER (PARTITION BY user_id ORDER BY session_date)), 4) AS log_level FROM g""")
def total_return_off_calendar(spark, sf):
    df = A.total_return(_gap_bars(spark, sf), actions(spark, sf), "user_id")
    return _r(_r(df.select("user_id", "session_date", "gross", log(F.col("tr_level")).alias("log_level")), "log_level"), "gross", digits=7)


@query(f"""WITH {GAPS}, {ACTIONS}, {PLACED}, g AS (SELECT b.user_id, b.session_date, close, coalesce(1 / s, 1) * coalesce(1 - d * s / before, 1) AS f FROM b LEFT JOIN on_bar USING (user_id, session_date)),
    a AS (SELECT user_id, session_date, close * coalesce(product(f) OVER (PARTITION BY user_id ORDER BY session_date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS a FROM g)
    SELECT user_id, session_date, CASE WHEN a > 0 THEN round(ln(a), 5) END AS log_adj_close FROM a""")
def split_adjust_off_calendar(spark, sf):
    df = A.adjusted_closes(_gap_bars(spark, sf), actions(spark, sf), "user_id")
    return df.select("user_id", "session_date", F.when(F.col("adj_close") > 0, rounded(F.ln("adj_close"), 5)).alias("log_adj_close"))


@query(f"""WITH {BARS}, {ACTIONS}, s AS (SELECT user_id, min(session_date) AS start, max(session_date) - 5 AS stop FROM bars GROUP BY 1)
    SELECT s.user_id, start, stop, coalesce(product(ratio), 1) AS split_factor FROM s LEFT JOIN act a ON a.user_id = s.user_id AND kind = 'SPLIT' AND ex_date > start AND ex_date <= stop GROUP BY ALL""")
def split_between(spark, sf):
    spans = bars(spark, sf).groupBy("user_id").agg(F.min("session_date").alias("start"), F.date_sub(F.max("session_date"), 5).alias("stop"))
    return A.split_between(actions(spark, sf), spans, "user_id", "start", "stop")


TERMINAL = "t AS (SELECT user_id, min(CAST(ts AS DATE)) AS ex, arg_min(CASE WHEN event_id % 2 = 0 THEN value END, row(CAST(ts AS DATE), event_id)) AS _ FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-20' GROUP BY 1)"


@query(f"""WITH {BARS}, {TERMINAL}, c AS (SELECT user_id, CAST(ts AS DATE) AS ex, min(value) AS cash FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-20' GROUP BY 1, 2)
    SELECT b.user_id, b.session_date, CASE WHEN b.session_date = t.ex THEN cash ELSE close END AS close, coalesce(b.session_date = t.ex, FALSE) AS terminal
    FROM bars b LEFT JOIN t USING (user_id) LEFT JOIN c ON c.user_id = b.user_id AND c.ex = t.ex WHERE t.ex IS NULL OR b.session_date <= t.ex""")
def terminal_event(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'click' and ts >= '2024-01-20'")
    ends = e.groupBy("user_id", F.to_date("ts").alias("ex_date")).agg(F.min("value").alias("cash_amount")).withColumn("kind", F.lit("CASH_MERGER"))
    return A.until_terminal(bars(spark, sf), ends, "user_id").select("user_id", "session_date", "close", "terminal")


@query(f"""WITH {ACTIONS}, o AS (SELECT * FROM act WHERE tier = 0), v AS (SELECT * FROM act WHERE tier <> 0),
    b AS (SELECT o.action_id, o.kind, o.ex_date, o.ratio, o.cash_amount, min(row(abs(v.ex_date - o.ex_date), v.ex_date, v.ratio, v.cash_amount)) AS m FROM o LEFT JOIN v ON v.user_id = o.user_id AND v.kind = o.kind AND abs(v.ex_date - o.ex_date) <= 5 GROUP BY ALL),
    c AS (SELECT action_id, m[1] AS gap, coalesce(abs(ratio - m[3]) > 1e-9, FALSE) AS r, coalesce(abs(cash_amount - m[4]) > 0.01, FALSE) AS c FROM b)
    SELECT action_id, CASE WHEN gap IS NULL THEN 'MISSING' WHEN gap = 0 AND NOT r AND NOT c THEN 'MATCH' ELSE 'DISAGREEMENT' END AS verdict,
        CASE WHEN gap IS NOT NULL THEN concat_ws(',', CASE WHEN gap > 0 THEN 'ex_date' END, CASE WHEN r THEN 'ratio' END, CASE WHEN c THEN 'cash_amount' END) END AS diffs FROM c""")
def vendor_compare(spark, sf):
    a = actions(spark, sf)
    return A.compare_sources(a.filter("tier = 0"), a.filter("tier <> 0"), "user_id").select("action_id", "verdict", "diffs")


@query(f"""WITH {BARS}, b2 AS (SELECT user_id, CAST(ts AS DATE) AS session_date, arg_max(value, ts) AS close FROM events WHERE event_id % 10 <> 0 GROUP BY 1, 2)
    SELECT CASE WHEN b2.close IS NULL THEN 'ONLY_A' WHEN bars.close IS NULL THEN 'ONLY_B' WHEN bars.close = b2.close THEN 'EXACT' WHEN abs(bars.close / nullif(b2.close, 0) - 1) <= 0.005 THEN 'SMALL' ELSE 'LARGE' END AS status, count(*) AS n
    FROM bars FULL JOIN b2 USING (user_id, session_date) GROUP BY 1""")
def compare_bars(spark, sf):
    from ..operators.bars import daily_bars as make

    b = make(table(spark, sf, "events").filter("event_id % 10 <> 0"), "user_id", "ts", "value", "event_id")
    return A.compare_bars(bars(spark, sf), b, ["user_id", "session_date"])


def ca_collapse(spark, sf):
    """No SQL twin: which report of an event stays depends on those kept before it; tests hold it against a plain loop."""
    return A.collapse_sources(actions(spark, sf), "user_id").select("user_id", "action_id", "kind", "ex_date")


query()(ca_collapse)

#: Long trades entered at the close of each user's fifth bar.
PATH = """e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session_date) AS i FROM bars), t AS (SELECT user_id, close AS entry FROM e WHERE i = 5 AND close > 0),
    p AS (SELECT e.*, entry, entry * 0.7 AS stop, entry * 1.4 AS target FROM e JOIN t USING (user_id) WHERE i > 5)"""


def _path(spark, sf):
    w = Window.partitionBy("user_id").orderBy("session_date")
    b = bars(spark, sf).withColumn("i", F.row_number().over(w))
    entry = F.max(F.when(F.col("i") == 5, F.col("close"))).over(Window.partitionBy("user_id"))
    p = b.withColumn("entry", entry).filter("i > 5 and entry > 0")
    return p.withColumns({"stop": F.col("entry") * 0.7, "target": F.col("entry") * 1.4})


@query(f"""WITH {BARS}, {PATH}, k AS (SELECT *, CASE WHEN open <= stop THEN 'STOP_GAP' WHEN open >= target THEN 'TARGET_GAP' WHEN low <= stop AND high >= target THEN 'AMBIGUOUS' WHEN low <= stop THEN 'STOP' WHEN high >= target THEN 'TARGET' END AS kind FROM p),
    h AS (SELECT *, min(session_date) FILTER (kind IS NOT NULL) OVER (PARTITION BY user_id) AS hit FROM k), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session_date DESC) AS r FROM h WHERE hit IS NULL OR session_date <= hit)
    SELECT user_id, coalesce(max(kind) FILTER (r = 1), 'OPEN') AS outcome, max(session_date) AS exit_date,
        round(max(CASE WHEN kind LIKE '%GAP' THEN open WHEN low <= stop THEN stop WHEN high >= target THEN target ELSE close END / entry) FILTER (r = 1) - 1, 6) AS pessimistic,
        round(max(CASE WHEN kind LIKE '%GAP' THEN open WHEN high >= target THEN target WHEN low <= stop THEN stop ELSE close END / entry) FILTER (r = 1) - 1, 6) AS optimistic,
        round(max(high / entry) - 1, 6) AS mfe, round(min(low / entry) - 1, 6) AS mae FROM l GROUP BY user_id""")
def first_touch_outcome(spark, sf):
    return _r(T.first_touch(_path(spark, sf), "user_id"), "pessimistic", "optimistic", "mfe", "mae", digits=6)


@query("""WITH RECURSIVE ev AS (SELECT user_id, CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN 'BUY' ELSE 'SELL' END AS k, (1 + event_id % 4) :: DOUBLE AS q, abs(value) + 1 AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f AS (SELECT user_id, i, CASE WHEN k = 'BUY' THEN q ELSE 0 END AS quantity, CASE WHEN k = 'BUY' THEN p ELSE 0 END AS avg_cost, 0 :: DOUBLE AS realised FROM ev WHERE i = 1
        UNION ALL SELECT ev.user_id, ev.i, CASE WHEN k = 'BUY' THEN quantity + q ELSE quantity - least(q, quantity) END,
            CASE WHEN k = 'BUY' THEN (quantity * avg_cost + q * p) / (quantity + q) WHEN quantity <= q THEN 0 ELSE avg_cost END, CASE WHEN k = 'BUY' THEN realised ELSE realised + least(q, quantity) * (p - avg_cost) END
        FROM f JOIN ev ON ev.user_id = f.user_id AND ev.i = f.i + 1)
    SELECT user_id, round(arg_max(quantity, i), 4) AS quantity, round(arg_max(avg_cost, i), 4) AS avg_cost, round(arg_max(realised, i), 3) AS realised, count(*) AS n_events FROM f GROUP BY user_id""")
def position_fold(spark, sf):
    e = table(spark, sf, "events")
    e = e.select("user_id", "ts", "event_id", F.when(F.col("event_type").isin("purchase", "signup", "view"), "BUY").otherwise("SELL").alias("side"), (1 + F.col("event_id") % 4).alias("q"), (F.abs("value") + 1).alias("p"))
    df = T.position_fold(e, "user_id", ["ts", "event_id"], "side", "q", "p")
    return _r(_r(df, "quantity", "avg_cost"), "realised", digits=3)


@query("SELECT c_custkey, greatest(0, least(floor(50000 * 0.01 / nullif(abs(c_acctbal - 900), 0)), floor(50000 / nullif(c_acctbal, 0)))) :: BIGINT AS units FROM customer WHERE c_acctbal > 1 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_acctbal <= 1 OR c_acctbal IS NULL")
def position_size(spark, sf):
    """A price of one or less (a balance here) has no size: NULL units."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.when(F.col("c_acctbal") > 1, T.position_size(F.lit(50000.0), F.lit(0.01), F.col("c_acctbal"), F.lit(900.0))).cast("long").alias("units"))


def simulated(spark, sf):
    """Plans of every entry type and exit policy over the users' paths; some are cancelled, some closed by hand."""
    p, u = _path(spark, sf), F.col("user_id")
    e = F.col("entry")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (u % n + 1).cast("int"))
    zone = F.when(u % 5 == 1, e * 0.95).otherwise(e)
    parts = [F.when(u % 3 == 1, F.lit(x)).alias(f"fraction_{n}") for n, x in ((1, 0.4), (2, 0.3), (3, 0.2))]
    return p.select(
        "user_id", "session_date", "open", "high", "low", "close", "entry", pick(5, "LIMIT", "ENTRY_ZONE", "STOP_BUY", "MARKET", "MARKET_REFERENCE").alias("entry_type"), zone.alias("entry_low"), e.alias("entry_high"),
        (e * 0.7).alias("stop"), (e * 1.2).alias("target_1"), (e * 1.5).alias("target_2"), (e * 1.9).alias("target_3"), pick(3, "LEGACY_HALF_AT_TP1", "PARTIAL_FRACTIONS", "TRACK_TARGETS_ONLY").alias("exit_policy"), *parts,
        (e * 0.75).alias("invalidation"), F.lit("2024-01-25").cast("date").alias("expiration"), F.lit("2024-01-01").cast("date").alias("decided"),
        F.when(u % 7 == 0, F.lit("2024-01-10").cast("date")).alias("cancel_on"), F.when(u % 4 == 0, F.lit("2024-01-18").cast("date")).alias("manual_on"), F.when(u % 4 == 0, e * 1.05).alias("manual_price"),
    )


def state_machine_log(spark, sf):
    """The events of each simulated trade. No SQL twin: thirteen states walk bar by bar; test_machine holds random plans against a plain loop."""
    return M.simulate(simulated(spark, sf), "user_id")


def state_machine_replay(spark, sf):
    """Each trade's outcome folded from its log alone."""
    return T.replay(M.simulate(simulated(spark, sf), "user_id"), "user_id")


def trade_metrics(spark, sf):
    """Entry, exit, realised multiples of risk and excursions of each entered trade."""
    p = simulated(spark, sf)
    return M.metrics(M.simulate(p, "user_id"), p, "user_id")


for _f in (state_machine_log, state_machine_replay, trade_metrics):
    query()(_f)


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN 'OTHER' ELSE 'LIMIT' END AS entry_type, l_quantity AS stop, 20.0 AS entry_low, 20.0 + l_linenumber % 3 AS entry_high, 21.0 + l_linenumber % 4 AS target_1, CASE WHEN l_linenumber % 2 = 0 THEN 23.0 END AS target_2, CASE WHEN l_linenumber % 3 = 0 THEN 24.0 END AS target_3 FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN entry_type <> 'LIMIT' THEN 'ENTRY_TYPE' WHEN NOT (stop > 0 AND stop < entry_low AND entry_low <= entry_high AND entry_high < target_1) THEN 'LEVEL_ORDER' WHEN target_2 <= target_1 THEN 'TARGET_2' WHEN target_3 IS NOT NULL AND (target_2 IS NULL OR target_3 <= target_2) THEN 'TARGET_3' END AS problem FROM p""")
def plan_problems(spark, sf):
    """The first rule that a plan's levels break."""
    n = F.col("l_linenumber")
    none = lambda kind: F.lit(None).cast(kind)
    p = table(spark, sf, "lineitem").select(
        "l_orderkey", n, F.when(n % 5 == 0, "OTHER").otherwise("LIMIT").alias("entry_type"), F.col("l_quantity").alias("stop"), F.lit(20.0).alias("entry_low"), (20.0 + n % 3).alias("entry_high"), (21.0 + n % 4).alias("target_1"),
        F.when(n % 2 == 0, 23.0).alias("target_2"), F.when(n % 3 == 0, 24.0).alias("target_3"), none("double").alias("invalidation"), F.lit("TRACK_TARGETS_ONLY").alias("exit_policy"), *[none("double").alias(f"fraction_{k}") for k in (1, 2, 3)],
    )
    return M.validated(p).select("l_orderkey", "l_linenumber", "problem")
