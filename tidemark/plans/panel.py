"""Queries of cross-sections, metrics, fundamentals, quality, splits and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cross_section as X
from ..operators import fundamentals as P
from ..operators import quality as Q
from ..operators import models, search, splits, stats
from ..sources.tables import table
from .registry import query

#: A panel of customers and months: spending (added up in decimals, so that its last digits do not depend on the order), the one before it and the change to the next.
PANEL = """m AS (SELECT o_custkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS spend, count(*) AS n_orders FROM orders GROUP BY ALL),
    panel AS (SELECT m.*, lag(spend) OVER w AS before, lead(spend) OVER w / spend - 1 AS ahead, c_mktsegment AS segment, c_nationkey AS nation FROM m JOIN customer ON id = c_custkey WINDOW w AS (PARTITION BY id ORDER BY month))"""


def panel(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    m = o.groupBy(F.col("o_custkey").alias("id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"), F.count("*").alias("n_orders"))
    w = Window.partitionBy("id").orderBy("month")
    m = m.join(c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")), "id")
    return m.withColumns({"before": F.lag("spend").over(w), "ahead": F.try_divide(F.lead("spend").over(w), F.col("spend")) - 1})


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


RANK = "(rank() OVER (PARTITION BY {c} ORDER BY {x}) + (count(*) OVER (PARTITION BY {c}, {x}) - 1) / 2.0)"


@query(f"WITH {PANEL}, r AS (SELECT id, month, {RANK.format(c='month', x='n_orders')} AS r, count(*) OVER (PARTITION BY month) AS n FROM panel) SELECT id, month, round(CASE WHEN n > 1 THEN (r - 1) / (n - 1) END, 6) AS xs_rank, round(r / n, 6) AS pct FROM r")
def xs_rank(spark, sf):
    df = X.percent_rank(X.cohort_rank(panel(spark, sf), ["month"], "n_orders"), ["month"], "n_orders")
    return _round(df.select("id", "month", F.col("n_orders_rank").alias("xs_rank"), F.col("n_orders_pct").alias("pct")), "xs_rank", "pct")


@query(f"""WITH {PANEL}, q AS (SELECT month, quantile_cont(spend, 0.05) AS lo, quantile_cont(spend, 0.95) AS hi FROM panel GROUP BY 1)
    SELECT id, month, round(least(greatest(spend, lo), hi), 4) AS spend_w FROM panel JOIN q USING (month)""")
def xs_winsorize(spark, sf):
    return _round(X.winsorize(panel(spark, sf), ["month"], "spend", 0.05, 0.95).select("id", "month", "spend_w"), "spend_w", digits=4)


@query(f"WITH {PANEL} SELECT id, month, round((spend - avg(spend) OVER w) / nullif(stddev_samp(spend) OVER w, 0), 6) AS spend_z FROM panel WINDOW w AS (PARTITION BY month)")
def xs_zscore(spark, sf):
    return _round(X.zscore(panel(spark, sf), ["month"], "spend").select("id", "month", "spend_z"), "spend_z")


@query(f"""WITH {PANEL}, f AS (SELECT * FROM panel WHERE ahead IS NOT NULL), r AS (SELECT month, ahead, {RANK.format(c='month', x='spend')} AS r, count(*) OVER (PARTITION BY month) AS n FROM f)
    SELECT month, CAST(least(floor((r - 1) / n * 10), 9) AS INT) AS decile, count(*) AS n, round(avg(ahead), 5) AS mean_result FROM r WHERE n >= 10 GROUP BY 1, 2""")
def deciles(spark, sf):
    return _round(X.deciles(panel(spark, sf), ["month"], "spend", "ahead").select("month", "decile", "n", "mean_result"), "mean_result", digits=5)


IC = f"""{PANEL}, f AS (SELECT * FROM panel WHERE ahead IS NOT NULL AND before IS NOT NULL), r AS (SELECT month, before, ahead, {RANK.format(c='month', x='before')} AS a, {RANK.format(c='month', x='ahead')} AS b FROM f),
    ic AS (SELECT month, count(*) AS n, CASE WHEN count(DISTINCT before) > 1 AND count(DISTINCT ahead) > 1 AND count(*) >= 8 THEN corr(a, b) END AS ic FROM r GROUP BY month)"""


@query(f"WITH {IC} SELECT month, n, round(ic, 6) + 0.0 AS ic FROM ic")
def monthly_ic(spark, sf):
    return X.rank_correlation(panel(spark, sf), ["month"], "before", "ahead", 8).withColumn("ic", F.round("ic", 6) + 0.0)  # no negative zero


@query(f"""WITH {IC}, k AS (SELECT *, (row_number() OVER (ORDER BY month) - 1) % 3 AS k FROM ic WHERE ic IS NOT NULL),
    p AS (SELECT k, count(*) AS n, avg(ic) AS m, stddev_samp(ic) AS s, count(*) FILTER (ic > 1e-12) AS p FROM k GROUP BY k)
    SELECT count(*) FILTER (n >= 6 AND s > 0) AS classes, CAST(sum(n) AS BIGINT) AS months, round(avg(m) FILTER (n >= 6 AND s > 0), 6) AS mean_ic, round(avg(m / (s / sqrt(n))) FILTER (n >= 6 AND s > 0), 5) AS mean_t,
        round(sum(p) / sum(n), 6) AS positive_share FROM p HAVING sum(n) >= 24""")
def nonoverlap_ic(spark, sf):
    ic = X.rank_correlation(panel(spark, sf), ["month"], "before", "ahead", 8)
    return _round(_round(X.offset_summary(ic, "month", 3), "mean_ic", "positive_share"), "mean_t", digits=5)


@query(f"""WITH {PANEL}, f AS (SELECT segment, before AS s, (ahead > 0)::INT AS y FROM panel WHERE ahead IS NOT NULL AND before IS NOT NULL),
    r AS (SELECT *, {RANK.format(c='segment', x='s')} AS r FROM f)
    SELECT segment, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r GROUP BY segment""")
def auc(spark, sf):
    df = panel(spark, sf).withColumn("y", (F.col("ahead") > 0).cast("int"))
    return _round(X.auc(df, ["segment"], "before", "y", 20), "auc")


@query(f"""WITH {PANEL}, f AS (SELECT segment, n_orders > 1 AS f, ahead > 0 AS y FROM panel WHERE ahead IS NOT NULL),
    c AS (SELECT segment, count(*) FILTER (f AND y) + 0.5 AS a, count(*) FILTER (f AND NOT y) + 0.5 AS b, count(*) FILTER (NOT f AND y) + 0.5 AS c, count(*) FILTER (NOT f AND NOT y) + 0.5 AS d, count(*) AS n, count(*) FILTER (f) AS k, avg(y::INT) FILTER (f) AS rf, avg(y::INT) FILTER (NOT f) AS rn FROM f GROUP BY 1),
    o AS (SELECT *, a::DOUBLE * d / (b::DOUBLE * c) AS r, 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS h FROM c)
    SELECT segment, n, CASE WHEN t THEN round(r, 5) END AS odds_ratio, CASE WHEN t THEN round(exp(ln(r) - h), 5) END AS low, CASE WHEN t THEN round(exp(ln(r) + h), 5) END AS high,
        CASE WHEN t THEN round(rf, 5) END AS rate_flag, CASE WHEN t THEN round(rn, 5) END AS rate_no_flag FROM (SELECT *, n >= 50 AND k BETWEEN 1 AND n - 1 AS t FROM o)""")
def odds_ratio(spark, sf):
    df = panel(spark, sf).withColumns({"f": F.col("n_orders") > 1, "y": F.col("ahead") > 0})
    return _round(X.odds_ratio(df, ["segment"], "f", "y"), "odds_ratio", "low", "high", "rate_flag", "rate_no_flag", digits=5)


_REDUNDANT = ["quantity", "price", "net", "tax"]
_PAIRS = [(a, b) for i, a in enumerate(_REDUNDANT) for b in _REDUNDANT[i + 1 :]]


@query(f"""WITH l AS (SELECT l_quantity AS quantity, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS price, CASE WHEN l_linenumber <> 5 THEN l_extendedprice * (1 - l_discount) END AS net, l_tax AS tax FROM lineitem),
    r AS (SELECT {', '.join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS {c}" for c in _REDUNDANT)} FROM l),
    p AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, count({a} + {b}) AS n, corr({a}, {b}) AS rho FROM r" for a, b in _PAIRS)})
    SELECT a, b, n, round(rho, 6) AS rho FROM p WHERE n >= 200 AND abs(rho) >= 0.85""")
def redundancy(spark, sf):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("price"), F.when(F.col("l_linenumber") != 5, net).alias("net"), F.col("l_tax").alias("tax")
    )
    return _round(X.redundancy(lines, _REDUNDANT), "rho")


@query(f"""WITH {PANEL}, f AS (SELECT * FROM panel WHERE ahead IS NOT NULL), k AS (SELECT *, greatest(floor(count(*) OVER (PARTITION BY month) * 0.2), 1) AS k,
        row_number() OVER (PARTITION BY month ORDER BY spend DESC, id) AS u, row_number() OVER (PARTITION BY month ORDER BY spend, id) AS d FROM f)
    SELECT month, count(*) AS n, round(avg(ahead) FILTER (u <= k) - avg(ahead) FILTER (d <= k), 5) AS edge FROM k GROUP BY month HAVING count(DISTINCT spend) > 1""")
def top_bottom(spark, sf):
    return _round(X.top_bottom(panel(spark, sf), ["month"], "spend", "ahead", "id"), "edge", digits=5)


@query(f"""WITH {PANEL}, f AS (SELECT segment, spend AS y, before AS p FROM panel WHERE before IS NOT NULL), r AS (SELECT *, {RANK.format(c='segment', x='y')} AS a, {RANK.format(c='segment', x='p')} AS b FROM f)
    SELECT segment, count(*) AS n, round(avg(abs(y - p)), 3) AS mae, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, round(corr(y, p), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r GROUP BY segment""")
def regression_metrics(spark, sf):
    df = stats.regression_metrics(panel(spark, sf), ["segment"], "spend", "before")
    return _round(_round(df, "mae", "rmse", digits=3), "pearson", "spearman")


SCORED = "s AS (SELECT doc_id, quality AS y, toxic, ((doc_id * 7919) % 1000) / 1000.0 :: DOUBLE AS p FROM labels)"


def _scored(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"), "toxic", ((F.col("doc_id") * 7919 % 1000) / F.lit(1000.0)).alias("p"))


@query(f"""WITH {SCORED}, c AS (SELECT toxic, y, p, greatest(least(p, 1 - 1e-12), 1e-12) AS q FROM s WHERE y IS NOT NULL)
    SELECT toxic, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM c GROUP BY toxic""")
def brier_logloss(spark, sf):
    return _round(stats.classification_metrics(_scored(spark, sf), ["toxic"], "y", "p"), "brier", "log_loss")


@query(f"""WITH {SCORED} SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS observed, round(avg(y) - avg(p), 6) AS gap FROM s WHERE y IS NOT NULL GROUP BY 1""")
def calibration_bins(spark, sf):
    return _round(stats.calibration(_scored(spark, sf), "y", "p"), "mean_predicted", "observed", "gap")


@query("""WITH c AS (SELECT quality, count(*) AS n, count(*) FILTER (toxic = 1) AS k FROM labels GROUP BY 1), w AS (SELECT *, k / n AS p, 1.96 * 1.96 AS zz FROM c)
    SELECT quality, round((p + zz / 2 / n) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / 4 / n / n) / (1 + zz / n), 6) AS low,
        round((p + zz / 2 / n) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / 4 / n / n) / (1 + zz / n), 6) AS high FROM w""")
def wilson(spark, sf):
    c = table(spark, sf, "labels").groupBy("quality").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("toxic") == 1).cast("double").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return _round(c.select("quality", low.alias("low"), high.alias("high")), "low", "high")


@query(f"""WITH {PANEL}, l AS (SELECT 'spend' AS name, spend AS x FROM panel UNION ALL SELECT 'before', before FROM panel UNION ALL SELECT 'ahead', ahead FROM panel)
    SELECT name, count(x) AS n, round(avg((x IS NULL)::INT), 6) AS missing, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(quantile_cont(x, 0.1), 4) AS p10, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.9), 4) AS p90 FROM l GROUP BY name""")
def describe(spark, sf):
    df = stats.describe(panel(spark, sf), ["spend", "before", "ahead"])
    return _round(_round(df, "missing"), "mean", "std", "p10", "p50", "p90", digits=4)


@query(f"""WITH {PANEL}, r AS (SELECT segment, ahead AS r FROM panel WHERE ahead IS NOT NULL)
    SELECT segment, count(*) AS n, round(avg((r > 0)::INT), 6) AS hit_rate, round(sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0), 5) AS profit_factor, round(avg(r), 5) AS mean_r, round(quantile_cont(r, 0.5), 6) AS median_r FROM r GROUP BY segment""")
def trade_stats(spark, sf):
    df = stats.trade_stats(panel(spark, sf), ["segment"], "ahead")
    return _round(_round(df, "hit_rate", "median_r"), "profit_factor", "mean_r", digits=5)


DAILY = """d AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS day, sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END) / sum(o_totalprice) / 100 AS r FROM orders GROUP BY 1, 2)"""


def _daily(spark, sf):
    signed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.to_date("o_orderdate").alias("day")).agg((F.sum(signed) / F.sum("o_totalprice") / 100).alias("r"))


@query(f"""WITH {DAILY}, c AS (SELECT *, exp(sum(ln(1 + r)) OVER w) AS level FROM d WINDOW w AS (PARTITION BY k ORDER BY day)), e AS (SELECT *, 1 - level / greatest(max(level) OVER (PARTITION BY k ORDER BY day), 1) AS dd FROM c)
    SELECT k, count(*) AS days, round(exp(sum(ln(1 + r))) - 1, 6) AS total_return, round(pow(exp(sum(ln(1 + r))), 365.0 / (max(day) - min(day))) - 1, 6) AS cagr, round(stddev_samp(r) * sqrt(252), 6) AS vol,
        round(avg(r) * sqrt(252) / stddev_samp(r), 6) AS sharpe, round(avg(r) * sqrt(252) / (stddev_samp(r) FILTER (r < 0)), 6) AS sortino, round(max(dd), 6) AS max_drawdown FROM e GROUP BY k""")
def equity_stats(spark, sf):
    return _round(stats.equity_stats(_daily(spark, sf), ["k"], "day", "r"), "total_return", "cagr", "vol", "sharpe", "sortino", "max_drawdown")


@query(f"WITH {DAILY} SELECT day, round(sum(r * 0.2) - sum(0.0001 * 0.2), 8) AS ret, round(count(*) * 0.2, 6) AS exposure FROM d GROUP BY day")
def equity_sleeves(spark, sf):
    df = stats.equity_sleeves(_daily(spark, sf).withColumn("cost", F.lit(0.0001)), "day", 0.2, "r", "cost")
    return _round(_round(df, "ret", digits=8), "exposure")


@query(f"""WITH {DAILY}, b AS (SELECT day, r AS b FROM d WHERE k = '1-URGENT'), j AS (SELECT k, day, r, b, row_number() OVER (PARTITION BY k ORDER BY day DESC) AS i FROM d JOIN b USING (day))
    SELECT k, count(*) AS n, CASE WHEN count(*) >= 60 THEN round(covar_samp(r, b) / var_samp(b), 5) END AS beta FROM j WHERE i <= 250 GROUP BY k""")
def relative_beta(spark, sf):
    d = _daily(spark, sf)
    bench = d.filter("k = '1-URGENT'").select("day", F.col("r").alias("b"))
    return _round(stats.relative_beta(d, bench, "k", "day", "r", "b", 250, 60), "beta", digits=5)


@query("""WITH s AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS d, min(l_extendedprice / l_quantity) AS x FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY d) AS i FROM s)
    SELECT a.l_partkey, a.d, CASE WHEN count(b.x) >= 5 THEN round(100.0 * count(*) FILTER (b.x <= a.x) / count(b.x), 6) END AS pctile FROM n a LEFT JOIN n b ON a.l_partkey = b.l_partkey AND b.i BETWEEN a.i - 10 AND a.i - 1 GROUP BY a.l_partkey, a.d, a.x""")
def own_history_percentile(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_partkey", F.to_date("l_shipdate").alias("d")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    return stats.own_percentile(s, "l_partkey", "d", "x", 10, 5).select("l_partkey", "d", F.round("x_pctile", 6).alias("pctile"))


QUARTERS = """q AS (SELECT c_nationkey AS nation, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_end, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def _quarters(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("nation"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period_end")).agg(F.sum("o_totalprice").alias("value"))


@query(f"""WITH {QUARTERS}, w AS (SELECT *, count(*) OVER f AS n, sum(value) OVER f AS s, lag(period_end, 3) OVER o AS p FROM q WINDOW o AS (PARTITION BY nation ORDER BY period_end), f AS (PARTITION BY nation ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT nation, period_end, CASE WHEN n = 4 AND date_diff('month', p, period_end) = 9 THEN round(s, 2) END AS ttm, CASE WHEN n < 4 THEN 'NOT_ENOUGH_HISTORY' WHEN date_diff('month', p, period_end) <> 9 THEN 'GAP' END AS ttm_reason FROM w""")
def ttm(spark, sf):
    return P.trailing_year(_quarters(spark, sf), ["nation"]).select("nation", "period_end", F.round("ttm", 2).alias("ttm"), "ttm_reason")


@query(f"WITH {QUARTERS}, l AS (SELECT *, lag(value, 4) OVER (PARTITION BY nation ORDER BY period_end) AS b FROM q) SELECT nation, period_end, round(CASE WHEN b > 0 THEN value / b - 1 END, 6) AS yoy FROM l")
def yoy_lag4(spark, sf):
    return P.growth(_quarters(spark, sf), ["nation"], "period_end", "value", 4, "yoy").select("nation", "period_end", F.round("yoy", 6).alias("yoy"))


#: Year-to-date facts: 3, 6, 9 and 12 months, of which some three-month ones are reported too.
FACTS = f"""{QUARTERS}, y AS (SELECT nation, CAST(date_trunc('year', period_end) AS DATE) AS ys, period_end, sum(value) OVER (PARTITION BY nation, date_trunc('year', period_end) ORDER BY period_end) AS ytd, value FROM q)"""


def _facts(spark, sf):
    q = _quarters(spark, sf).withColumn("ys", F.to_date(F.date_trunc("year", "period_end")))
    q = q.withColumn("ytd", F.sum("value").over(Window.partitionBy("nation", "ys").orderBy("period_end")))
    end = F.date_sub(F.add_months("period_end", 3), 1)
    months = F.when(F.add_months("period_end", 0).isNotNull(), P.months_of(F.col("ys"), end))
    ytd = q.select("nation", F.col("ys").alias("period_start"), end.alias("period_end"), months.alias("months"), F.col("ytd").alias("value"))
    direct = q.filter("month(period_end) = 10 and nation % 2 = 0").select("nation", F.col("period_end").alias("period_start"), end.alias("period_end"), F.lit(3).alias("months"), "value")
    return ytd.unionByName(direct)


@query(f"""WITH {FACTS} SELECT nation, CAST(period_end + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, round(value, 2) AS value,
    CASE WHEN month(period_end) = 1 OR (month(period_end) = 10 AND nation % 2 = 0) THEN 'DIRECT' ELSE 'DIFFERENCE' END AS source FROM y
    WHERE month(period_end) = 1 OR (month(period_end) = 10 AND nation % 2 = 0) OR EXISTS (SELECT 1 FROM q p WHERE p.nation = y.nation AND p.period_end = y.period_end - INTERVAL 3 MONTH)""")
def discrete_quarters(spark, sf):
    return _round(P.discrete_quarters(_facts(spark, sf), ["nation"]), "value", digits=2)


@query(f"""WITH {FACTS}, e AS (SELECT nation, max(period_end) AS pe FROM q GROUP BY 1), l AS (SELECT e.nation, pe, y.ytd, month(pe) AS m FROM e JOIN y ON y.nation = e.nation AND y.period_end = pe)
    SELECT l.nation, CAST(pe + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, CASE WHEN m = 10 THEN 'ANNUAL' ELSE 'ROLLED' END AS method,
        round(CASE WHEN m = 10 THEN l.ytd ELSE a.ytd + l.ytd - b.ytd END, 2) AS ttm
    FROM l LEFT JOIN y a ON a.nation = l.nation AND a.period_end = date_trunc('year', pe) - INTERVAL 3 MONTH LEFT JOIN y b ON b.nation = l.nation AND b.period_end = pe - INTERVAL 12 MONTH""")
def ttm_from_annual(spark, sf):
    return _round(P.ttm_from_annual(_facts(spark, sf), ["nation"]), "ttm", digits=2)


@query("""WITH f AS (SELECT o_custkey, o_orderstatus AS tag, max(o_totalprice) AS value FROM orders GROUP BY 1, 2), g AS (SELECT o_custkey, arg_min(value, list_position(['F', 'O', 'P'], tag)) AS v, arg_min(tag, list_position(['F', 'O', 'P'], tag)) AS tag, min(value) AS lo, max(value) AS hi, count(*) AS n_tags FROM f GROUP BY 1)
    SELECT o_custkey, CASE WHEN hi - lo <= 0.25 * greatest(abs(lo), abs(hi)) THEN v END AS value, tag, n_tags, CASE WHEN hi - lo > 0.25 * greatest(abs(lo), abs(hi)) THEN 'CONFLICT' END AS reason FROM g""")
def tag_priority(spark, sf):
    f = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("tag")).agg(F.max("o_totalprice").alias("value"))
    return P.by_priority(f, ["o_custkey"], ["F", "O", "P"], 0.25)


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS a, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 0 ELSE c_acctbal - 2000 END AS b FROM customer),
    t AS (SELECT *, CASE WHEN a IS NULL THEN 'MISSING_NUMERATOR' WHEN b IS NULL THEN 'MISSING_DENOMINATOR' WHEN b = 0 THEN 'ZERO_DENOMINATOR' WHEN b < 0 THEN 'NEGATIVE_DENOMINATOR' END AS reason FROM r)
    SELECT c_custkey, round(CASE WHEN reason IS NULL THEN a / b END, 5) AS value, reason FROM t""")
def ratio_with_reason(spark, sf):
    c = table(spark, sf, "customer")
    a = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))
    b = F.when(F.col("c_custkey") % 7 == 0, None).when(F.col("c_custkey") % 11 == 0, 0.0).otherwise(F.col("c_acctbal") - 2000)
    return c.select("c_custkey", P.ratio(a, b).alias("r")).select("c_custkey", F.round("r.value", 5).alias("value"), "r.reason")


@query("""WITH d AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
    f AS (SELECT 'quality' AS feature, lang, source, quality IS NULL AS gone FROM d UNION ALL SELECT 'toxic', lang, source, toxic IS NULL FROM d UNION ALL SELECT 'lang', lang, source, lang IS NULL FROM d)
    SELECT feature, CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'ALL' END AS stratum, coalesce(lang, source) AS value, count(*) AS n, count(*) FILTER (gone) AS missing
    FROM f GROUP BY GROUPING SETS ((feature), (feature, lang), (feature, source))""")
def missingness_grouping_sets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return Q.missingness(d, ["quality", "toxic", "lang"], ["lang", "source"])


CHECKS = "CASE WHEN d.text IS NULL OR length(d.text) < 200 THEN 'TOO_SHORT' WHEN l.quality IS NULL THEN 'NO_LABEL' WHEN l.quality = 0 THEN 'LOW_QUALITY' WHEN l.toxic = 1 THEN 'TOXIC' ELSE 'ELIGIBLE' END"


def _checked(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.length("text").alias("chars")).join(table(spark, sf, "labels"), "doc_id", "left")
    return d, [("TOO_SHORT", F.col("chars") >= 200), ("NO_LABEL", F.col("quality").isNotNull()), ("LOW_QUALITY", F.col("quality") != 0), ("TOXIC", F.col("toxic") != 1)]


@query(f"SELECT {CHECKS} AS reason, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def funnel_first_reason(spark, sf):
    return Q.funnel(*_checked(spark, sf))


@query("""WITH d AS (SELECT length(d.text) AS c, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)), r AS (SELECT unnest([CASE WHEN c IS NULL OR c < 200 THEN 'TOO_SHORT' END, CASE WHEN quality IS NULL THEN 'NO_LABEL' END,
        CASE WHEN quality IS NULL OR quality = 0 THEN 'LOW_QUALITY' END, CASE WHEN toxic IS NULL OR toxic = 1 THEN 'TOXIC' END]) AS reason FROM d)
    SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def blocking_summary(spark, sf):
    return Q.blocking(*_checked(spark, sf))


@query("""SELECT o_orderkey, c AS "check" FROM (SELECT o_orderkey, unnest([CASE WHEN o_totalprice >= 400000 THEN 'PRICE' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'STATUS' END, CASE WHEN c_custkey IS NULL THEN 'CUSTOMER' END]) AS c FROM orders LEFT JOIN customer ON o_custkey = c_custkey) WHERE c IS NOT NULL""")
def dq_checks(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return Q.violations(o, ["o_orderkey"], [("PRICE", F.col("o_totalprice") < 400000), ("STATUS", F.col("o_orderstatus").isin("F", "O")), ("CUSTOMER", F.col("c_custkey").isNotNull())])


@query("""WITH e AS (SELECT c_mktsegment AS segment, c_custkey AS k FROM customer), h AS (SELECT c_mktsegment AS segment, count(DISTINCT o_custkey) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    j AS (SELECT segment, coalesce(any_value(p), 0) AS present, count(DISTINCT k) AS expected FROM e LEFT JOIN h USING (segment) GROUP BY 1)
    SELECT segment, present, expected, round(present / expected, 6) AS ratio, CASE WHEN present / expected >= 0.98 THEN 'COMPLETE' WHEN present / expected >= 0.8 THEN 'PARTIAL' WHEN present > 0 THEN 'SPARSE' ELSE 'MISSING' END AS status FROM j""")
def coverage(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("k"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).join(c, "k")
    return _round(Q.coverage(o, c, ["segment"], "k"), "ratio")


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS members, bool_and(o_orderstatus <> 'P') AS ok FROM orders GROUP BY 1")
def all_proven(spark, sf):
    return Q.all_proven(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_orderstatus") != "P").alias("known")), ["day"], "known")


@query("SELECT c_custkey FROM customer ORDER BY sha256('pilot|' || c_custkey), c_custkey LIMIT 25")
def deterministic_sample(spark, sf):
    return Q.deterministic_sample(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 25, "pilot")


FOLDS = """f AS (SELECT row_number() OVER (ORDER BY a) AS fold, DATE '1995-01-01' AS train_start, CAST(a + INTERVAL 24 MONTH AS DATE) AS train_end, CAST(a + INTERVAL 27 MONTH AS DATE) AS val_start, CAST(a + INTERVAL 33 MONTH AS DATE) AS val_end,
        CAST(a + INTERVAL 33 MONTH AS DATE) AS test_start, CAST(a + INTERVAL 39 MONTH AS DATE) AS test_end FROM range(DATE '1995-01-01', DATE '2001-08-02', INTERVAL 6 MONTH) t(a) WHERE a + INTERVAL 39 MONTH <= DATE '2001-09-01')"""


def _folds(spark):
    return splits.plan_folds(spark, "1995-01-01", "2001-08-01", 24, 6, 6, 6, 3)


@query(f"WITH {FOLDS} SELECT * FROM f")
def walk_forward_folds(spark, sf):
    return _folds(spark).withColumn("fold", F.col("fold").cast("long"))


ASSIGNED = f"""{FOLDS}, {PANEL}, o AS (SELECT *, CAST(month + INTERVAL 3 MONTH AS DATE) AS label_end, CAST(month + INTERVAL 3 MONTH AS DATE) + CAST(id % 40 AS INT) AS known FROM panel),
    a AS (SELECT o.*, fold, val_start, CASE WHEN month < train_end THEN CASE WHEN known > val_start THEN 'UNAVAILABLE' WHEN label_end >= val_start THEN 'PURGED' ELSE 'TRAIN' END WHEN month < val_start THEN 'EMBARGOED' WHEN month < val_end THEN 'VALIDATION' ELSE 'TEST' END AS role
        FROM o JOIN f ON month >= train_start AND month < test_end)"""


def _assigned(spark, sf):
    o = panel(spark, sf).withColumn("label_end", F.add_months("month", 3)).withColumn("known", F.date_add(F.add_months("month", 3), (F.col("id") % 40).cast("int")))
    return splits.assign(o, _folds(spark), "month", "label_end", "known")


@query(f"WITH {ASSIGNED} SELECT fold, role, count(*) AS n FROM a GROUP BY 1, 2")
def purge_counts(spark, sf):
    return _assigned(spark, sf).groupBy(F.col("fold").cast("long").alias("fold"), "role").agg(F.count("*").alias("n"))


@query(f"WITH {ASSIGNED} SELECT fold, count(*) FILTER (role = 'TRAIN') AS train, count(*) FILTER (role IN ('VALIDATION', 'TEST')) AS evaluated, 0 :: BIGINT AS leaks FROM a GROUP BY 1")
def fold_integrity(spark, sf):
    return splits.integrity(_assigned(spark, sf), "id", "label_end", "known").withColumn("fold", F.col("fold").cast("long"))


@query(f"""WITH {ASSIGNED}, c AS (SELECT fold, quantile_cont(before, 0.5) AS m, quantile_cont(before, 0.01) AS lo, quantile_cont(before, 0.99) AS hi FROM a WHERE role = 'TRAIN' GROUP BY 1),
    s AS (SELECT fold, avg(least(greatest(coalesce(before, m), lo), hi)) AS mean, stddev_pop(least(greatest(coalesce(before, m), lo), hi)) AS std FROM a JOIN c USING (fold) WHERE role = 'TRAIN' GROUP BY 1)
    SELECT a.fold, role, count(*) AS n, round(avg((least(greatest(coalesce(before, m), lo), hi) - mean) / CASE WHEN std = 0 THEN 1 ELSE std END), 5) + 0.0 AS mean_x, count(*) FILTER (before IS NULL) AS imputed
    FROM a JOIN c USING (fold) JOIN s USING (fold) GROUP BY 1, 2""")
def train_only_scaling(spark, sf):
    a = _assigned(spark, sf)
    x = splits.standardise(a, splits.train_only_fit(a, ["fold"], ["before"]), ["fold"], ["before"])
    return x.groupBy(F.col("fold").cast("long").alias("fold"), "role").agg(F.count("*").alias("n"), (F.round(F.avg("before_x"), 5) + 0.0).alias("mean_x"), F.count_if("before_imputed").alias("imputed"))


_SUMS = {a + b: f"sum((x{a} - m{a}) * ({'y' if b == 'y' else f'x{b}'} - m{b}))" for a, b in ("11", "12", "22", "1y", "2y")}


@query(f"""WITH {ASSIGNED}, r AS (SELECT fold, before / 100000 AS x1, n_orders :: DOUBLE AS x2, ahead AS y FROM a WHERE role = 'TRAIN' AND before IS NOT NULL AND ahead IS NOT NULL),
    mm AS (SELECT fold, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM r GROUP BY 1),
    s AS (SELECT fold, n, m1, m2, my, {_SUMS['11']} + 1 AS a, {_SUMS['12']} AS b, {_SUMS['22']} + 1 AS c, {_SUMS['1y']} AS u, {_SUMS['2y']} AS v FROM r JOIN mm USING (fold) GROUP BY ALL),
    k AS (SELECT *, (c * u - b * v) / (a * c - b * b) AS k1, (a * v - b * u) / (a * c - b * b) AS k2 FROM s)
    SELECT fold, n, round(k1, 7) AS before_coefficient, round(k2, 7) AS orders_coefficient, round(my - k1 * m1 - k2 * m2, 7) AS intercept FROM k""")
def fold_models(spark, sf):
    """A ridge model of each fold's training rows: growth by the month before and the number of orders."""
    rows = _assigned(spark, sf).filter("role = 'TRAIN'").select(F.col("fold").cast("long").alias("fold"), (F.col("before") / 100000).alias("x1"), F.col("n_orders").alias("x2"), F.col("ahead").alias("y"))
    m = models.ridge(rows, ["fold"], ["x1", "x2"], "y", 1.0)
    return m.select("fold", "n", *[F.round(c, 7).alias(n) for c, n in ((F.get("coefficients", F.lit(0)), "before_coefficient"), (F.get("coefficients", F.lit(1)), "orders_coefficient"), (F.col("intercept"), "intercept"))])


@query()
def fold_predictions(spark, sf):
    """Expected growth and the chance of growth of the rows after each fold's training, by models of the training rows alone. No SQL twin for the rounds of the logistic model; a test fits the same by a plain solver."""
    rows = _assigned(spark, sf).select(F.col("fold").cast("long").alias("fold"), "id", "month", "role", "before", "n_orders", "ahead", (F.col("ahead") > 0).cast("int").alias("grew"))
    return models.walk_forward(rows, ["fold"], ["before", "n_orders"], "ahead", "grew").select("fold", "id", "month", "role", "predicted", "p")


@query("SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i] :: DOUBLE * i)) + 0.5, 5) AS score FROM embeddings")
def linear_score(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(splits.linear_score(F.col("embedding"), range(1, 65), 0.5), 5).alias("score"))


@query("""WITH s AS (SELECT p_partkey, p_name, lower(p_name) AS n, 1 - levenshtein(lower(p_name), 'ed widget') / greatest(length(p_name), 9) AS near FROM part),
    k AS (SELECT *, CASE WHEN n = 'ed widget' THEN 'EXACT' WHEN starts_with(n, 'ed widget') THEN 'PREFIX' WHEN contains(n, 'ed widget') THEN 'CONTAINS' WHEN near >= 0.6 THEN 'FUZZY' END AS kind FROM s)
    SELECT p_partkey, p_name, CASE kind WHEN 'EXACT' THEN 100.0 WHEN 'PREFIX' THEN 80.0 WHEN 'CONTAINS' THEN 60.0 ELSE round(near * 50, 6) END AS score, kind FROM k WHERE kind IS NOT NULL ORDER BY score DESC, p_name, p_partkey LIMIT 20""")
def search_ranked(spark, sf):
    return search.ranked_search(table(spark, sf, "part"), "p_partkey", "p_name", "ed widget", 20)


@query("""WITH c AS (SELECT c_custkey, c_acctbal AS balance, c_nationkey :: DOUBLE AS nation, c_custkey % 3 = 0 AS held FROM customer), r AS (SELECT *, coalesce(balance >= 1000, FALSE) AS a, coalesce(nation < 12, FALSE) AS b, coalesce(balance < 0, FALSE) AS x FROM c)
    SELECT c_custkey, CASE WHEN held AND x THEN 'EXIT' WHEN held THEN 'HOLD' WHEN a AND b THEN 'ENTER' ELSE 'NO_ACTION' END AS decision,
        concat_ws(',', CASE WHEN a THEN 'balance>=1000' END, CASE WHEN b THEN 'nation<12' END) AS passed, concat_ws(',', CASE WHEN NOT a THEN 'balance>=1000' END, CASE WHEN NOT b THEN 'nation<12' END) AS failed FROM r""")
def strategy_rules(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_custkey") % 3 == 0).alias("held"))
    return search.evaluate_rules(c, [("balance", ">=", 1000), ("nation", "<", 12)], [("balance", "<", 0)], "held").select("c_custkey", "decision", "passed", "failed")


@query(f"""WITH {PANEL}, p AS (SELECT id, month, before, spend - before AS a, 2.0 - n_orders AS b FROM panel), s AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE 2 END + 1 AS t, coalesce(sign(a), 0) * 2 + sign(b) AS p FROM p)
    SELECT id, month, round(p * 100.0 / t, 6) AS score, CASE WHEN coalesce(before > 300000, FALSE) THEN 'SELL' WHEN p * 100.0 / t >= 40 THEN 'ADD' WHEN p * 100.0 / t <= -40 THEN 'SELL' ELSE 'HOLD' END AS call FROM s""")
def weighted_review(spark, sf):
    p = panel(spark, sf).withColumns({"a": F.col("spend") - F.col("before"), "b": 2.0 - F.col("n_orders")})
    return search.weighted_review(p, {"a": 2.0, "b": 1.0}, F.col("before") > 300000).select("id", "month", F.round("score", 6).alias("score"), "call")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT p_partkey, sha256(p_partkey || '|' || coalesce(p_name, '') || '|' || coalesce(p_brand, '') || '|' || coalesce(p_size :: VARCHAR, '')) AS h FROM part")
def content_hash(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.content_hash(*map(F.col, ("p_partkey", "p_name", "p_brand", "p_size"))).alias("h"))


@query("SELECT o_orderkey, extract(isoyear FROM o_orderdate) || '-W' || lpad(extract(week FROM o_orderdate) :: VARCHAR, 2, '0') AS week, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def period_keys(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.week_key(F.to_date("o_orderdate")).alias("week"), S.period_key(F.to_date("o_orderdate"), "MONTHLY").alias("month"))


@query("SELECT c_custkey, trim(regexp_replace(upper(c_name), '[^A-Z0-9]+', ' ', 'g')) AS name FROM customer")
def normal_names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.normal_name(F.col("c_name")).alias("name"))


@query(r"""WITH n AS (SELECT c_custkey, c_name || CASE c_custkey % 5 WHEN 0 THEN ' & Cos., Inc. Cl A' WHEN 1 THEN ' Holdings PLC' WHEN 2 THEN ' The Group (Class B)' WHEN 3 THEN ' Ordinary Shares' ELSE '' END AS name FROM customer)
    SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(name), '&', ' and '), '\bcl(?:ass)?\.?\s+([a-z])\b', 'class \1', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\bcos\b', 'companies', 'g'),
        '\b(inc|incorporated|corp|corporation|co|company|plc|ltd|limited|llc|lp|nv|sa|ag|se|holdings?|group|the|de|ordinary|shares?|common|stock)\b', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM n""")
def holding_keys(spark, sf):
    k = F.col("c_custkey") % 5
    added = F.when(k == 0, " & Cos., Inc. Cl A").when(k == 1, " Holdings PLC").when(k == 2, " The Group (Class B)").when(k == 3, " Ordinary Shares").otherwise("")
    return table(spark, sf, "customer").select("c_custkey", S.holding_key(F.concat("c_name", added)).alias("key"))
