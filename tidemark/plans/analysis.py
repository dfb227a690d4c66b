"""Queries of analysis labels, fundamental features, valuation over time and vendor columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import provenance as P
from ..operators import valuation as V
from ..operators.lineage import cut
from ..sources import vendors
from ..sources.tables import table
from .registry import query

#: Facts made of customers, each missing for some.
FACTS = {
    "a": ("c_acctbal / 20000", 3), "b": ("c_acctbal / 50000", 4), "c": ("c_acctbal / 60000 - 0.02", 5), "d": ("(c_custkey % 20) / 10.0", 6), "e": ("c_acctbal / 10000 - 0.3", 7),
    "p": ("(c_custkey * 37 % 101) * 1.0", 3), "q": ("(c_custkey * 53 % 101) * 1.0", 4), "r": ("(c_custkey * 71 % 101) * 1.0", 2), "v": ("0.1 + (c_custkey % 50) / 100.0", 11), "m": ("-(c_custkey % 45) / 100.0", 9),
}
_FACTS = "f AS (SELECT c_custkey, c_phone_code, " + ", ".join(f"CASE WHEN c_custkey % {n} <> 1 THEN {x} END AS {k}" for k, (x, n) in FACTS.items()) + " FROM (SELECT *, lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '11' AS c_phone_code FROM customer))"


def _sum(conds: list[str]) -> str:
    return "(" + " + ".join(f"coalesce(({c})::INT, 0)" for c in conds) + ")"


def _known(names: str) -> str:
    return "(" + " + ".join(f"({n} IS NOT NULL)::INT" for n in names) + ")"


_CHECKS = ["a > 0.10", "b > 0.05", "c > 0.05", "d >= 0.8", "e > 0"]
_VAL = "(coalesce(p, 0) + coalesce(q, 0) + coalesce(100 - r, 0)) / nullif((p IS NOT NULL)::INT + (q IS NOT NULL)::INT + (r IS NOT NULL)::INT, 0)"


def _strong(n: str, good: str) -> str:
    return f"CASE WHEN {n} < 3 THEN 'Insufficient' WHEN {good} >= 4 THEN 'Strong' WHEN {good} >= 2 THEN 'Moderate' ELSE 'Weak' END"


@query(f"""WITH {_FACTS} SELECT c_custkey, {_strong(_known('abcde'), _sum(_CHECKS))} AS fundamentals, {_strong(_known('abcde'), _sum([f'{x} > 0.05' for x in 'abcde']))} AS growth,
    CASE WHEN {_VAL} IS NULL THEN 'Insufficient' WHEN {_VAL} <= 30 THEN 'Cheap' WHEN {_VAL} >= 70 THEN 'Expensive' ELSE 'Fair' END AS valuation,
    CASE WHEN {_known('abe')} < 2 THEN 'Insufficient' WHEN {_sum([f'{x} > 0.05' for x in 'abe'])} = {_known('abe')} THEN 'Strong' WHEN {_sum([f'{x} > 0.05' for x in 'abe'])} > {_sum([f'{x} < -0.05' for x in 'abe'])} THEN 'Positive' WHEN {_sum([f'{x} < -0.05' for x in 'abe'])} > {_sum([f'{x} > 0.05' for x in 'abe'])} THEN 'Negative' ELSE 'Mixed' END AS momentum,
    CASE WHEN {_known('bce')} < 2 THEN 'Insufficient' WHEN {_sum([f'{x} > 0' for x in 'bce'])} = {_known('bce')} THEN 'Outperforming' WHEN {_sum([f'{x} > 0' for x in 'bce'])} = 0 THEN 'Underperforming' ELSE 'Mixed' END AS relative_strength,
    CASE WHEN v IS NULL THEN 'Insufficient' WHEN CASE WHEN v < 0.22 THEN 0 WHEN v < 0.38 THEN 1 ELSE 2 END + CASE WHEN m IS NULL OR m > -0.15 THEN 0 WHEN m > -0.30 THEN 1 ELSE 2 END <= 1 THEN 'Low'
        WHEN CASE WHEN v < 0.22 THEN 0 WHEN v < 0.38 THEN 1 ELSE 2 END + CASE WHEN m IS NULL OR m > -0.15 THEN 0 WHEN m > -0.30 THEN 1 ELSE 2 END <= 2 THEN 'Moderate' ELSE 'High' END AS risk,
    CASE {' '.join(f"WHEN substr(c_phone_code, 1, 2) BETWEEN '{lo}' AND '{hi}' THEN '{n}'" for lo, hi, n in L.DIVISIONS)} END AS sector FROM f""")
def analysis_labels(spark, sf):
    c = table(spark, sf, "customer")
    f = c.select("c_custkey", F.concat(F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("11")).alias("code"), *[F.expr(f"case when c_custkey % {n} <> 1 then cast({x} as double) end").alias(k) for k, (x, n) in FACTS.items()])
    x = {k: F.col(k) for k in FACTS}
    return f.select(
        "c_custkey", L.fundamentals(*[x[k] for k in "abcde"]).alias("fundamentals"), L.growth([x[k] for k in "abcde"]).alias("growth"), L.valuation(x["p"], x["q"], x["r"]).alias("valuation"), L.momentum([x[k] for k in "abe"]).alias("momentum"),
        L.relative_strength([x[k] for k in "bce"]).alias("relative_strength"), L.risk(x["v"], x["m"]).alias("risk"), L.sector(F.col("code")).alias("sector"),
    )


#: Quarterly reports of nations: flows by shares of the revenue, instants from counts of orders; some are missing.
QUARTERS = """q AS (SELECT c_nationkey AS nation, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_end, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18, 2)) ELSE 0 END) AS DOUBLE) AS part, count(*) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    r AS (SELECT nation, period_end, revenue, part * 0.8 AS gross_profit, part * 0.5 - revenue * 0.1 AS operating_income, part * 0.4 - revenue * 0.15 AS net_income, CASE WHEN n % 17 <> 0 THEN part * 0.45 END AS cfo, revenue * 0.07 AS capex,
        CASE WHEN n % 13 <> 0 THEN n * 1000.0 + revenue END AS assets, n * 400.0 - 2000 AS equity, n * 50.0 AS cash, CASE WHEN n % 3 <> 0 THEN n * 90.0 END AS debt, CASE WHEN n % 11 <> 0 THEN 100.0 + nation END AS shares FROM q)"""
_TTM = ", ".join(f"CASE WHEN count({f}) OVER f4 = 4 AND date_diff('month', lag(period_end, 3) OVER w, period_end) = 9 THEN sum({f}) OVER f4 END AS {f}_ttm" for f in V.FLOWS)
_PRIOR = ", ".join(f"CASE WHEN date_diff('month', lag(period_end, 4) OVER w, period_end) = 12 THEN lag({f}_ttm, 4) OVER w END AS {f}_prior" for f in V.FLOWS)
_AVERAGE = ", ".join(f"({i} + CASE WHEN date_diff('month', lag(period_end, 4) OVER w, period_end) = 12 THEN lag({i}, 4) OVER w END) / 2 AS {i}_avg" for i in ("assets", "equity"))
TRAILED = f"""{QUARTERS}, t AS (SELECT *, {_TTM} FROM r WINDOW w AS (PARTITION BY nation ORDER BY period_end), f4 AS (PARTITION BY nation ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    u AS (SELECT *, {_PRIOR}, {_AVERAGE}, CASE WHEN date_diff('month', lag(period_end, 4) OVER w, period_end) = 12 THEN lag(shares, 4) OVER w END AS shares_prior FROM t WINDOW w AS (PARTITION BY nation ORDER BY period_end)),
    x AS (SELECT *, CASE WHEN capex_ttm >= 0 THEN cfo_ttm - capex_ttm END AS fcf_ttm, CASE WHEN capex_prior >= 0 THEN cfo_prior - capex_prior END AS fcf_prior FROM u)"""


def _quarters(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    price, n = F.col("o_totalprice").cast("decimal(18,2)"), F.col("n")
    q = o.groupBy(F.col("c_nationkey").alias("nation"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period_end")).agg(
        F.sum(price).cast("double").alias("revenue"), F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", price)), F.lit(0)).cast("double").alias("part"), F.count("*").alias("n")
    )
    return q.select(
        "nation", "period_end", "revenue", (F.col("part") * 0.8).alias("gross_profit"), (F.col("part") * 0.5 - F.col("revenue") * 0.1).alias("operating_income"), (F.col("part") * 0.4 - F.col("revenue") * 0.15).alias("net_income"),
        F.when(n % 17 != 0, F.col("part") * 0.45).alias("cfo"), (F.col("revenue") * 0.07).alias("capex"), F.when(n % 13 != 0, n * 1000.0 + F.col("revenue")).alias("assets"), (n * 400.0 - 2000).alias("equity"), (n * 50.0).alias("cash"),
        F.when(n % 3 != 0, n * 90.0).alias("debt"), F.when(n % 11 != 0, 100.0 + F.col("nation")).alias("shares"),
    )


def _trailed(spark, sf):
    return V.trailing(_quarters(spark, sf), ["nation"], "period_end", instants=("assets", "equity"))


def _ratio(a: str, b: str, less: str = "") -> tuple[str, str]:
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}){less} END", f"CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN 'missing_fundamental' WHEN ({b}) <= 0 THEN 'denominator_invalid' END"


_OUT = {f"{k}_ttm": (f"{k}_ttm", f"CASE WHEN {k}_ttm IS NULL THEN 'missing_fundamental' END") for k in (*V.FLOWS, "fcf")}
_OUT |= {f"{k}_growth": _ratio(f"{k}_ttm", f"{k}_prior", " - 1") for k in ("revenue", "operating_income", "net_income", "fcf")}
_OUT |= {f"{n}_margin": _ratio(f"{k}_ttm", "revenue_ttm") for n, k in (("gross", "gross_profit"), ("operating", "operating_income"), ("net", "net_income"), ("fcf", "fcf"))}
_OUT |= {"roa": _ratio("net_income_ttm", "assets_avg"), "roe": _ratio("net_income_ttm", "equity_avg"), "cfo_to_net_income": _ratio("cfo_ttm", "net_income_ttm"), "accruals_to_assets": _ratio("net_income_ttm - cfo_ttm", "assets_avg")}
_OUT |= {"cash_to_assets": _ratio("cash", "assets"), "debt_to_assets": _ratio("debt", "assets"), "shares_growth": _ratio("shares", "shares_prior", " - 1")}


@query(f"""WITH {TRAILED}, l AS ({' UNION ALL '.join(f"SELECT nation, period_end, '{k}' AS feature, {v} AS value, {r} AS reason FROM x" for k, (v, r) in _OUT.items())})
    SELECT nation, period_end, feature, round(value, 5) + 0.0 AS value, reason FROM l""")
def fundamental_features(spark, sf):
    return V.fundamental_features(_trailed(spark, sf), ["nation"], "period_end").withColumn("value", F.round("value", 5) + 0.0)


#: How many quarters before its own each feature reads.
ROWS_BACK = {"cash_to_assets": 0, "debt_to_assets": 0} | {f"{k}_ttm": 3 for k in (*V.FLOWS, "fcf")} | {f"{k}_margin": 3 for k in ("gross", "operating", "net", "fcf")} | {"cfo_to_net_income": 3}
ROWS_BACK |= dict.fromkeys(("roa", "roe", "accruals_to_assets", "shares_growth"), 4) | {f"{k}_growth": 7 for k in ("revenue", "operating_income", "net_income", "fcf")}
_BACK = "CASE feature " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in ROWS_BACK.items()) + " END"


def _features(facts, keys):
    return V.fundamental_features(V.trailing(facts, keys, "period_end", instants=("assets", "equity")), keys, "period_end")


@query(f"""WITH {TRAILED}, l AS ({' UNION ALL '.join(f"SELECT nation, period_end, '{k}' AS feature, {v} AS value, {r} AS reason FROM x" for k, (v, r) in _OUT.items())}),
    o AS (SELECT nation, period_end, row_number() OVER (PARTITION BY nation ORDER BY period_end) AS i FROM r), b AS (SELECT *, greatest(i - {_BACK}, 1) AS j FROM l JOIN o USING (nation, period_end))
    SELECT b.nation, b.period_end, feature, round(value, 5) + 0.0 AS value, reason, b.i - b.j + 1 AS n_inputs, o.period_end AS oldest, 'SAME' AS status FROM b JOIN o ON o.nation = b.nation AND o.i = b.j""")
def explained_features(spark, sf):
    """Each fundamental feature with how many stored quarters it names, the oldest of them, and whether those alone make it again."""
    facts = cut(P.named(_quarters(spark, sf)))
    values = P.explained(facts, ["nation"], "period_end", _features, ROWS_BACK)
    oldest = facts.select(F.col("source_id").alias("__s"), F.col("period_end").alias("oldest"))
    again = P.rebuilt(values, facts, ["nation"], "period_end", _features, ROWS_BACK).join(oldest, F.col("inputs")[0] == F.col("__s"))
    return again.select("nation", "period_end", "feature", (F.round("value", 5) + 0.0).alias("value"), "reason", "n_inputs", "oldest", "status")


_OVER = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} END"
VALUED = f"""{TRAILED}, m AS (SELECT *, CAST(CASE WHEN shares IS NOT NULL THEN (10 + CAST(cash / 50 AS BIGINT) % 7) * shares END AS DOUBLE) AS market_cap FROM x), e AS (SELECT *, market_cap + debt - cash AS ev FROM m),
    v AS (SELECT *, net_income_ttm / nullif(market_cap, 0) AS earnings_yield, {_OVER('market_cap', 'net_income_ttm')} AS pe, {_OVER('market_cap', 'revenue_ttm')} AS price_to_sales, {_OVER('market_cap', 'equity')} AS price_to_book, fcf_ttm / nullif(market_cap, 0) AS fcf_yield, {_OVER('ev', 'revenue_ttm')} AS ev_to_sales FROM e)"""


def _valued(spark, sf):
    t = _trailed(spark, sf)
    n = F.col("cash") / 50.0
    t = t.withColumns({"price": (10 + n % 7), "price_date": F.col("period_end"), "shares_date": F.col("period_end"), "split_factor": F.lit(1.0)})
    return V.multiples(t)


_V = ("earnings_yield", "pe", "price_to_sales", "price_to_book", "fcf_yield", "ev_to_sales")


@query(f"""WITH {VALUED} SELECT nation, period_end, round(market_cap, 3) AS market_cap, {', '.join(f'round({k} * 1000, 5) + 0.0 AS {k}' for k in _V)}, CASE WHEN shares IS NULL THEN 'missing_fundamental' END AS reason FROM v""")
def valuation_multiples(spark, sf):
    v = _valued(spark, sf)
    return v.select("nation", "period_end", F.round("market_cap", 3).alias("market_cap"), *[(F.round(F.col(k) * 1000, 5) + 0.0).alias(k) for k in _V], "reason")


@query(f"""WITH {VALUED}, n AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY period_end) AS i FROM v)
    SELECT a.nation, a.period_end, {', '.join(f"CASE WHEN count(b.{k}) >= 6 AND any_value(a.{k}) IS NOT NULL THEN round(100.0 * count(*) FILTER (b.{k} <= a.{k}) / count(b.{k}), 6) END AS {k}_pctile" for k in V.MULTIPLES)}
    FROM n a LEFT JOIN n b ON a.nation = b.nation AND b.i BETWEEN a.i - 20 AND a.i - 1 GROUP BY a.nation, a.period_end""")
def valuation_history(spark, sf):
    """Each date's multiples among the twenty quarters before it."""
    v = V.valuation_history(_valued(spark, sf), "nation", "period_end", 20, 6)
    return v.select("nation", "period_end", *[F.round(f"{k}_pctile", 6).alias(f"{k}_pctile") for k in V.MULTIPLES])


@query("""WITH b AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'JPY' END AS currency, CAST(o_orderdate AS DATE) AS d, o_totalprice AS level FROM orders),
    r AS (SELECT c AS currency, CAST(d AS DATE) AS rate_day, 0.5 + (date_diff('day', DATE '1990-01-01', CAST(d AS DATE)) % 97) / 100.0 AS usd_per_unit FROM range(DATE '1992-01-01', DATE '1998-06-01', INTERVAL 9 DAY) t(d), (VALUES ('EUR'), ('JPY')) v(c))
    SELECT o_orderkey, CASE WHEN b.currency = 'USD' THEN round(level, 4) WHEN d - r.rate_day <= 5 THEN round(level * usd_per_unit, 4) END AS level_usd, CASE WHEN d - r.rate_day <= 5 THEN r.rate_day END AS rate_day
    FROM b ASOF LEFT JOIN r ON b.currency = r.currency AND b.d >= r.rate_day""")
def levels_in_dollars(spark, sf):
    k = F.col("o_custkey") % 3
    b = table(spark, sf, "orders").select("o_orderkey", F.when(k == 0, "USD").when(k == 1, "EUR").otherwise("JPY").alias("currency"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("level"))
    days = spark.range(0, 261).select(F.date_add(F.lit("1992-01-01").cast("date"), (F.col("id") * 9).cast("int")).alias("rate_day")).filter("rate_day < '1998-06-01'")
    rate = (0.5 + (F.datediff("rate_day", F.lit("1990-01-01")) % 97) / 100.0).alias("usd_per_unit")
    rates = days.select(F.explode(F.array(F.lit("EUR"), F.lit("JPY"))).alias("currency"), "rate_day", rate)
    return V.in_currency(b, rates, "currency", "d", "level", 5).select("o_orderkey", F.round("level_usd", 4).alias("level_usd"), "rate_day")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS close_raw, CASE WHEN l_linenumber % 3 = 0 THEN l_extendedprice / 2 WHEN l_linenumber % 5 = 0 THEN 0 ELSE l_extendedprice END AS close, l_quantity AS volume, l_extendedprice * 1.1 AS high FROM lineitem)
    SELECT l_orderkey, l_linenumber, close_raw AS close, round(high * (close_raw / close), 4) AS high, round(volume / (close_raw / close), 6) AS volume, abs(close_raw / close - 1) > 1e-12 AS imputed FROM r WHERE close > 0""")
def unadjusted_bars(spark, sf):
    n, p = F.col("l_linenumber"), F.col("l_extendedprice")
    r = table(spark, sf, "lineitem").select("l_orderkey", n, F.when(n % 3 == 0, p / 2).when(n % 5 == 0, 0.0).otherwise(p).alias("close"), p.alias("close_raw"), F.col("l_quantity").alias("volume"), (p * 1.1).alias("high"), p.alias("open"), p.alias("low"))
    return vendors.without_adjustment(r).select("l_orderkey", "l_linenumber", "close", F.round("high", 4).alias("high"), F.round("volume", 6).alias("volume"), "imputed")


@query("SELECT page_id, upper(CASE WHEN contains(url, '.') THEN string_split(url, '.')[-1] ELSE '' END) AS suffix FROM pages")
def symbol_suffixes(spark, sf):
    return table(spark, sf, "pages").select("page_id", vendors.exchange_suffix(F.col("url")).alias("suffix"))
