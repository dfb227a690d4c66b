"""Queries of gates, lookups and benchmark choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..sources.tables import table
from .registry import query


@query("""WITH m AS (SELECT s_suppkey AS model_id, DATE '1992-01-01' + CAST(s_suppkey * 37 % 2400 AS INT) AS known, s_suppkey % 3 AS horizon FROM supplier WHERE s_suppkey % 4 <> 0), d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS decided, o_orderkey % 3 AS horizon FROM orders)
    SELECT o_orderkey, arg_max(model_id, row(CAST(known + INTERVAL 2 MONTH AS DATE), model_id)) AS model_id FROM d LEFT JOIN m ON m.horizon = d.horizon AND CAST(known + INTERVAL 2 MONTH AS DATE) <= decided GROUP BY 1""")
def serving_models(spark, sf):
    """The model that may serve each decision: every training label known two months before."""
    s = F.col("s_suppkey")
    models = table(spark, sf, "supplier").select(s.alias("model_id"), F.date_add(F.lit("1992-01-01").cast("date"), (s * 37 % 2400).cast("int")).alias("label_known_by"), (s % 3).alias("horizon"), (s % 4 != 0).alias("frozen"))
    d = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("decided"), (F.col("o_orderkey") % 3).alias("horizon"))
    return G.serving_model(d, models).select("o_orderkey", "model_id")


_PREDICTIONS = """p AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) AS g, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'),
    a AS (SELECT o_orderkey, o_custkey AS k, CAST(o_orderdate AS DATE) AS t FROM orders WHERE o_orderstatus = 'O')"""


@query(f"""WITH {_PREDICTIONS} SELECT o_orderkey, max(row(d, g, id))[3] AS prediction_id FROM a LEFT JOIN p ON p.k = a.k AND d <= t AND g <= t GROUP BY 1""")
def predictions_known(spark, sf):
    """For each open order the customer's latest prediction that had been made by then."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), "o_orderstatus")
    p = o.filter("o_orderstatus = 'F'").select("k", F.col("d").alias("decided"), F.date_add("d", (F.col("o_orderkey") % 400).cast("int")).alias("generated_at"), F.col("o_orderkey").alias("prediction_id"))
    return G.prediction_at(o.filter("o_orderstatus = 'O'").select("o_orderkey", "k", F.col("d").alias("t")), p, ["k"], "t").select("o_orderkey", "prediction_id")


_STATUS = "CASE {x} % 4 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'INSUFFICIENT' END"


@query(f"""WITH c AS (SELECT c_custkey AS k, {_STATUS.format(x='c_custkey')} AS prices, {_STATUS.format(x='(c_custkey // 4)')} AS facts, CASE WHEN c_custkey % 3 <> 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS identity, CASE WHEN c_custkey % 5 = 0 THEN 'COMPLETE' END AS benchmark, CASE WHEN c_custkey % 2 = 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS sector FROM customer),
    r AS (SELECT k, concat_ws('; ', CASE WHEN coalesce(prices, 'missing') NOT IN ('COMPLETE', 'PARTIAL') THEN 'prices: ' || coalesce(prices, 'missing') END, CASE WHEN coalesce(facts, 'missing') NOT IN ('COMPLETE', 'PARTIAL') THEN 'facts: ' || coalesce(facts, 'missing') END,
        CASE WHEN identity <> 'COMPLETE' THEN 'identity is not proven for the whole period' END, CASE WHEN coalesce(benchmark, '') <> 'COMPLETE' AND sector <> 'COMPLETE' THEN 'no benchmark or sector context' END) AS reasons FROM c)
    SELECT k, CASE WHEN reasons = '' THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS status, reasons FROM r""")
def support_decisions(spark, sf):
    k = F.col("c_custkey")
    status = lambda x: F.when(x % 4 == 0, "COMPLETE").when(x % 4 == 1, "PARTIAL").when(x % 4 == 2, "INSUFFICIENT")
    found = {"prices": status(k), "facts": status(F.floor(k / 4)), "identity": F.when(k % 3 != 0, "COMPLETE").otherwise("PARTIAL"), "benchmark": F.when(k % 5 == 0, "COMPLETE"), "sector": F.when(k % 2 == 0, "COMPLETE").otherwise("PARTIAL")}
    rows = table(spark, sf, "customer").select(k.alias("k"), F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), s.alias("status")) for n, s in found.items()])).alias("d")).select("k", "d.*").filter("status is not null")
    return G.support_decision(rows, "k", ["prices", "facts"], ["benchmark", "sector"])


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS announced_at, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 300 AS INT) AS effective_date FROM orders
    WHERE CAST(o_orderdate AS DATE) <= DATE '1996-06-01' AND CAST(o_orderdate AS DATE) + CAST(o_orderkey % 300 AS INT) > DATE '1996-06-01'""")
def announced_changes(spark, sf):
    d = F.to_date("o_orderdate")
    e = table(spark, sf, "orders").select("o_orderkey", d.alias("announced_at"), F.date_add(d, (F.col("o_orderkey") % 300).cast("int")).alias("effective_date"))
    return G.announced_changes(e, F.lit("1996-06-01").cast("date"))


@query("""WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, o_custkey FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, o_custkey FROM orders WHERE o_orderkey % 5 <> 0), c AS (SELECT d FROM a INTERSECT SELECT d FROM b),
    j AS (SELECT coalesce(a.d, b.d) AS d, a.d IS NULL AS na, b.d IS NULL AS nb FROM (SELECT * FROM a SEMI JOIN c USING (d)) a FULL JOIN (SELECT * FROM b SEMI JOIN c USING (d)) b ON a.d = b.d AND a.o_custkey = b.o_custkey)
    SELECT d, count(*) FILTER (nb) AS only_a, count(*) FILTER (na) AS only_b FROM j GROUP BY 1 HAVING count(*) FILTER (na OR nb) > 0""")
def set_discrepancies(spark, sf):
    """Where two sources of daily members differ: one lacks a third of the orders, the other a fifth."""
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), "o_custkey", "o_orderkey")
    a, b = (o.filter(F.col("o_orderkey") % n != 0).select("d", "o_custkey").distinct() for n in (3, 5))
    return G.set_discrepancies(a, b, "d", "o_custkey")


@query("""SELECT o_custkey, count(*) AS snapshots, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 50000) AS usable, CAST(min(o_orderdate) FILTER (o_orderstatus = 'F' AND o_totalprice > 50000) AS DATE) AS first, CAST(max(o_orderdate) FILTER (o_orderstatus = 'F' AND o_totalprice > 50000) AS DATE) AS last,
    count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 50000) >= 3 AS enough FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1997-01-01' GROUP BY 1""")
def usable_months(spark, sf):
    s = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), F.when(F.col("o_orderstatus") == "F", "OK").alias("status"), F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice")).alias("x"))
    return G.usable_months(s, "o_custkey", "d", "status", ["x"], F.lit("1997-01-01").cast("date"), 3)


@query("""WITH c AS (SELECT ps.s_suppkey AS bench, c_custkey, ps.s_suppkey % 10 AS preference, CASE WHEN c_custkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS cur, CASE WHEN c_custkey % 7 = 0 THEN 'PRICE_RETURN' ELSE 'TOTAL_RETURN' END AS rt,
        CASE WHEN ps.s_suppkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS bc, CASE ps.s_suppkey % 4 WHEN 0 THEN 'PRICE_RETURN' WHEN 1 THEN 'UNKNOWN' ELSE 'TOTAL_RETURN' END AS brt, CASE WHEN ps.s_suppkey % 5 = 0 THEN 'ETF_PROXY' ELSE 'INDEX' END AS kind FROM customer JOIN supplier ps ON s_nationkey = c_nationkey),
    q AS (SELECT *, CASE WHEN brt = 'PRICE_RETURN' OR rt <> 'TOTAL_RETURN' THEN 'PRICE_RETURN_ONLY' WHEN brt = 'UNKNOWN' THEN 'UNVERIFIED' WHEN cur <> bc THEN 'FX_MISMATCH' WHEN kind = 'ETF_PROXY' THEN 'PROXY_ACCEPTABLE' ELSE 'READY' END AS quality FROM c),
    n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY preference, bench) AS n FROM q), b AS (SELECT *, coalesce(min(n) FILTER (quality IN ('READY', 'PROXY_ACCEPTABLE')) OVER (PARTITION BY c_custkey), 1) AS best FROM n)
    SELECT c_custkey, bench, quality, CASE WHEN quality IN ('PRICE_RETURN_ONLY', 'UNVERIFIED') THEN 'NOT_COMPARABLE_RETURN_BASIS' WHEN quality = 'FX_MISMATCH' THEN 'FX_NOT_READY' ELSE 'COMPARABLE' END AS comparability, CASE WHEN quality IN ('READY', 'PROXY_ACCEPTABLE') THEN n - 1 ELSE 0 END AS skipped FROM b WHERE n = best""")
def benchmark_choice(spark, sf):
    """Each customer's benchmark among the suppliers of its nation: the first approved in order of preference."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.when(k % 2 == 0, "USD").otherwise("EUR").alias("currency"), F.when(k % 7 == 0, "PRICE_RETURN").otherwise("TOTAL_RETURN").alias("return_type"))
    b = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("nation"), s.alias("bench"), F.struct((s % 10).alias("p"), s.alias("s")).alias("preference"),
        F.when(s % 3 == 0, "EUR").otherwise("USD").alias("bench_currency"), F.when(s % 4 == 0, "PRICE_RETURN").when(s % 4 == 1, "UNKNOWN").otherwise("TOTAL_RETURN").alias("bench_return_type"), F.when(s % 5 == 0, "ETF_PROXY").otherwise("INDEX").alias("bench_kind"),
    )
    return G.choose_benchmarks(c, b, ["nation"], "preference").select("c_custkey", "bench", "quality", "comparability", "skipped")
