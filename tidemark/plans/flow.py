"""Queries of versioned streams, sinks and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import announcements, append, parsers
from ..sources.tables import table
from ..streaming import known
from .registry import query

#: Versions of daily observations: an event's day, the event as version, available some minutes after.
VERSIONS = """v AS (SELECT user_id, date_trunc('day', ts) AS at_day, ts + (event_id % 40) * INTERVAL 1 MINUTE AS available, event_id AS version, value FROM events)"""


def versions(spark, sf):
    e = table(spark, sf, "events")
    return e.select("user_id", F.date_trunc("day", "ts").alias("at_day"), (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 40).cast("int"))).alias("available"), F.col("event_id").alias("version"), "value")


@query(f"""WITH {VERSIONS} SELECT user_id, CAST(at_day AS DATE) AS day, version, value FROM v WHERE at_day <= TIMESTAMP '2024-01-15' AND available <= TIMESTAMP '2024-01-15 06:15:00' - INTERVAL 6 HOUR
    QUALIFY row_number() OVER (PARTITION BY user_id, at_day ORDER BY version DESC) = 1""")
def known_data(spark, sf):
    df = known.known_data(versions(spark, sf), ["user_id"], "at_day", "available", "version", F.lit("2024-01-15").cast("timestamp"))
    return df.select("user_id", F.to_date("at_day").alias("day"), "version", "value")


@query("""WITH f AS (SELECT user_id, CAST(ts AS DATE) + 3 AS target, max(value) AS forecast FROM events WHERE event_type = 'view' GROUP BY 1, 2), b AS (SELECT user_id, CAST(ts AS DATE) AS target, arg_max(value, ts) AS outcome FROM events GROUP BY 1, 2)
    SELECT user_id, target, forecast, CASE WHEN target <= DATE '2024-01-28' THEN outcome END AS outcome, CASE WHEN target > DATE '2024-01-28' THEN 'PENDING' WHEN outcome IS NOT NULL THEN 'REVEALED' ELSE 'AWAITING_BAR' END AS state FROM f LEFT JOIN b USING (user_id, target)""")
def forecast_reveal(spark, sf):
    from .series import bars

    e = table(spark, sf, "events").filter("event_type = 'view'")
    f = e.groupBy("user_id", F.date_add(F.to_date("ts"), 3).alias("target")).agg(F.max("value").alias("forecast"))
    return known.reveal(f, bars(spark, sf), ["user_id"], "target", "session_date", "close", F.lit("2024-01-28").cast("date"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1)")
def append_missing_rows(spark, sf):
    stored = table(spark, sf, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return append.missing(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), stored, ["o_orderkey"])


@query("SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title FROM pages")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", parsers.html_title(F.col("html")).alias("title"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def content_addressed(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("SELECT sha256(html) AS sha256, min(url) AS path, any_value(octet_length(encode(html))) AS bytes FROM pages WHERE html IS NOT NULL GROUP BY 1")
def archived_pages(spark, sf):
    """Pages as archived files: one for each content, under its digest."""
    content = F.col("html").cast("binary")
    files = table(spark, sf, "pages").filter("html is not null").select(F.col("url").alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    return append.archive(files).select("sha256", "path", "bytes")


@query("""SELECT o_orderkey, 'B' || o_custkey AS added, 'Buyer ' || o_custkey || ' Inc.' AS added_name, CASE WHEN o_orderkey % 7 <> 3 THEN 'S' || o_orderkey END AS removed, 'Seller ' || o_orderkey || CASE WHEN o_orderkey % 7 <> 3 THEN ' Corp.' ELSE '' END AS removed_name,
        CASE o_orderkey % 5 WHEN 0 THEN 'AFTER_CLOSE' WHEN 1 THEN 'BEFORE_OPEN' WHEN 2 THEN 'TBA' WHEN 3 THEN 'EFFECTIVE_ON_DATE' ELSE 'AFTER_CLOSE' END AS timing, CASE WHEN o_orderkey % 5 <> 2 THEN CAST(o_orderdate AS DATE) + 6 END AS stated_day,
        CASE WHEN o_orderkey % 3 = 0 THEN 'BANKRUPTCY' WHEN o_orderkey % 3 = 1 THEN 'MERGER_OR_ACQUISITION' ELSE 'UNSPECIFIED' END AS reason, o_orderkey % 11 = 0 AND o_orderkey % 5 <> 2 AS header_differs, CASE WHEN o_orderkey % 7 = 3 THEN 'REMOVED_WITHOUT_SYMBOL' END AS problem FROM orders""")
def announcement_clauses(spark, sf):
    """Announcements written out of orders, in five forms, and read again."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    day = lambda days, form: F.date_format(F.date_add(d, days), form)
    buyer = F.concat(F.lit("Buyer "), F.col("o_custkey"), F.lit(" Inc. (NYSE: B"), F.col("o_custkey"), F.lit(")"))
    seller = F.when(k % 7 == 3, F.concat(F.lit("Seller "), k)).otherwise(F.concat(F.lit("Seller "), k, F.lit(" Corp. (NASD: S"), k, F.lit(" )")))
    clause = F.concat(buyer, F.lit(" will replace "), seller, F.lit(" in the S&P 500"))
    form = k % 5
    body = (
        F.when(form == 0, F.concat(clause, F.lit(" index after the close of trading on "), day(6, "EEEE, MMMM d, yyyy"), F.lit(". ")))
        .when(form == 1, F.concat(clause, F.lit(" prior to the open of trading on "), day(6, "EEEE, MMM. d"), F.lit(". ")))
        .when(form == 2, F.concat(clause, F.lit(" index after the close of trading on a date to be announced. ")))
        .when(form == 3, F.concat(clause, F.lit(", and Other Co. (NYSE: O) will replace Another (NYSE: P) in the S&P MidCap 400 effective "), day(6, "MMMM d, yyyy"), F.lit(". ")))
        .otherwise(F.concat(F.lit("The following changes are made after the close of trading on "), day(6, "EEEE, MMMM d, yyyy"), F.lit(" : "), clause, F.lit(" index. ")))
    )
    why = F.when(k % 3 == 0, "It filed for Chapter 11 after a failed merger. ").when(k % 3 == 1, "It is being acquired. ").otherwise("")
    header = F.when(k % 11 == 0, F.concat(F.lit("S&P 500 INDEX - "), day(7, "MMMM d, yyyy"))).otherwise("")
    texts = table(spark, sf, "orders").select(k, d.alias("announced"), F.concat(F.lit("NEW YORK /Wire/ -- "), body, why, header).alias("body"))
    found = announcements.changes(texts, ["o_orderkey"], "body", "announced")
    return found.select(k, "added", "added_name", "removed", "removed_name", "timing", "stated_day", "reason", "header_differs", "problem")
