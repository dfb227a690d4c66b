"""Documents to rows, by Spark's own readers and functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import wall_clock_to_utc

_RECENT = "struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,reportDate:array<string>,acceptanceDateTime:array<string>>"


def filings(docs: DataFrame, content: str) -> DataFrame:
    """A company's list of filings, a JSON of parallel arrays, as a row each."""
    parsed = docs.withColumn("__j", F.from_json(F.col(content).cast("string"), f"cik string, filings struct<recent:{_RECENT}>"))
    names = ["accessionNumber", "form", "filingDate", "reportDate", "acceptanceDateTime"]
    zipped = F.arrays_zip(*[F.col(f"__j.filings.recent.{n}").alias(n) for n in names])
    rows = parsed.select(F.col("__j.cik").alias("cik"), F.explode(zipped).alias("f"))
    return rows.select("cik", F.col("f.accessionNumber").alias("accession"), "f.form", F.to_date("f.filingDate").alias("filed"), F.try_to_date("f.reportDate").alias("period"), F.try_to_timestamp("f.acceptanceDateTime").alias("accepted_at"))


def company_facts(docs: DataFrame, content: str) -> DataFrame:
    """Nested taxonomy, concept and unit maps of facts as a row for each fact."""
    fact = "array<struct<start:string,`end`:string,val:double,accn:string,form:string,filed:string>>"
    kind = f"cik string, facts map<string,map<string,struct<units:map<string,{fact}>>>>"
    j = docs.select(F.from_json(F.col(content).cast("string"), kind).alias("j"))
    a = j.select("j.cik", F.explode("j.facts").alias("taxonomy", "c"))
    b = a.select("cik", "taxonomy", F.explode("c").alias("concept", "u"))
    c = b.select("cik", "taxonomy", "concept", F.explode("u.units").alias("unit", "fs"))
    d = c.select("cik", "taxonomy", "concept", "unit", F.explode("fs").alias("f"))
    return d.select("cik", "taxonomy", "concept", "unit", F.to_date("f.start").alias("period_start"), F.to_date("f.end").alias("period_end"), F.col("f.val").alias("value"), F.col("f.accn").alias("accession"), "f.form", F.to_date("f.filed").alias("filed"))


def acceptance_time(header: Column) -> Column:
    """The acceptance instant in a filing's header, which is Eastern wall time."""
    raw = F.regexp_extract(header, r"<ACCEPTANCE-DATETIME>(\d{14})", 1)
    local = F.try_to_timestamp(F.nullif(raw, F.lit("")), F.lit("yyyyMMddHHmmss"))
    return wall_clock_to_utc(local, "America/New_York")


def instance_facts(docs: DataFrame, content: str) -> DataFrame:
    """Numeric facts without dimensions of an XBRL instance: (concept, context, unit, value, period_start, period_end)."""
    text = F.col(content).cast("string")
    contexts = F.regexp_extract_all(text, F.lit(r"(?s)<(?:\w+:)?context id=\"[^\"]+\".*?</(?:\w+:)?context>"), F.lit(0))
    facts = F.regexp_extract_all(text, F.lit(r"<[\w-]+:[\w-]+ [^<>]*contextRef=\"[^\"]+\"[^<>]*>\s*-?[0-9.]+\s*</"), F.lit(0))
    both = docs.select(F.monotonically_increasing_id().alias("__d"), contexts.alias("cs"), facts.alias("fs"))
    grab = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    c = both.select("__d", F.explode("cs").alias("c")).filter(~F.col("c").contains("explicitMember")).select(
        "__d", grab("c", r'id="([^"]+)"').alias("context"), F.to_date(grab("c", r"startDate>([\d-]+)<")).alias("period_start"), F.to_date(F.coalesce(grab("c", r"endDate>([\d-]+)<"), grab("c", r"instant>([\d-]+)<"))).alias("period_end")
    )
    f = both.select("__d", F.explode("fs").alias("f")).select("__d", grab("f", r"<([\w-]+:[\w-]+) ").alias("concept"), grab("f", r'contextRef="([^"]+)"').alias("context"), grab("f", r'unitRef="([^"]+)"').alias("unit"), grab("f", r">\s*(-?[0-9.]+)\s*</").cast("double").alias("value"))
    return f.join(c, ["__d", "context"]).select("concept", "context", "unit", "value", "period_start", "period_end")


def fixed_width(lines: DataFrame, line: str, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """Columns cut from a line: name -> (1-based start, length), trimmed, empty as NULL."""
    return lines.select(*[F.nullif(F.trim(F.substring(line, a, n)), F.lit("")).alias(c) for c, (a, n) in fields.items()])


def holdings_list(lines: DataFrame, line: str) -> DataFrame:
    """(cusip, name, status) of the lines of an official list that begin with a valid identifier."""
    from ..functions.scalars import cusip_valid

    code = F.regexp_replace(F.substring(line, 1, 11), " ", "")
    rest = F.substring(line, 12, 200)
    status = F.nullif(F.regexp_extract(rest, r"(ADDED|DELETED)\s*$", 1), F.lit(""))
    return lines.select(code.alias("cusip"), F.trim(F.regexp_replace(rest, r"(ADDED|DELETED)\s*$", "")).alias("name"), status.alias("status")).filter(cusip_valid(F.col("cusip")))


def html_pairs(html: Column) -> Column:
    """array<struct<label, value>> of the two-cell rows of a page's tables."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>\s*<t[dh][^>]*>(.*?)</t[dh]>\s*<td[^>]*>(.*?)</td>\s*</tr>"), F.lit(0))
    cell = lambda r, i: F.trim(F.regexp_replace(F.regexp_extract(r, r"(?is)<t[dh][^>]*>(.*?)</t[dh]>\s*<td[^>]*>(.*?)</td>", i), r"<[^>]+>", ""))
    return F.transform(rows, lambda r: F.struct(cell(r, 1).alias("label"), cell(r, 2).alias("value")))


def html_title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def delimited(spark, path: str, schema: str, separator: str = ",") -> DataFrame:
    """A delimited file with a header; a missing or malformed column fails the read."""
    return spark.read.csv(path, schema=schema, header=True, sep=separator, mode="FAILFAST", enforceSchema=False)
