"""Identity over time: which security a membership span stood for on each day, from dated observations of several sources.

Observations are points: on a day, a source showed one identifier, several candidates, or nothing that
decides. Runs of points with one identifier become segments; what lies between and at the ends is only
as good as what bridges it: an official change of identifier, a new issue of the same issuer, the same
identifier outside the span. Nothing is inferred by name alone. A span's points are a shuffle by span
and one order; everything is windows over it, so that spans of any number of points are one sort.

Tables:
spans        span, start, stop (exclusive; null: open)
points       span, day, isin (null: not decided), sure (an anchor or official text says so), exact (an official document says it verbatim), candidates (array); points outside the span tell of what was before and after
transitions  old, new, day (the first of the new identifier), continuity (SAME or NEW security)
issues       isin, issuer, issued: null where not known
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

EXACT, CONFIRMED, PROVISIONAL, UNRESOLVED = "EXACT", "CONFIRMED", "PROVISIONAL", "UNRESOLVED"
#: Statuses that a segment needs for every day that uses it.
USABLE = (EXACT, CONFIRMED)


def _one_a_day(points: DataFrame) -> DataFrame:
    """One point per span and day: where sources name one identifier it is that; where they differ it is not decided, and all are candidates."""
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.coalesce("candidates", F.array().cast("array<string>")), F.when(F.col("isin").isNotNull(), F.array("isin")).otherwise(F.array().cast("array<string>")))))))
    per = points.groupBy("span", "day").agg(F.count_distinct("isin").alias("k"), F.max("isin").alias("isin"), F.max(F.coalesce("sure", F.lit(False)) & F.col("isin").isNotNull()).alias("sure"), F.max(F.coalesce("exact", F.lit(False)) & F.col("isin").isNotNull()).alias("exact"), every.alias("candidates"))
    one = F.col("k") == 1
    return per.select("span", "day", F.when(one, F.col("isin")).alias("isin"), (one & F.col("sure")).alias("sure"), (one & F.col("exact")).alias("exact"), "candidates")


def _runs(spans: DataFrame, points: DataFrame, horizon: Column) -> DataFrame:
    """(span, start, stop, t, run, isin, first, until, confirmed, candidates, before, after): stretches of points with one identifier inside each span.

    until is the day after the last point; before and after are the points next to the span outside; confirmed means that some point of that identifier is sure.
    """
    s = spans.withColumn("t", F.coalesce("stop", F.date_add(horizon, 1)))
    p = s.join(_one_a_day(points), "span", "left")
    w = Window.partitionBy("span")
    inside = (F.col("day") >= F.col("start")) & (F.col("day") < F.col("t"))
    fact = F.struct("isin", "candidates", "exact", "day")
    p = p.withColumns({"before": F.max_by(F.when(F.col("day") < F.col("start"), fact), F.when(F.col("day") < F.col("start"), F.col("day"))).over(w), "after": F.min_by(F.when(F.col("day") >= F.col("t"), fact), F.when(F.col("day") >= F.col("t"), F.col("day"))).over(w)})
    kept = p.filter(inside)
    order = w.orderBy("day")
    new = F.coalesce((~F.col("isin").eqNullSafe(F.lag("isin").over(order))).cast("int"), F.lit(1))
    new = F.when(F.lag("day").over(order).isNull(), 1).otherwise(new)
    kept = kept.withColumn("__new", new).withColumn("run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = kept.withColumn("anchored", F.max("sure").over(Window.partitionBy("span", "isin")))
    runs = kept.groupBy("span", "start", "stop", "t", "run", "isin").agg(
        F.min("day").alias("first"), F.date_add(F.max("day"), 1).alias("until"), F.max("anchored").alias("anchored"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("candidates")))).alias("candidates"), F.first("before").alias("before"), F.first("after").alias("after"),
    )
    runs = runs.withColumn("confirmed", F.col("isin").isNotNull() & F.col("anchored"))
    none = p.groupBy("span", "start", "stop", "t").agg(F.count_if(inside).alias("n"), F.first("before").alias("before"), F.first("after").alias("after")).filter("n = 0").drop("n")
    return runs.unionByName(none, allowMissingColumns=True)


def own_keys(runs: DataFrame, names: dict[str, str]) -> DataFrame:
    """runs with, for each of names, its column as a key to join on: a null joins nothing, but all nulls would be dealt to one task, so that each gets a key of its own."""
    own = F.concat(F.lit("\0"), F.col("span").cast("string"), F.lit("\0"), F.coalesce(F.col("run").cast("string"), F.lit("")))
    return runs.withColumns({k: F.coalesce(c, own) for k, c in names.items()})


def identity_segments(spans: DataFrame, points: DataFrame, transitions: DataFrame, issues: DataFrame, horizon: Column, bridge_days: int = 366) -> DataFrame:
    """(span, start, end, status, isin, candidates, continuity): each span cut into the coarsest segments of one identity; end is NULL where open.

    EXACT: an official document says so on a day of the segment; CONFIRMED: a sure identifier throughout; PROVISIONAL:
    candidates only; UNRESOLVED: nothing. A change of identifier starts at the day of its official transition, else at the
    issue of the new one by the same issuer, else the days between are PROVISIONAL. The first days hold if a transition
    precedes the span, or the point before it (at most ``bridge_days`` old if only an exact text) shows the same identifier
    that was not issued later; the last days if the point after shows it, or the point after shows nothing else.
    """
    runs = cut(_runs(spans, points, horizon))
    w = Window.partitionBy("span").orderBy("run")
    prev_sure = F.lag("confirmed").over(w)
    r = runs.withColumns({"p_isin": F.when(prev_sure, F.lag("isin").over(w)), "p_until": F.lag("until").over(w), "first_run": F.lag("run").over(w).isNull(), "last_run": F.lead("run").over(w).isNull()})
    r = r.withColumn("cursor", F.coalesce("p_until", "start"))
    tr = transitions.select(F.col("old").alias("p_isin"), F.col("new").alias("isin"), F.col("day").alias("tr_day"), "continuity").dropDuplicates(["p_isin", "isin"])
    came = transitions.groupBy(F.col("new").alias("isin")).agg(F.min("day").alias("came"))
    facts = issues.groupBy("isin").agg(F.min("issuer").alias("issuer"), F.min("issued").alias("issued"))
    r = own_keys(r, {"__i": "isin", "__p": "p_isin"})
    issuer = facts.select(F.col("isin").alias("__p"), F.col("issuer").alias("p_issuer"))
    r = r.join(tr.withColumnsRenamed({"p_isin": "__p", "isin": "__i"}), ["__p", "__i"], "left").join(came.withColumnRenamed("isin", "__i"), "__i", "left").join(facts.withColumnRenamed("isin", "__i"), "__i", "left").join(issuer, "__p", "left").drop("__i", "__p")
    official = F.col("confirmed") & (F.col("tr_day") >= F.col("p_until")) & (F.col("tr_day") <= F.date_add(horizon, 1))
    gap = F.col("confirmed") & (F.col("cursor") < F.col("first"))
    reissued = gap & ~F.col("first_run") & (F.col("issuer") == F.col("p_issuer")) & (F.col("issued") >= F.col("p_until")) & (F.col("issued") <= F.col("first"))
    r = r.withColumns({"official": F.coalesce(official, F.lit(False)), "reissued": F.coalesce(reissued, F.lit(False))})
    r = r.withColumn("begins", F.when(F.col("official"), F.col("tr_day")).when(F.col("reissued"), F.col("issued")).when(F.col("confirmed"), F.col("first")).otherwise(F.col("cursor")))
    # A change that is dated ends the run before it on that day.
    r = cut(r.withColumn("ends", F.when(F.lead(F.col("official") | F.col("reissued")).over(w), F.lead("begins").over(w)).otherwise(F.col("until"))))
    held = F.col("run").isNotNull()
    none = F.array().cast("array<string>")
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())

    def segment(rows: DataFrame, start: Column, end: Column, status: Column, isin: Column, candidates: Column, continuity: Column = F.lit(None).cast("string")) -> DataFrame:
        return rows.select("span", F.col("start").alias("__from"), "stop", "t", start.alias("start"), end.alias("end"), status.alias("status"), isin.cast("string").alias("isin"), candidates.alias("candidates"), continuity.alias("continuity"))

    unsure = F.when(F.size("candidates") > 0, PROVISIONAL).otherwise(UNRESOLVED)
    parts = [segment(r.filter(held & F.col("confirmed")), F.col("begins"), F.col("ends"), F.lit(CONFIRMED), F.col("isin"), none, F.when(F.col("official"), F.col("continuity")))]
    parts.append(segment(r.filter(held & ~F.col("confirmed")), F.col("cursor"), F.col("ends"), unsure, F.lit(None), F.col("candidates")))
    between = r.filter(held & gap & ~F.col("first_run") & ~F.col("official") & ~F.col("reissued"))
    parts.append(segment(between, F.col("cursor"), F.col("first"), F.lit(PROVISIONAL), F.lit(None), F.array_sort(F.array_distinct(some(F.col("p_isin"), F.col("isin"))))))
    same_before = F.coalesce(F.col("before.isin") == F.col("isin"), F.lit(False)) | F.coalesce(F.array_contains("before.candidates", F.col("isin")), F.lit(False))
    near = F.coalesce(F.col("before.exact") & (F.col("before.isin") == F.col("isin")) & (F.datediff("start", "before.day") <= bridge_days), F.lit(False))
    lead_ok = F.coalesce(F.col("came") <= F.col("start"), F.lit(False)) | near | (same_before & F.coalesce(F.col("issued") <= F.col("start"), F.lit(True)))
    lead = r.filter(held & gap & F.col("first_run"))
    parts.append(segment(lead, F.col("start"), F.col("first"), F.when(lead_ok, CONFIRMED).otherwise(PROVISIONAL), F.when(lead_ok, F.col("isin")), F.when(lead_ok, none).otherwise(F.array("isin"))))
    same_after = F.coalesce(F.col("after.isin") == F.col("isin"), F.lit(False)) | F.coalesce(F.array_contains("after.candidates", F.col("isin")), F.lit(False))
    silent = F.col("after.day").isNotNull() & F.col("after.isin").isNull() & (F.size("after.candidates") == 0)
    trail_ok = F.col("confirmed") & F.col("stop").isNotNull() & (same_after | F.coalesce(silent, F.lit(False)))
    trail = r.filter(held & F.col("last_run") & (F.col("until") < F.col("t")))
    parts.append(segment(trail, F.col("until"), F.col("t"), F.when(trail_ok, CONFIRMED).otherwise(PROVISIONAL), F.when(trail_ok, F.col("isin")), F.when(trail_ok, none).when(F.col("confirmed"), F.array("isin")).otherwise(none)))
    around = F.array_sort(F.array_distinct(F.concat(F.coalesce("before.candidates", none), F.coalesce("after.candidates", none))))
    alone = r.filter(~held)
    parts.append(segment(alone, F.col("start"), F.col("t"), F.when(F.size(around) > 0, PROVISIONAL).otherwise(UNRESOLVED), F.lit(None), around))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.filter("end > start")
    # Exact days, by span and identifier; then neighbours of one identity and status become one.
    days = _one_a_day(points).filter("exact").select("span", "isin", "day")
    exact = every.filter(F.col("isin").isNotNull()).join(days, ["span", "isin"]).filter("start <= day and day < end").select("span", "start").distinct().withColumn("__x", F.lit(True))
    every = every.join(exact, ["span", "start"], "left").withColumn("status", F.when(F.col("__x"), EXACT).otherwise(F.col("status")))
    o = Window.partitionBy("span").orderBy("start", "end")
    joins = F.col("isin").isNotNull() & (F.lag("isin").over(o) == F.col("isin")) & (F.lag("status").over(o) == F.col("status")) & (F.lag("end").over(o) == F.col("start"))
    every = every.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("__g", F.sum("__new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    out = every.groupBy("span", "__g", "stop", "t", "isin", "status").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("candidates").alias("candidates"), F.max("continuity").alias("continuity"))
    return out.select("span", "start", F.when(F.col("stop").isNull() & (F.col("end") >= F.col("t")), None).otherwise(F.col("end")).alias("end"), "status", "isin", "candidates", "continuity")


def coverage_metrics(segments: DataFrame, spans: DataFrame, since: Column) -> DataFrame:
    """(spans, exact, confirmed, provisional, unresolved, coverage): spans that reach past a day, by their segments after it; usable only if all of those are."""
    live = spans.filter(F.col("stop").isNull() | (F.col("stop") > since)).select("span")
    late = live.join(segments.filter(F.col("end").isNull() | (F.col("end") > since)), "span")
    per = late.groupBy("span").agg(F.min(F.col("status").isin(*USABLE)).alias("all"), F.max(F.col("status").isin(*USABLE)).alias("any"), F.max(F.col("status") == CONFIRMED).alias("multi"), F.max(F.col("status") == UNRESOLVED).alias("un"))
    kind = F.when(F.col("all") & F.col("multi"), "confirmed").when(F.col("all"), "exact").when(F.col("un") & ~F.col("any"), "unresolved").otherwise("provisional")
    k = per.withColumn("k", kind)
    n = {c: F.count_if(F.col("k") == c).alias(c) for c in ("exact", "confirmed", "provisional", "unresolved")}
    return k.agg(F.count("*").alias("spans"), *n.values()).withColumn("coverage", F.round(F.try_divide(100.0 * (F.col("exact") + F.col("confirmed")), F.col("spans")), 1))
