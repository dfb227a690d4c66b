"""Membership between two dated compositions, reconciled from dated and undated statements of change.

Two consecutive compositions (anchors) of a pool bound a segment. What happened in it is told by legs:
statements that a security was added or removed, with the days [lo, hi] on which that may have taken
effect. Each security's legs are put in order, repeated ones become one, and are played from the state of
the first anchor; where that leads to the state of the second by exact days only, the security is pinned,
else it is uncertain in a window of days. Only what covers a day can make the membership of that day
unknown, so that a gap of one segment has no part in another.

All of it is per security and segment: one shuffle by these, a fold over a security's few legs, windows
and grouped counts. Anchors of a pool are some dozens.

Tables (all with ``pool``):
anchors  as_of, opens (the first session after as_of), early (it holds what is added at ``opens`` already), unresolved (lines without a security)
members  as_of, security, issuer, name, shares, weak (its identity rests on a name only); issuer, name, shares and weak may be null
legs     leg, event, kind (ADD or REMOVE), ticker, security (null if not resolved), status, lo, hi, exact, said (day of a statement without an effective day), other_day (a second source's day), backed (a claim that a primary text mentions)

Statuses are CONFIRMED, CONFLICT (two sources' days differ; lo is the primary one), UNDATED (stated, without a day) or CLAIM
(of a source that is not trusted for days). A leg without lo belongs to the segment of ``said``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, few

SEG = ["pool", "a", "b"]
_EVENT = "struct<lo:date,hi:date,kind:string,exact:boolean,status:string>"


@dataclass(frozen=True)
class Reconciled:
    """segments: one row each; securities: one for each that a segment's anchors or legs name; legs: those of segments, with what became of claims; aliases: changes of identity."""

    segments: DataFrame
    securities: DataFrame
    legs: DataFrame
    aliases: DataFrame


def segments_of(anchors: DataFrame) -> DataFrame:
    """(pool, a, b, opens, unresolved): each pair of consecutive anchors; unresolved lines of both."""
    w = Window.partitionBy("pool").orderBy("as_of")
    both = anchors.withColumns({"b": F.lead("as_of").over(w), "__u": F.lead("unresolved").over(w)}).filter("b is not null")
    return both.select("pool", F.col("as_of").alias("a"), "b", "opens", (F.coalesce("unresolved", F.lit(0)) + F.coalesce("__u", F.lit(0))).alias("unresolved"))


def without_early(anchors: DataFrame, members: DataFrame, legs: DataFrame) -> DataFrame:
    """members less those that an early anchor holds ahead of a confirmed addition at its next session."""
    if anchors.filter("early").isEmpty():
        return members
    ahead = legs.filter("kind = 'ADD' and exact and security is not null").select("pool", "security", F.col("lo").alias("opens")).distinct()
    held = anchors.filter("early").select("pool", "as_of", "opens").join(ahead, ["pool", "opens"]).select("pool", "as_of", "security")
    return members.join(held, ["pool", "as_of", "security"], "left_anti")


def in_segments(legs: DataFrame, segments: DataFrame) -> DataFrame:
    """legs with their segment's a, b and opens: lo from opens to b, or said after a up to b. Legs outside all segments go."""
    day = F.coalesce("lo", "said")
    at = legs.withColumn("__d", day).filter("__d is not null")
    # The segment of a day is that of the first end on or after it; those of a pool, some dozens, are a row that meets its legs.
    ends = few(cut(segments.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct("b", "a", "opens"))).alias("__ends"))))
    found = at.join(ends, "pool").withColumn("__at", F.expr("get(filter(__ends, e -> e.b >= __d), 0)")).filter("__at is not null")
    inside = F.when(F.col("lo").isNotNull(), F.col("lo") >= F.col("__at.opens")).otherwise(F.col("said") > F.col("__at.a"))
    return found.filter(inside).select("pool", "__at.a", "__at.b", "__at.opens", *[c for c in legs.columns if c != "pool"])


def lineage(states: DataFrame) -> DataFrame:
    """(pool, a, b, old, new, issuer): an issuer that loses one security and gains one in a segment has changed its security, not left and come back."""
    gone, come = F.col("in_a") & ~F.col("in_b"), F.col("in_b") & ~F.col("in_a")
    per = states.filter("issuer is not null").groupBy(*SEG, "issuer").agg(
        F.count_if(gone).alias("g"), F.count_if(come).alias("c"), F.max(F.when(gone, F.col("security"))).alias("old"), F.max(F.when(come, F.col("security"))).alias("new")
    )
    return per.filter("g = 1 and c = 1").select(*SEG, "old", "new", "issuer")


def _states(segments: DataFrame, members: DataFrame) -> DataFrame:
    """(pool, a, b, security, in_a, in_b, issuer, name, shares_a, shares_b, weak) for each security of either anchor."""
    facts = ["security", "issuer", "name", "shares", "weak"]
    near = few(segments)
    one = lambda end, flag: near.select(*SEG).join(members.select("pool", F.col("as_of").alias(end), *facts), ["pool", end]).select(*SEG, *facts, F.lit(flag).alias("at_a"))
    both = one("a", True).unionByName(one("b", False))
    first = lambda c: F.coalesce(F.max(F.when(F.col("at_a"), F.col(c))), F.max(c))
    return both.groupBy(*SEG, "security").agg(
        F.max("at_a").alias("in_a"), F.max(~F.col("at_a")).alias("in_b"), first("issuer").alias("issuer"), first("name").alias("name"),
        F.max(F.when(F.col("at_a"), F.col("shares"))).alias("shares_a"), F.max(F.when(~F.col("at_a"), F.col("shares"))).alias("shares_b"), F.coalesce(F.max("weak"), F.lit(False)).alias("weak"),
    )


def _renamed(states: DataFrame, lines: DataFrame) -> DataFrame:
    """states in which the first anchor's old security of a lineage is the new one."""
    if lines.isEmpty():
        return states.withColumn("changed", F.lit(False))
    moved = states.join(lines.select(*SEG, F.col("old").alias("security"), "new"), [*SEG, "security"], "left")
    return moved.withColumn("security", F.coalesce("new", "security")).groupBy(*SEG, "security").agg(
        *[F.max(c).alias(c) for c in ("in_a", "in_b")], F.max(F.when(F.col("new").isNull(), F.col("issuer"))).alias("issuer"), F.max(F.when(F.col("new").isNull(), F.col("name"))).alias("name"),
        F.max("shares_a").alias("shares_a"), F.max("shares_b").alias("shares_b"), F.max("weak").alias("weak"), F.max(F.col("new").isNotNull()).alias("changed"),
    )


#: Consecutive legs of one kind are one event: an exact one gives the day, of two that are not the widest span.
_COLLAPSE = f"""aggregate(legs, cast(array() as array<{_EVENT}>), (acc, e) -> if(size(acc) > 0 and element_at(acc, -1).kind = e.kind,
    if(e.exact and not element_at(acc, -1).exact, concat(slice(acc, 1, size(acc) - 1), array(struct(e.lo, e.hi, e.kind, e.exact, e.status))),
    if(element_at(acc, -1).exact, acc, concat(slice(acc, 1, size(acc) - 1), array(struct(least(element_at(acc, -1).lo, e.lo) as lo, greatest(element_at(acc, -1).hi, e.hi) as hi, e.kind as kind, false as exact, element_at(acc, -1).status as status))))),
    concat(acc, array(struct(e.lo, e.hi, e.kind, e.exact, e.status)))))"""
#: The events played from the first anchor; an addition of a member or a removal of none ends it as inconsistent.
_PLAY = """aggregate(events, struct(in_a as state, opens as known, true as ok, cast(null as date) as lo, cast(null as date) as hi), (s, e) -> if(not s.ok, s, if(s.state = (e.kind = 'ADD'), struct(s.state, s.known, false as ok, s.lo, s.hi),
    if(e.exact and e.lo is not null, struct(e.kind = 'ADD' as state, greatest(s.known, e.lo) as known, true as ok, s.lo, s.hi),
    struct(e.kind = 'ADD' as state, s.known, true as ok, least(s.lo, coalesce(e.lo, opens)) as lo, greatest(s.hi, coalesce(e.hi, b)) as hi)))))"""


def _played(states: DataFrame, legs: DataFrame, segments: DataFrame) -> DataFrame:
    """A row for each security that changed or has legs: events, window, how it differs, and whether replays both ways agree."""
    order = F.struct(F.coalesce("lo", "opens").alias("at"), "kind", F.col("leg").alias("leg"), "lo", "hi", "exact", "status")
    stated = legs.filter("status <> 'CLAIM' and security is not null").groupBy(*SEG, "security").agg(F.sort_array(F.collect_list(order)).alias("legs"))
    both = states.join(stated, [*SEG, "security"], "full_outer").join(few(segments).select(*SEG, "opens"), SEG)
    empty = F.expr("cast(array() as array<struct<at:date,kind:string,leg:string,lo:date,hi:date,exact:boolean,status:string>>)")
    both = both.withColumns({"in_a": F.coalesce("in_a", F.lit(False)), "in_b": F.coalesce("in_b", F.lit(False)), "weak": F.coalesce("weak", F.lit(False)), "legs": F.coalesce("legs", empty)})
    both = both.withColumn("events", F.expr(_COLLAPSE)).withColumn("p", F.expr(_PLAY))
    sound = F.col("p.ok") & (F.col("p.state") == F.col("in_b"))
    fixed = sound & F.col("p.lo").isNull()
    gap = F.when(F.exists("events", lambda e: e["status"] == "UNDATED"), "DATE_MISSING").when(~F.col("p.ok"), "UNEXPLAINED")
    change = F.when(F.col("in_b") & ~F.col("in_a"), "MISSING_ADDITION").when(F.col("in_a") & ~F.col("in_b"), "MISSING_REMOVAL")
    missing = F.when(change.isNotNull() & F.col("weak"), "IDENTITY_GAP").otherwise(F.coalesce(change, F.lit("UNEXPLAINED")))
    # Exact legs replayed one by one, forward from a and backward from b; the state before each is what its neighbour left.
    exact = F.filter("legs", lambda x: x["exact"] & x["lo"].isNotNull())
    both = both.withColumn("__x", exact).withColumn("__n", F.size("__x"))
    ahead = F.expr("aggregate(sequence(0, __n), false, (bad, i) -> bad or (i < __n and (__x[if(i < __n, i, 0)].kind = 'ADD') = if(i = 0, in_a, __x[if(i between 1 and __n - 1, i - 1, 0)].kind = 'ADD')))")
    back = F.expr("aggregate(sequence(0, __n), false, (bad, i) -> bad or (i < __n and (__x[if(i < __n, i, 0)].kind = 'ADD') <> if(i = __n - 1, in_b, __x[if(i < __n - 1, i + 1, 0)].kind = 'REMOVE')))")
    ends = F.when(F.col("__n") > 0, F.expr("element_at(__x, -1).kind = 'ADD'")).otherwise(F.col("in_a"))
    starts = F.when(F.col("__n") > 0, F.expr("__x[0].kind = 'REMOVE'")).otherwise(F.col("in_b"))
    some = F.col("__n") > 0
    both = both.withColumns({
        "forward_ok": ~F.when(some, ahead).otherwise(F.lit(False)) & (ends == F.col("in_b")), "backward_ok": ~F.when(some, back).otherwise(F.lit(False)) & (starts == F.col("in_a")),
        "pinned": F.when(fixed, F.expr("transform(filter(events, e -> e.exact and e.lo is not null), e -> struct(e.lo as day, e.kind as kind))")),
        "lo": F.when(~fixed, F.when(~F.col("p.ok"), F.col("opens")).otherwise(F.coalesce("p.lo", "p.known"))), "hi": F.when(~fixed, F.when(~F.col("p.ok"), F.col("b")).otherwise(F.coalesce("p.hi", "b"))),
        "difference": F.when(~fixed, F.coalesce(gap, missing)), "story": F.array_join(F.transform("events", lambda e: F.concat(e["kind"], F.lit(":"), e["status"])), ","),
    })
    return both.select(*SEG, "security", "name", "issuer", "in_a", "in_b", "shares_a", "shares_b", "pinned", "lo", "hi", "difference", "story", "forward_ok", "backward_ok")


def _linked(securities: DataFrame) -> DataFrame:
    """securities in which a removal and an addition that nothing explains, alike in name (half of the words) and in size (within twice), are a gap of identity.

    Names of m and n words of which half of all are shared have (m + n) / 3 in common. So, its words in order from the rarest in the
    segment, each has one of them among all but its last ones, and only those meet: words that very many names have make no pairs.
    """
    token = F.explode(F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace("name", "[^A-Za-z0-9]+", " ")), " "), lambda t: t != "")))
    open_ = securities.filter("difference in ('MISSING_ADDITION', 'MISSING_REMOVAL')").select(*SEG, "security", "name", "difference", "shares_a", "shares_b")
    each = open_.withColumn("token", token).select(*SEG, "security", "difference", "token", F.when(F.col("difference") == "MISSING_REMOVAL", F.col("shares_a")).otherwise(F.col("shares_b")).alias("s"))
    # Without shares on its side a name is never alike in size.
    each = cut(each.filter("s is not null"))
    often = each.groupBy(*SEG, "token").agg(F.count("*").alias("often"))
    words = each.join(often, [*SEG, "token"]).groupBy(*SEG, "security", "difference", "s").agg(F.sort_array(F.collect_list(F.struct("often", "token")))["token"].alias("w"))
    words = cut(words.withColumn("n", F.size("w")))
    sizes = words.withColumn("m", F.explode(F.sequence(F.ceil(F.col("n") / 2).cast("int"), F.col("n") * 2)))
    meets = sizes.withColumn("token", F.explode(F.slice("w", F.lit(1), F.col("n") - F.ceil((F.col("n") + F.col("m")) / 3).cast("int") + 1)))
    side = lambda d, s, n, m: meets.filter(F.col("difference") == d).select(*SEG, "token", F.col("n").alias(n), F.col("m").alias(m), F.col("security").alias(s), F.col("w").alias(f"{s}_w"), F.col("s").alias(f"{s}_s"))
    met = side("MISSING_REMOVAL", "gone", "gone_n", "come_n").join(side("MISSING_ADDITION", "come", "come_n", "gone_n"), [*SEG, "token", "gone_n", "come_n"]).withColumn("shared", F.size(F.array_intersect("gone_w", "come_w")))
    alike = met.filter((F.col("shared") >= 0.5 * (F.col("gone_n") + F.col("come_n") - F.col("shared"))) & (F.col("gone_s") > 0) & F.try_divide("come_s", "gone_s").between(0.5, 2.0))
    both = alike.select(*SEG, F.explode(F.array(F.struct(F.col("gone").alias("security"), F.col("come").alias("linked")), F.struct(F.col("come").alias("security"), F.col("gone").alias("linked")))).alias("l")).select(*SEG, "l.*")
    both = few(cut(both.groupBy(*SEG, "security").agg(F.min("linked").alias("linked_with"))))
    return securities.join(both, [*SEG, "security"], "left").withColumn("difference", F.when(F.col("linked_with").isNotNull(), "IDENTITY_GAP").otherwise(F.col("difference")))


def _open_legs(legs: DataFrame) -> DataFrame:
    """Windows of stated legs without a security, and of tickers that such legs add and remove within the segment."""
    stated = legs.filter("status <> 'CLAIM' and security is null")
    lo, hi = F.coalesce("lo", "opens"), F.coalesce("hi", "b")
    none = F.lit(None)
    each = stated.select(*SEG, F.concat(F.col("ticker"), F.lit("?"), F.col("leg")).alias("security"), lo.alias("lo"), F.greatest(hi, F.date_add(lo, 1)).alias("hi"), F.concat("kind", F.lit(":"), "status").alias("story"))
    exact = F.col("exact") & F.col("lo").isNotNull()
    pair = stated.groupBy(*SEG, "ticker").agg(F.min(F.when(exact & (F.col("kind") == "ADD"), F.col("lo"))).alias("lo"), F.max(F.when(exact & (F.col("kind") == "REMOVE"), F.col("lo"))).alias("hi")).filter("lo < hi")
    pair = pair.select(*SEG, F.concat("ticker", F.lit("?")).alias("security"), "lo", "hi", F.lit("ADD+REMOVE").alias("story"))
    return each.unionByName(pair).select(*SEG, "security", none.cast("string").alias("name"), "lo", "hi", F.lit("IDENTITY_GAP").alias("difference"), "story")


def _claims(legs: DataFrame, lines: DataFrame, securities: DataFrame, issuers: DataFrame) -> DataFrame:
    """(segment, leg, outcome): what an untrusted source's legs amount to.

    ALIAS: both legs of an event are of one issuer, or one is of a lineage. HINT: the security is explained, or
    open, by the anchors; or a change that the anchors show without an explanation can be what is meant, each once.
    NO_CHANGE: a security of which the anchors show no change. TRANSIENT: a ticker added and removed within the segment. EXCESS: more claims than changes.
    """
    c = legs.filter("status = 'CLAIM'").join(few(cut(issuers)), ["pool", "security"], "left")
    per_line = few(cut(lines.select(*SEG, F.explode(F.array("old", "new")).alias("security")))).withColumn("in_line", F.lit(True))
    c = c.join(per_line, [*SEG, "security"], "left").join(few(cut(lines.select(*SEG, F.col("issuer").alias("of_issuer")).distinct())).withColumn("issuer_line", F.lit(True)), [*SEG, "of_issuer"], "left")
    known = securities.filter("lo is not null or size(pinned) > 0").select(*SEG, "security").distinct().withColumn("told", F.lit(True))
    c = c.join(known, [*SEG, "security"], "left")
    event = Window.partitionBy(*SEG, "event")
    two = F.count("*").over(event) == 2
    one_issuer = (F.count("security").over(event) == 2) & (F.size(F.collect_set(F.coalesce(F.col("of_issuer").cast("string"), F.col("security").cast("string"))).over(event)) == 1)
    touches = F.max(F.coalesce("in_line", "issuer_line", F.lit(False))).over(event)
    ticker = Window.partitionBy(*SEG, "ticker")
    transient = F.max((F.col("kind") == "ADD").cast("int")).over(ticker) + F.max((F.col("kind") == "REMOVE").cast("int")).over(ticker) == 2
    c = c.withColumns({"alias": two & (one_issuer | touches), "transient": transient})
    first = F.when(F.col("alias"), "ALIAS").when(F.coalesce("told", F.lit(False)), "HINT").when(F.col("security").isNotNull() & ~F.col("transient"), "NO_CHANGE").when(F.col("transient"), "TRANSIENT")
    c = c.withColumn("outcome", first)
    room = securities.filter("lo is not null and in_a <> in_b").groupBy(*SEG, F.when(F.col("in_b"), "ADD").otherwise("REMOVE").alias("kind")).agg(F.count("*").alias("room"))
    c = cut(c.select(*SEG, "leg", "event", "kind", "outcome"))
    rest = c.filter("outcome is null").withColumn("nth", F.row_number().over(Window.partitionBy(*SEG, "kind").orderBy("event", "leg"))).join(room, [*SEG, "kind"], "left")
    rest = rest.withColumn("outcome", F.when(F.col("nth") <= F.coalesce("room", F.lit(0)), "HINT").otherwise("EXCESS"))
    return c.filter("outcome is not null").select(*SEG, "leg", "outcome").unionByName(rest.select(*SEG, "leg", "outcome"))


def reconcile(anchors: DataFrame, members: DataFrame, legs: DataFrame) -> Reconciled:
    """Every segment of every pool, reconciled. Members that repeat count once; legs are told apart by ``leg``."""
    legs = legs.withColumn("leg", F.col("leg").cast("string"))
    members = without_early(anchors, members, legs)
    segments = cut(segments_of(anchors))
    states = cut(_states(segments, members))
    lines = cut(lineage(states))
    inside = in_segments(legs, segments).join(few(lines).select(*SEG, F.col("old").alias("security"), "new"), [*SEG, "security"], "left")
    inside = cut(inside.withColumn("security", F.coalesce("new", "security")).drop("new").select(*SEG, "opens", *legs.drop("pool").columns))
    securities = cut(_linked(cut(_played(_renamed(states, lines), inside, segments))))
    issuers = members.filter("issuer is not null").groupBy("pool", "security").agg(F.min("issuer").alias("of_issuer"))
    claims = _claims(inside, lines, securities, issuers)
    told = cut(inside.join(claims, [*SEG, "leg"], "left"))
    passing = told.filter("outcome = 'TRANSIENT' and said is not null").groupBy(*SEG, "ticker").agg(F.min("said").alias("lo"), F.max("said").alias("hi"), F.max("backed").alias("__b")).filter("__b and lo < hi")
    passing = passing.select(*SEG, F.concat(F.lit("transient:"), "ticker").alias("security"), "lo", "hi", F.lit("TRANSIENT").alias("difference"), F.lit("CLAIM").alias("story"))
    securities = securities.withColumn("security", F.col("security").cast("string"))
    everything = securities.unionByName(cut(_open_legs(inside).unionByName(passing, allowMissingColumns=True)), allowMissingColumns=True)
    per = everything.groupBy(*SEG).agg(
        F.min(F.coalesce("forward_ok", F.lit(False))).alias("forward_ok"), F.min(F.coalesce("backward_ok", F.lit(False))).alias("backward_ok"), F.count("lo").alias("gaps"), F.count_if(F.col("in_a")).alias("members_a"), F.count_if(F.col("in_b")).alias("members_b"),
    )
    stated = told.groupBy(*SEG).agg(F.count_if(F.col("status") == "CONFIRMED").alias("confirmed"), F.count_if(F.col("outcome").isin("TRANSIENT", "EXCESS")).alias("blocking"))
    rows = segments.join(per, SEG, "left").join(stated, SEG, "left").fillna(0, ["gaps", "confirmed", "blocking", "members_a", "members_b"]).fillna(True, ["forward_ok", "backward_ok"])
    status = F.when(F.col("unresolved") > 0, "IDENTITY_UNRESOLVED").when(F.col("forward_ok") & F.col("backward_ok") & (F.col("blocking") == 0) & (F.col("gaps") == 0), "VALIDATED").otherwise("LOCAL_GAPS")
    return Reconciled(cut(rows.withColumn("status", status)), everything, told, lines)


def _state_at(day: Column) -> tuple[Column, Column]:
    """A security's state at the open of a day: from the first anchor by what has surely happened, and from the second less what surely comes later."""
    done, ahead = F.filter("pinned", lambda e: e["day"] <= day), F.filter("pinned", lambda e: e["day"] > day)
    pinned = F.coalesce(F.size("pinned") > 0, F.lit(False))
    a, b = F.col("in_a"), F.col("in_b")
    forward = F.when(pinned, F.when(F.size(done) > 0, F.element_at(done, -1)["kind"] == "ADD").otherwise(a)).when(F.col("lo").isNotNull(), F.when(F.col("hi") <= day, b).otherwise(a)).otherwise(a)
    backward = F.when(pinned, F.when(F.size(ahead) > 0, F.get(ahead, F.lit(0))["kind"] != "ADD").otherwise(b)).when(F.col("lo").isNotNull(), F.when(F.col("lo") > day, a).otherwise(b)).otherwise(b)
    return forward, backward


def members_at(found: Reconciled, days: DataFrame) -> DataFrame:
    """(pool, day, a, b, security, forward, backward, uncertain) for days (pool, day): whose membership either replay holds, or a window leaves open."""
    seg = found.segments.select(F.col("pool").alias("__p"), F.col("a").alias("__a"), F.col("b").alias("__b"))
    at = days.select("pool", "day").distinct().join(seg, (F.col("pool") == F.col("__p")) & (F.col("__a") < F.col("day")) & (F.col("day") <= F.col("__b")))
    at = at.select("pool", "day", F.col("__a").alias("a"), F.col("__b").alias("b"))
    forward, backward = _state_at(F.col("day"))
    uncertain = F.coalesce((F.col("lo") <= F.col("day")) & (F.col("day") < F.col("hi")), F.lit(False))
    rows = at.join(found.securities, SEG).select("pool", "day", "a", "b", "security", F.coalesce(forward, F.lit(False)).alias("forward"), F.coalesce(backward, F.lit(False)).alias("backward"), uncertain.alias("uncertain"))
    return rows.filter("forward or backward or uncertain")


def cohorts(found: Reconciled, days: DataFrame) -> DataFrame:
    """(pool, day, a, b, status, members, uncertain, sets_equal, daily_ready) for each of days (pool, day): READY, BLOCKED, or NO_ANCHOR on one side.

    A day is blocked by lines without a security, by a window that covers it, or by replays that disagree. Daily use needs the whole segment validated.
    """
    at = members_at(found, days).groupBy("pool", "day", "a", "b").agg(F.count_if("forward").alias("members"), F.count_if("uncertain").alias("uncertain"), F.min(F.col("forward") == F.col("backward")).alias("sets_equal"))
    seg = found.segments.select(F.col("pool").alias("__p"), F.col("a").alias("__a"), F.col("b").alias("__b"), "unresolved", F.col("status").alias("__s"))
    both = days.select("pool", "day").distinct().join(seg, (F.col("pool") == F.col("__p")) & (F.col("__a") < F.col("day")) & (F.col("day") <= F.col("__b")), "left")
    both = both.select("pool", "day", F.col("__a").alias("a"), F.col("__b").alias("b"), "unresolved", "__s").join(at.drop("a", "b"), ["pool", "day"], "left").fillna(0, ["members", "uncertain"]).fillna(True, ["sets_equal"])
    ready = (F.col("unresolved") == 0) & (F.col("uncertain") == 0) & F.col("sets_equal")
    status = F.when(F.col("a").isNull(), "NO_ANCHOR").when(ready, "READY").otherwise("BLOCKED")
    return both.select("pool", "day", "a", "b", status.alias("status"), F.when(status == "READY", F.col("members")).alias("members"), "uncertain", "sets_equal", F.coalesce(ready & (F.col("__s") == "VALIDATED"), F.lit(False)).alias("daily_ready"))


def classify_gaps(found: Reconciled, days: DataFrame) -> DataFrame:
    """(pool, a, b, what, difference, category, lo, hi, blocked): each gap, claim, second source's day and change of identity, and how many of days it can make unknown.

    What covers none of the days is RESOLVED for their use.
    """
    gaps = found.securities.filter("lo is not null").select(*SEG, F.col("security").cast("string").alias("what"), "difference", "lo", "hi")
    claims = found.legs.filter("outcome in ('TRANSIENT', 'EXCESS', 'NO_CHANGE')").select(*SEG, F.coalesce(F.col("security").cast("string"), F.concat("ticker", F.lit("?"))).alias("what"), F.col("outcome").alias("difference"))
    days_differ = found.legs.filter("status = 'CONFLICT' and exact and security is not null and other_day <> lo").select(*SEG, F.col("security").cast("string").alias("what"), F.lit("OTHER_DAY").alias("difference"))
    lines = found.aliases.select(*SEG, F.concat(F.col("old").cast("string"), F.lit(" -> "), F.col("new").cast("string")).alias("what"), F.lit("LINEAGE").alias("difference"))
    alias = found.legs.filter("outcome = 'ALIAS'").select(*SEG, F.coalesce(F.col("security").cast("string"), F.concat("ticker", F.lit("?"))).alias("what"), F.lit("ALIAS").alias("difference"))
    every = gaps
    for more in (claims, days_differ, lines, alias):
        every = every.unionByName(more, allowMissingColumns=True)
    asked = days.select(F.col("pool").alias("__p"), "day").distinct()
    # The days that a window covers, by pool and month, so that a gap meets the days of its own span only.
    month = F.explode_outer(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month")))
    numbered = cut(every.withColumn("__i", F.monotonically_increasing_id()))
    spans = numbered.filter("lo is not null").select("__i", "pool", "lo", "hi", month.alias("__m"))
    hit = spans.join(asked.select(F.col("__p").alias("pool"), "day", F.trunc("day", "month").alias("__m")), ["pool", "__m"]).filter("lo <= day and day < hi").groupBy("__i").agg(F.count("*").alias("blocked"))
    out = numbered.join(hit, "__i", "left").fillna(0, ["blocked"])
    crossing = F.col("blocked") > 0
    covered = {"MISSING_ADDITION": "EVENT_MISSING", "MISSING_REMOVAL": "EVENT_MISSING", "DATE_MISSING": "DATE_AMBIGUOUS", "UNEXPLAINED": "UNEXPLAINED", "IDENTITY_GAP": "IDENTITY_ONLY", "TRANSIENT": "TRANSIENT_POSSIBLE"}
    fixed = {"EXCESS": "UNCORROBORATED", "NO_CHANGE": "TICKER_OR_NAME_CHANGE", "ALIAS": "TICKER_OR_NAME_CHANGE", "LINEAGE": "SUCCESSOR", "OTHER_DAY": "DAY_CONFLICT"}
    category = F.lit(None).cast("string")
    for k, v in covered.items():
        rest = F.when(F.col("lo").isNull() | (F.col("difference") == "TRANSIENT"), "UNCORROBORATED").otherwise("RESOLVED")
        category = F.when(F.col("difference") == k, F.when(crossing, v).otherwise(rest)).otherwise(category)
    for k, v in fixed.items():
        category = F.when(F.col("difference") == k, v).otherwise(category)
    return out.select(*SEG, "what", "difference", category.alias("category"), "lo", "hi", "blocked")
