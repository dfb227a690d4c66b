"""Segments between dated compositions: the stated cases, and random worlds against plain loops."""

import datetime as dt
import random

import pytest

from tidemark.operators import segments as S

D = dt.date
ANCHOR = "pool string, as_of date, opens date, early boolean, unresolved int"
MEMBER = "pool string, as_of date, security string, issuer string, name string, shares double, weak boolean"
LEG = "pool string, leg int, event int, kind string, ticker string, security string, status string, lo date, hi date, exact boolean, said date, other_day date, backed boolean"


class World:
    def __init__(self, pool="p"):
        self.pool, self.anchors, self.members, self.legs = pool, [], [], []

    def anchor(self, day, securities, early=False, unresolved=0, issuers={}, names={}, shares={}, weak=()):
        self.anchors.append((self.pool, day, day + dt.timedelta(1), early, unresolved))
        self.members += [(self.pool, day, x, issuers.get(x), names.get(x, f"{x} Corp"), shares.get(x, 100.0), x in weak) for x in securities]

    def leg(self, kind, security, lo=None, status="CONFIRMED", hi=None, exact=None, said=None, event=None, ticker=None, other=None, backed=False):
        exact = (lo is not None and status in ("CONFIRMED", "CONFLICT")) if exact is None else exact
        hi = lo if exact else hi
        self.legs.append((self.pool, len(self.legs), len(self.legs) if event is None else event, kind, ticker or security or "T", security, status, lo, hi, exact, said, other, backed))

    def run(self, spark):
        return S.reconcile(spark.createDataFrame(self.anchors, ANCHOR), spark.createDataFrame(self.members, MEMBER), spark.createDataFrame(self.legs, LEG))


def days(spark, *ds, pool="p"):
    return spark.createDataFrame([(pool, d) for d in ds], "pool string, day date")


def chain():
    w = World()
    w.anchor(D(2020, 3, 31), "ABC")
    w.anchor(D(2020, 6, 30), "ABD")
    w.leg("ADD", "D", D(2020, 5, 12), event=1)
    w.leg("REMOVE", "C", D(2020, 5, 12), event=1)
    return w


def at(found, spark, *ds):
    out = {d: set() for d in ds}
    for r in S.members_at(found, days(spark, *ds)).filter("forward").collect():
        out[r.day].add(r.security)
    return out


def statuses(found, spark, *ds):
    return [r.status for r in S.cohorts(found, days(spark, *ds)).orderBy("day").collect()]


APRIL, MAY, JUNE = D(2020, 4, 1), D(2020, 5, 1), D(2020, 6, 1)


def test_both_replays_agree_and_days_are_exact(spark):
    found = chain().run(spark)
    seg = found.segments.first()
    assert seg.forward_ok and seg.backward_ok and seg.status == "VALIDATED" and seg.confirmed == 2
    assert at(found, spark, APRIL, MAY, JUNE) == {APRIL: set("ABC"), MAY: set("ABC"), JUNE: set("ABD")}
    assert S.members_at(found, days(spark, APRIL, MAY, JUNE)).filter("forward <> backward or uncertain").count() == 0
    got = S.cohorts(found, days(spark, D(2020, 3, 31), APRIL, JUNE, D(2020, 7, 1))).orderBy("day").collect()
    assert [(r.status, r.members, r.daily_ready) for r in got] == [("NO_ANCHOR", None, False), ("READY", 3, True), ("READY", 3, True), ("NO_ANCHOR", None, False)]


def test_a_gap_blocks_only_its_own_segment_and_the_future_changes_nothing(spark):
    w = chain()
    w.anchor(D(2020, 9, 30), "ABE")
    w.leg("ADD", None, D(2025, 6, 2), ticker="X")
    w.leg("ADD", None, None, status="CLAIM", said=D(2025, 7, 7), ticker="Q")
    found = w.run(spark)
    assert statuses(found, spark, APRIL, MAY, JUNE, D(2020, 7, 1), D(2020, 9, 1)) == ["READY"] * 3 + ["BLOCKED"] * 2
    assert [r.status for r in found.segments.orderBy("a").collect()] == ["VALIDATED", "LOCAL_GAPS"]
    assert {(r.security, r.difference, r.lo, r.hi) for r in found.securities.filter("lo is not null").collect()} == {("D", "MISSING_REMOVAL", D(2020, 7, 1), D(2020, 9, 30)), ("E", "MISSING_ADDITION", D(2020, 7, 1), D(2020, 9, 30))}
    gaps = S.classify_gaps(found, days(spark, D(2020, 8, 3), D(2020, 9, 1), D(2021, 1, 4))).collect()
    assert {(r.what, r.category, r.blocked) for r in gaps} == {("D", "EVENT_MISSING", 2), ("E", "EVENT_MISSING", 2)}
    assert {r.category for r in S.classify_gaps(found, days(spark, APRIL)).collect()} == {"RESOLVED"}


def test_lines_without_a_security_fail_closed(spark):
    w = chain()
    w.anchors[1] = (*w.anchors[1][:4], 1)
    found = w.run(spark)
    assert found.segments.first().status == "IDENTITY_UNRESOLVED" and statuses(found, spark, APRIL) == ["BLOCKED"]


def test_one_issuer_under_a_new_security_is_no_change_of_membership(spark):
    w = World()
    w.anchor(D(2020, 3, 31), "AB", issuers={"A": "i1", "B": "i2"})
    w.anchor(D(2020, 6, 30), "AN", issuers={"A": "i1", "N": "i2"})
    w.leg("REMOVE", "B", None, status="CLAIM", said=D(2020, 5, 5), event=1)
    w.leg("ADD", "N", None, status="CLAIM", said=D(2020, 5, 5), event=1)
    found = w.run(spark)
    assert found.segments.first().status == "VALIDATED" and statuses(found, spark, MAY) == ["READY"]
    assert [(r.old, r.new) for r in found.aliases.collect()] == [("B", "N")] and {r.outcome for r in found.legs.collect()} == {"ALIAS"}
    assert {r.category for r in S.classify_gaps(found, days(spark, MAY)).collect()} == {"SUCCESSOR", "TICKER_OR_NAME_CHANGE"}
    two = World()
    two.anchor(D(2020, 3, 31), "ABC", issuers={"B": "i2", "C": "i2"})
    two.anchor(D(2020, 6, 30), "AN", issuers={"N": "i2"})
    found = two.run(spark)
    assert found.aliases.count() == 0 and found.segments.first().status == "LOCAL_GAPS"


def test_claims_never_give_days(spark):
    """A claim of no change is a note; one that an open change can explain is a hint; one too many, and a ticker in and out, block daily use, and months only if a text backs it."""
    w = chain()
    w.leg("ADD", "A", None, status="CLAIM", said=D(2020, 5, 4))
    found = w.run(spark)
    assert found.segments.first().status == "VALIDATED" and [r.outcome for r in found.legs.filter("status = 'CLAIM'").collect()] == ["NO_CHANGE"]
    w.leg("ADD", None, None, status="CLAIM", said=D(2020, 5, 4), ticker="Z")
    found = w.run(spark)
    assert found.segments.first().status == "LOCAL_GAPS" and statuses(found, spark, MAY) == ["READY"] and found.legs.filter("outcome = 'EXCESS'").count() == 1
    for backed, status in ((False, "READY"), (True, "BLOCKED")):
        w = chain()
        w.leg("ADD", None, None, status="CLAIM", said=D(2020, 4, 20), ticker="Q", backed=backed)
        w.leg("REMOVE", None, None, status="CLAIM", said=D(2020, 5, 20), ticker="Q")
        found = w.run(spark)
        assert found.legs.filter("outcome = 'TRANSIENT'").count() == 2 and statuses(found, spark, APRIL, MAY, JUNE) == ["READY", status, "READY"]
    w = World()
    w.anchor(D(2020, 3, 31), "AB")
    w.anchor(D(2020, 6, 30), "ABE")
    w.leg("ADD", None, None, status="CLAIM", said=D(2020, 5, 4), ticker="EE")
    w.leg("ADD", None, None, status="CLAIM", said=D(2020, 5, 5), ticker="FF")
    assert [r.outcome for r in w.run(spark).legs.orderBy("leg").collect()] == ["HINT", "EXCESS"]


def test_an_early_anchor_holds_the_additions_of_its_next_session(spark):
    w = World()
    w.anchor(D(2022, 6, 30), "AB")
    w.anchor(D(2022, 9, 30), "ABN", early=True)
    w.leg("ADD", "N", D(2022, 10, 1))
    found = w.run(spark)
    assert found.segments.first().status == "VALIDATED" and found.segments.first().members_b == 2


def test_two_sources_days_and_statements_without_one(spark):
    w = World()
    w.anchor(D(2020, 3, 31), "AB")
    w.anchor(D(2020, 6, 30), "AC")
    w.leg("ADD", "C", D(2020, 5, 5), status="CONFLICT", other=D(2020, 4, 29), event=1)
    w.leg("REMOVE", "B", D(2020, 5, 5), status="CONFLICT", other=D(2020, 4, 29), event=1)
    found = w.run(spark)
    assert statuses(found, spark, APRIL, MAY, JUNE) == ["READY"] * 3 and {r.category for r in S.classify_gaps(found, days(spark, MAY)).collect()} == {"DAY_CONFLICT"}
    w = World()
    w.anchor(D(2020, 3, 31), "AB")
    w.anchor(D(2020, 6, 30), "A")
    w.leg("REMOVE", "B", D(2020, 4, 20), status="UNDATED", exact=False)
    w.leg("REMOVE", "B", D(2020, 5, 10), status="UNDATED", exact=False)  # said again: one event, the widest span
    found = w.run(spark)
    assert statuses(found, spark, APRIL, MAY, JUNE) == ["READY", "BLOCKED", "BLOCKED"]
    assert [(r.difference, r.lo, r.hi, r.story) for r in found.securities.filter("lo is not null").collect()] == [("DATE_MISSING", D(2020, 4, 20), D(2020, 6, 30), "REMOVE:UNDATED")]


def test_alike_names_and_sizes_are_gaps_of_identity(spark):
    w = World()
    w.anchor(D(2020, 3, 31), "ABX", names={"B": "Big Blue Holdings", "X": "Red Corp"}, shares={"B": 10.0})
    w.anchor(D(2020, 6, 30), "ACY", names={"C": "Big Blue Group", "Y": "Green Corp"}, shares={"C": 15.0})
    got = {r.security: (r.difference, r.linked_with) for r in w.run(spark).securities.filter("lo is not null").collect()}
    assert got == {"B": ("IDENTITY_GAP", "C"), "C": ("IDENTITY_GAP", "B"), "X": ("MISSING_REMOVAL", None), "Y": ("MISSING_ADDITION", None)}


def test_unresolved_primary_legs(spark):
    w = chain()
    w.leg("ADD", None, D(2020, 4, 15), ticker="Q")
    w.leg("REMOVE", None, D(2020, 5, 20), ticker="Q")
    found = w.run(spark)
    assert not found.segments.first().forward_ok and statuses(found, spark, APRIL, MAY, JUNE) == ["READY", "BLOCKED", "READY"]
    w = chain()
    w.legs[0] = (*w.legs[0][:4], "D", "D", "CONFIRMED", D(2020, 5, 12), D(2020, 5, 12), True, None, None, False)
    w.leg("REMOVE", "D", D(2020, 4, 15))  # a removal of none
    got = w.run(spark)
    assert [(r.security, r.difference, r.lo, r.hi) for r in got.securities.filter("lo is not null").collect()] == [("D", "UNEXPLAINED", D(2020, 4, 1), D(2020, 6, 30))]


def plain(world, day):
    """Of a world whose legs are all resolved and stated: (status by segment, states at the day) by loops."""
    byday = {a[1]: {m[2] for m in world.members if m[1] == a[1]} for a in world.anchors}
    ends, out, state = sorted(byday), {}, {}
    for a, b in zip(ends, ends[1:]):
        lo0, forward, backward, gaps = a + dt.timedelta(1), set(byday[a]), set(byday[b]), {}
        inside = [x for x in world.legs if x[7] and lo0 <= x[7] <= b]
        exact = sorted((x[7], x[3], x[1], x[5]) for x in inside if x[9])
        bad_f = bad_b = 0
        for _, kind, _, x in exact:
            bad_f += (kind == "ADD") == (x in forward)
            forward = forward | {x} if kind == "ADD" else forward - {x}
        for _, kind, _, x in exact[::-1]:
            bad_b += (kind == "ADD") != (x in backward)
            backward = backward - {x} if kind == "ADD" else backward | {x}
        pins = {}
        for x in byday[a] | byday[b] | {leg[5] for leg in inside}:
            events = []
            for leg in sorted((g for g in inside if g[5] == x), key=lambda g: (g[7], g[3], str(g[1]))):
                now = {"kind": leg[3], "lo": leg[7], "hi": leg[8], "exact": leg[9], "status": leg[6]}
                if events and events[-1]["kind"] == now["kind"]:
                    last = events[-1]
                    if now["exact"] and not last["exact"]:
                        events[-1] = now
                    elif not last["exact"]:
                        last["lo"] = min(last["lo"], now["lo"])
                        last["hi"] = max((h for h in (last["hi"], now["hi"]) if h), default=None)
                else:
                    events.append(now)
            member, known, lo, hi, ok = x in byday[a], lo0, None, None, True
            for e in events:
                if member == (e["kind"] == "ADD"):
                    ok = False
                    break
                member = not member
                if e["exact"]:
                    known = max(known, e["lo"])
                else:
                    lo, hi = min(lo or e["lo"], e["lo"]), max(hi or e["hi"] or b, e["hi"] or b)
            if ok and member == (x in byday[b]) and lo is None:
                pins[x] = [(e["lo"], e["kind"]) for e in events]
            else:
                gaps[x] = (lo or known, hi or b) if ok else (lo0, b)
        out[a] = "VALIDATED" if not gaps and forward == byday[b] and backward == byday[a] and not bad_f and not bad_b else "LOCAL_GAPS"
        if a < day <= b:
            for x in byday[a] | byday[b] | set(pins) | set(gaps):
                f, g, unsure = x in byday[a], x in byday[b], False
                if pins.get(x):
                    for d, kind in pins[x]:
                        f = (kind == "ADD") if d <= day else f
                    for d, kind in pins[x][::-1]:
                        g = (kind != "ADD") if d > day else g
                elif x in gaps:
                    lo, hi = gaps[x]
                    f, g, unsure = (x in byday[b] if hi <= day else x in byday[a]), (x in byday[a] if lo > day else x in byday[b]), lo <= day < hi
                else:
                    g = f
                if f or g or unsure:
                    state[x] = (f, g, unsure)
    return out, state


def test_segment_queries_against_the_loop(spark, sf):
    """Both queries over the whole table: every segment's status and counts, and every member."""
    from tidemark.plans import membership

    anchors, members, legs = (t.collect() for t in membership.world(spark, sf))
    status = {(r.pool, r.a): r for r in membership.segment_status(spark, sf).collect()}
    held = {}
    for r in membership.anchor_members(spark, sf).collect():
        held.setdefault((r.pool, r.day), {})[r.security] = (r.forward, r.backward, r.uncertain)
    pools = sorted({a.pool for a in anchors})
    assert len(status) == len(pools) * (len(membership.YEARS) - 1)
    for p in pools:
        w = World(p)
        w.anchors = [tuple(a) for a in anchors if a.pool == p]
        w.members = [tuple(m) for m in members if m.pool == p]
        w.legs = [tuple(x) for x in legs if x.pool == p and x.status != "CLAIM"]
        for y in membership.YEARS[:-1]:
            want, state = plain(w, D(y, 7, 1))
            assert held.get((p, D(y, 7, 1)), {}) == state
            got, claims = status[p, D(y - 1, 12, 31)], {}
            for x in legs:
                if x.pool == p and x.status == "CLAIM" and x.said.year == y:
                    claims.setdefault(x.ticker, []).append(x)
            told = {x[5] for x in w.legs if x[7].year == y}  # each names a change: pinned or open
            member = {e: {m[2] for m in w.members if m[1] == D(e - 1, 12, 31)} for e in (y, y + 1)}
            told |= member[y] ^ member[y + 1]
            passing = sum(len(c) for t, c in claims.items() if len({x.kind for x in c}) == 2 and t not in told)
            assert got.blocking == passing and got.status == ("LOCAL_GAPS" if passing else want[D(y - 1, 12, 31)])
            assert got.confirmed == sum(x[6] == "CONFIRMED" and x[7].year == y for x in w.legs) and (got.members_a, got.members_b) == (len(member[y]), len(member[y + 1]))


@pytest.mark.parametrize("seed", [2])
def test_random_worlds_against_loops(spark, seed):
    """Several pools at once; additions and removals with and without days, repeated, contradictory and missing."""
    rng, worlds = random.Random(seed), []
    for p in range(4):
        w = World(f"p{p}")
        now = {f"s{i}" for i in range(12)}
        for k in range(4):
            w.anchor(D(2020, 1 + 3 * k, 1), sorted(now))
            then = {x for x in now if rng.random() > 0.25} | {f"s{rng.randrange(20)}" for _ in range(4)}
            for x in sorted(now ^ then) + [f"s{rng.randrange(20)}" for _ in range(3)]:
                for _ in range(rng.choice([0, 1, 1, 1, 2])):
                    day, exact = D(2020, 1 + 3 * k, 2) + dt.timedelta(rng.randrange(85)), rng.random() < 0.7
                    w.leg("ADD" if (x in then) != (rng.random() < 0.1) else "REMOVE", x, day, status="CONFIRMED" if exact else "UNDATED", exact=exact, hi=None if exact or rng.random() < 0.5 else day + dt.timedelta(9))
            now = then
        worlds.append(w)
    tables = [spark.createDataFrame([r for w in worlds for r in getattr(w, n)], s) for n, s in (("anchors", ANCHOR), ("members", MEMBER), ("legs", LEG))]
    found = S.reconcile(*tables)
    got = {(r.pool, r.a): r.status for r in found.segments.collect()}
    asked = [D(2020, 2, 3), D(2020, 4, 1), D(2020, 5, 18), D(2020, 9, 15)]
    at_ = {}
    for r in S.members_at(found, spark.createDataFrame([(w.pool, d) for w in worlds for d in asked], "pool string, day date")).collect():
        at_.setdefault((r.pool, r.day), {})[r.security] = (r.forward, r.backward, r.uncertain)
    for w in worlds:
        for d in asked:
            status, state = plain(w, d)
            assert {a: got[w.pool, a] for a in status} == status
            assert at_.get((w.pool, d), {}) == state


def test_no_anchors_and_no_legs(spark):
    w = World()
    w.anchor(D(2020, 3, 31), "A")
    found = w.run(spark)
    assert found.segments.count() == 0 and statuses(found, spark, APRIL) == ["NO_ANCHOR"]
    w.anchor(D(2020, 6, 30), "A")
    assert w.run(spark).segments.first().status == "VALIDATED"
