"""Identity segments: stated cases, and the query over its whole table against plain loops."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import identity as I
from tidemark.plans import membership

D, DAY = dt.date, dt.timedelta(1)
HORIZON = D(2001, 12, 31)
SPAN, POINT = "span long, start date, stop date", "span long, day date, isin string, sure boolean, exact boolean, candidates array<string>"
CHANGE, ISSUE = "old string, new string, day date, continuity string", "isin string, issuer string, issued date"


def plain(start, stop, points, changes, issues):
    """Segments of one span by loops. points: (day, isin, sure, exact, candidates)."""
    t, by_day = stop or HORIZON + DAY, {}
    for d, *rest in points:
        by_day.setdefault(d, []).append(rest)
    one = {}
    for d, rows in by_day.items():
        names = {r[0] for r in rows if r[0]}
        name = names.pop() if len(names) == 1 else None
        one[d] = (name, any(r[1] and r[0] for r in rows) and name is not None, any(r[2] and r[0] for r in rows) and name is not None, sorted({c for r in rows for c in (r[3] or [])} | {r[0] for r in rows if r[0]}))
    inside = sorted(d for d in one if start <= d < t)
    before, after = max((d for d in one if d < start), default=None), min((d for d in one if d >= t), default=None)
    segs = []
    if not inside:
        cands = sorted({c for d in (before, after) if d for c in one[d][3]})
        segs = [[start, t, "PROVISIONAL" if cands else "UNRESOLVED", None, cands, None]]
    sure, runs = {one[d][0] for d in inside if one[d][1]}, []
    for d in inside:
        if runs and runs[-1][0] == one[d][0]:
            runs[-1][1].append(d)
        else:
            runs.append((one[d][0], [d]))
    cursor, prev = start, None
    for i, (name, days) in enumerate(runs):
        first, until = days[0], days[-1] + DAY
        if name is None or name not in sure:
            cands = sorted({c for d in days for c in one[d][3]})
            segs.append([cursor, until, "PROVISIONAL" if cands else "UNRESOLVED", None, cands, None])
            cursor, prev = until, None
            continue
        begins, how = first, None
        change = changes.get((prev, name)) if prev else None
        issuer, issued = issues.get(name, (None, None))
        if change and cursor <= change[0] <= HORIZON + DAY:
            begins, how = change
            segs[-1][1] = begins
        elif cursor < first:
            if i == 0:
                came = min((d for (_, new), (d, _) in changes.items() if new == name), default=None)
                b = one.get(before) if before else None
                ok = (came and came <= start) or (b and b[2] and b[0] == name and (start - before).days <= 366) or (b and (b[0] == name or name in b[3]) and not (issued and issued > start))
                segs.append([start, first, "CONFIRMED", name, [], None] if ok else [start, first, "PROVISIONAL", None, [name], None])
            elif prev and issuer and issuer == issues.get(prev, (None,))[0] and issued and cursor <= issued <= first:
                begins = issued
                segs[-1][1] = begins
            else:
                segs.append([cursor, first, "PROVISIONAL", None, sorted(x for x in (prev, name) if x), None])
        segs.append([begins, until, "CONFIRMED", name, [], how])
        cursor, prev = until, name
    if runs and cursor < t:
        b = one.get(after) if after else None
        if prev and stop and b and (b[0] == prev or prev in b[3] or (b[0] is None and not b[3])):
            segs.append([cursor, t, "CONFIRMED", prev, [], None])
        else:
            segs.append([cursor, t, "PROVISIONAL", None, [prev] if prev else [], None])
    segs = sorted((s for s in segs if s[1] > s[0]), key=lambda s: s[:2])
    for s in segs:
        if s[3] and any(one[d][2] and one[d][0] == s[3] and s[0] <= d < s[1] for d in one):
            s[2] = "EXACT"
    out = []
    for s in segs:
        if out and s[3] and out[-1][3] == s[3] and out[-1][2] == s[2] and out[-1][1] == s[0]:
            out[-1][1], out[-1][5] = s[1], max(out[-1][5] or "", s[5] or "") or None
        else:
            out.append(s)
    return [(a, None if stop is None and b >= t else b, *rest) for a, b, *rest in out]


def run(spark, spans, points, changes=(), issues=()):
    got = I.identity_segments(spark.createDataFrame(spans, SPAN), spark.createDataFrame(points, POINT), spark.createDataFrame(list(changes), CHANGE), spark.createDataFrame(list(issues), ISSUE), F.lit(HORIZON))
    return sorted((r.span, r.start, r.end or D(9999, 1, 1), r.status, r.isin, tuple(r.candidates)) for r in got.collect())


def test_stated_cases(spark):
    d = lambda m, y=2000: D(y, m, 1)
    spans = [(1, d(1), d(12)), (2, d(1), None), (3, d(1), d(12)), (4, d(1), d(12)), (5, d(1), d(12)), (6, d(1), d(12))]
    points = [
        (1, d(12, 1999), "A", True, False, []), (1, d(3), "A", True, False, []), (1, d(6), "A", True, True, []), (1, d(12), "A", False, False, []),  # one identity throughout, bridged at both ends, said exactly in between
        (2, d(2), "B", True, False, []), (2, d(5), "C", True, False, []),  # an official change between; nothing before or after
        (3, d(2), "E", True, False, []), (3, d(5), "G", True, False, []),  # a new issue of the same issuer
        (4, d(2), "H", True, False, []), (4, d(5), "K", True, False, []),  # nothing bridges the two
        (5, d(2), None, False, False, ["L", "M"]), (5, d(3), "N", False, False, []), (5, d(3), "O", False, False, []), (5, d(8), None, False, False, []),  # candidates, sources that differ, nothing
    ]
    got = run(spark, spans, points, [("B", "C", d(4), "SAME")], [("E", "x", d(1)), ("G", "x", d(4)), ("H", "y", None), ("K", "z", d(4))])
    far = D(9999, 1, 1)
    assert got == [
        (1, d(1), d(3), "CONFIRMED", "A", ()), (1, d(3), D(2000, 6, 2), "EXACT", "A", ()), (1, D(2000, 6, 2), d(12), "CONFIRMED", "A", ()),
        (2, d(1), d(2), "PROVISIONAL", None, ("B",)), (2, d(2), d(4), "CONFIRMED", "B", ()), (2, d(4), D(2000, 5, 2), "CONFIRMED", "C", ()), (2, D(2000, 5, 2), far, "PROVISIONAL", None, ("C",)),
        (3, d(1), d(2), "PROVISIONAL", None, ("E",)), (3, d(2), d(4), "CONFIRMED", "E", ()), (3, d(4), D(2000, 5, 2), "CONFIRMED", "G", ()), (3, D(2000, 5, 2), d(12), "PROVISIONAL", None, ("G",)),
        (4, d(1), d(2), "PROVISIONAL", None, ("H",)), (4, d(2), D(2000, 2, 2), "CONFIRMED", "H", ()), (4, D(2000, 2, 2), d(5), "PROVISIONAL", None, ("H", "K")), (4, d(5), D(2000, 5, 2), "CONFIRMED", "K", ()), (4, D(2000, 5, 2), d(12), "PROVISIONAL", None, ("K",)),
        (5, d(1), D(2000, 8, 2), "PROVISIONAL", None, ("L", "M", "N", "O")), (5, D(2000, 8, 2), d(12), "PROVISIONAL", None, ()),
        (6, d(1), d(12), "UNRESOLVED", None, ()),
    ]


def test_coverage(spark):
    segs = [(1, D(2000, 1, 1), None, "EXACT"), (2, D(2000, 1, 1), D(2000, 6, 1), "PROVISIONAL"), (2, D(2000, 6, 1), None, "CONFIRMED"), (3, D(2000, 1, 1), D(2000, 2, 1), "UNRESOLVED"), (4, D(2000, 1, 1), None, "UNRESOLVED"), (5, D(2000, 1, 1), None, "CONFIRMED")]
    spans = [(1, D(2000, 1, 1), None), (2, D(2000, 1, 1), None), (3, D(2000, 1, 1), D(2000, 2, 1)), (4, D(2000, 1, 1), None), (5, D(2000, 1, 1), None)]
    s, p = spark.createDataFrame(segs, "span long, start date, end date, status string"), spark.createDataFrame(spans, SPAN)
    assert tuple(I.coverage_metrics(s, p, F.lit(D(2000, 3, 1))).first()) == (4, 1, 1, 1, 1, 50.0)
    assert tuple(I.coverage_metrics(s, p, F.lit(D(2000, 7, 1))).first()) == (4, 1, 2, 0, 1, 75.0)


def test_identity_query_against_the_loop(spark, sf):
    spans, points, changes, issues = (t.collect() for t in membership.observations(spark, sf))
    change, issue, by = {(r.old, r.new): (r.day, r.continuity) for r in changes}, {r.isin: (r.issuer, r.issued) for r in issues}, {}
    for p in points:
        by.setdefault(p.span, []).append((p.day, p.isin, p.sure, p.exact, p.candidates))
    got = {}
    for r in membership.identity_segments(spark, sf).collect():
        got.setdefault(r.span, []).append((r.start, r.end, r.status, r.isin, list(r.candidates), r.continuity))
    assert len(spans) > 50 and got.keys() == {s.span for s in spans}
    for s in spans:
        want = plain(s.start, s.stop, by.get(s.span, []), change, issue)
        assert sorted(got[s.span], key=str) == sorted(want, key=str), s
    kinds = {x[2] for v in got.values() for x in v}
    assert kinds >= {"EXACT", "CONFIRMED", "PROVISIONAL"}
