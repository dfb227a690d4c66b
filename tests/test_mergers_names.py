"""Value along mergers and names as of a day: stated cases, and loops over random links."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import mergers as M
from tidemark.operators import names as N

D = dt.date
ACTION = "k string, action_id long, kind string, ex_date date, announced_at timestamp, ratio double, cash_amount double, target_key string, value_per_share double"
BAR = "k string, session_date date, close double"


def day(i):
    return D(2024, 1, 1) + dt.timedelta(i)


def act(k, kind, i, ratio=None, cash=None, target=None, value=None, said=dt.datetime(2023, 1, 1), number=[0]):
    number[0] += 1
    return (k, number[0], kind, day(i), said, ratio, cash, target, value)


def bars(spark, **closes):
    return spark.createDataFrame([(k, day(i), c) for k, cs in closes.items() for i, c in enumerate(cs) if c is not None], BAR)


def returns(spark, b, acts, k="a", as_of=None):
    got = M.total_return_in_kind(b, spark.createDataFrame(acts, ACTION), "k", as_of)
    return [(r.session_date, r.gross, r.tr_level, r.note, r.problem) for r in got.filter(F.col("k") == k).orderBy("session_date").collect()]


def test_a_chain_of_three_is_worth_what_the_last_is(spark):
    """a becomes half a b on day 2, b two c on day 4, c three d on day 5."""
    acts = [act("a", "STOCK_ACQUISITION", 2, 0.5, target="b"), act("b", "STOCK_ACQUISITION", 4, 2.0, target="c"), act("c", "STOCK_ACQUISITION", 5, 3.0, target="d")]
    b = bars(spark, a=[10.0, 10.0], b=[20.0, 21.0, 22.0, 23.0], c=[11.0] * 5, d=[4.0] * 9)
    held = M.holdings(M.terminals(spark.createDataFrame(acts, ACTION), "k"), "k")
    got = sorted((r.since or day(0), r.until, r.holder, r.factor) for r in held.filter("k = 'a'").collect())
    assert got == [(day(0), day(2), "a", 1.0), (day(2), day(4), "b", 0.5), (day(4), day(5), "c", 1.0), (day(5), None, "d", 3.0)]
    asked = spark.createDataFrame([("a", day(i)) for i in (1, 3, 4, 6, 40)] + [("z", day(1))], "k string, at date")
    worth = {(r.k, r["at"]): (r.holder, r.value) for r in M.followed_close(asked, held, b, "k", "at").collect()}
    assert worth == {("a", day(1)): ("a", 10.0), ("a", day(3)): ("b", 11.5), ("a", day(4)): ("c", 11.0), ("a", day(6)): ("d", 12.0), ("a", day(40)): ("d", None), ("z", day(1)): ("z", None)}
    assert returns(spark, b, acts)[-1] == (day(2), pytest.approx(1.1), pytest.approx(1.1), "STOCK_ACQUISITION", None)
    # Acquirer and its own acquirer on one day: the value is the last one's.
    same = [act("a", "STOCK_ACQUISITION", 2, 0.5, target="b"), act("b", "STOCK_ACQUISITION", 2, 2.0, target="c")]
    assert returns(spark, b, same)[-1][1] == pytest.approx(0.5 * 2 * 11 / 10)


def test_cycles_and_steps_into_the_past_are_refused(spark):
    acts = [act("a", "STOCK_ACQUISITION", 2, 1.0, target="b"), act("b", "STOCK_ACQUISITION", 2, 1.0, target="a"), act("e", "STOCK_ACQUISITION", 4, 1.0, target="f"), act("f", "BANKRUPTCY", 1)]
    b = bars(spark, a=[10.0, 11.0], b=[20.0, 21.0], e=[5.0] * 4, f=[1.0])
    assert returns(spark, b, acts)[-1] == (day(2), None, None, "STOCK_ACQUISITION", "CYCLE")
    held = M.holdings(M.terminals(spark.createDataFrame(acts, ACTION), "k"), "k")
    assert {(r.k, r.problem) for r in held.filter("problem is not null").collect()} == {("a", "CYCLE"), ("b", "CYCLE"), ("e", "TARGET_GONE")}
    with pytest.raises(Exception, match="undefined: CYCLE"):
        M.refuse_problems(M.total_return_in_kind(b, spark.createDataFrame(acts, ACTION), "k")).collect()


def test_ends(spark):
    b = bars(spark, a=[40.0, 45.0, 49.0], c=[5.0, 3.0, 1.0], e=[8.0, 9.0, 10.0], g=[8.0, 9.0], h=[8.0, 9.0], i=[6.0, 6.0])
    acts = [
        act("a", "CASH_ACQUISITION", 2, cash=50.0), act("a", "DELISTING", 2), act("c", "BANKRUPTCY", 2), act("e", "DELISTING", 2), act("g", "CASH_ACQUISITION", 2, cash=9.0), act("g", "BANKRUPTCY", 2),
        act("h", "STOCK_ACQUISITION", 2, 1.0, target="nobody"), act("i", "BANKRUPTCY", 2, value=1.5),
    ]
    last = lambda k: returns(spark, b, acts, k)[-1][1:]
    assert last("a") == (pytest.approx(50 / 45), pytest.approx(50 / 40), "CASH_ACQUISITION", None) and last("c") == (0.0, 0.0, "BANKRUPTCY", None)
    assert last("e") == (pytest.approx(10 / 9), pytest.approx(10 / 8), "DELISTING", None) and last("i")[0] == pytest.approx(0.25)
    assert last("g") == (None, None, "CASH_ACQUISITION", "CONFLICT") or last("g")[3] == "CONFLICT"
    assert last("h") == (None, None, "STOCK_ACQUISITION", "UNVALUED")


def test_value_paid_in_kind(spark):
    """A spun-off share at a tenth of its close, one with a stated value, one on a day without a bar, and one that nothing values."""
    b = bars(spark, a=[100.0, 90.0, None, 88.0, 80.0], s=[None, 95.0, 96.0, 97.0, 98.0])
    acts = [act("a", "SPINOFF", 1, 0.1, target="s"), act("a", "SPECIAL_DIVIDEND", 1, cash=1.0), act("a", "REVERSE_SPLIT", 2, 0.5), act("a", "RIGHTS_ISSUE", 2, value=4.0)]
    got = returns(spark, b, acts)
    assert [g[1] for g in got] == [None, pytest.approx((90 + 1 + 9.5) / 100), pytest.approx((0.5 * 88 + 4) / 90), pytest.approx(80 / 88)]
    lost = returns(spark, b, [*acts, act("a", "SCRIP_DIVIDEND", 3)])
    assert [(g[1] is None, g[2] is None, g[4]) for g in lost] == [(True, False, None), (False, False, None), (True, True, "UNVALUED"), (False, True, None)]
    known = returns(spark, b, [act("a", "SPINOFF", 1, 0.1, target="s", said=dt.datetime(2024, 1, 20))], as_of=F.lit("2024-01-10").cast("timestamp"))
    assert known[1][1] == pytest.approx(0.9)
    assert M.total_return_in_kind(b.limit(0), spark.createDataFrame([], ACTION), "k").count() == 0


def plain_names(listings, changes):
    nodes = [(f"L:{s}:{n}:{d}", n, d, s, None) for s, n, d in listings] + [(f"C:{c}", new, d, None, old) for c, old, new, d in changes]
    parent, children = {}, {}
    for node, _, d, _, old in nodes:
        if old is not None:
            earlier = [(e, m) for m, n, e, _, _ in nodes if n == old and e < d]
            parent[node] = max(earlier)[1] if earlier else None
            children.setdefault(parent[node], []).append((d, node))
    out = {}
    for node, name, d, s, old in nodes:
        status, at, first = "HELD", node, True
        while status == "HELD" and at in parent:
            p = parent[at]
            if p is None:
                status = "UNKNOWN_NAME" if first else "NOT_HELD"
            elif min(children[p])[1] != at:
                status = "NOT_HELD"
            at, first = p, False
        later = [(e, m) for m, n, e, _, _ in nodes if n == name and (e, m) > (d, node)]
        ends = [min(later)[0]] if later else []
        if children.get(node):
            ends.append(min(children[node])[0])
        security = next((x[3] for x in nodes if x[0] == at), None) if status == "HELD" else None
        out[node] = (name, d, min(ends) if ends else None, security, status)
    return out


@pytest.mark.parametrize("seed", [2])
def test_name_history_against_loops(spark, seed):
    rng = random.Random(seed)
    listings = [(f"s{i}", f"N{i}", D(2000, 1, 1)) for i in range(12)]
    changes = [(i, f"N{rng.randrange(14)}", f"N{rng.randrange(14)}", D(2000, 1, 1) + dt.timedelta(rng.randrange(0, 60))) for i in range(40)]
    h = N.name_history(spark.createDataFrame(listings, "security string, name string, since date"), spark.createDataFrame(changes, "change int, old string, new string, day date"))
    assert {r.node: (r.name, r.since, r.until, r.security, r.status) for r in h.collect()} == plain_names(listings, changes)


def test_a_reused_ticker_and_a_link_from_the_future(spark):
    """one leaves X for Y, two then takes X; what is announced later has no part in what was known."""
    listings = spark.createDataFrame([("one", "X", D(2000, 1, 1)), ("two", "W", D(2000, 1, 1))], "security string, name string, since date")
    changes = spark.createDataFrame([(1, "X", "Y", D(2001, 1, 1), D(2000, 12, 1)), (2, "W", "X", D(2002, 1, 1), D(2001, 12, 1)), (3, "Y", "Z", D(2003, 1, 1), D(2004, 1, 1)), (4, "Q", "R", D(2003, 1, 1), D(2003, 1, 1))], "change int, old string, new string, day date, known date")
    points = spark.createDataFrame([("X", D(2000, 6, 1)), ("X", D(2001, 6, 1)), ("X", D(2002, 6, 1)), ("Y", D(2003, 6, 1)), ("Z", D(2003, 6, 1)), ("R", D(2003, 6, 1)), ("W", D(1999, 1, 1)), ("X", D(2000, 6, 1)), (None, D(2000, 6, 1))], "name string, at date")
    whole, then = (N.names_as_of(points, N.name_history(listings, changes, a), "name", "at") for a in (None, F.lit("2003-12-31").cast("date")))
    told = lambda df: sorted((r.name or "", r["at"].year, r.security, r.status) for r in df.collect())
    same = [("", 2000, None, "UNKNOWN"), ("R", 2003, None, "REFUSED"), ("W", 1999, None, "UNKNOWN"), ("X", 2000, "one", "HELD"), ("X", 2000, "one", "HELD"), ("X", 2001, None, "LEFT"), ("X", 2002, "two", "HELD")]
    assert told(whole) == same + [("Y", 2003, None, "LEFT"), ("Z", 2003, "one", "HELD")]
    assert told(then) == same + [("Y", 2003, "one", "HELD"), ("Z", 2003, None, "UNKNOWN")]


def test_rename_statements_need_one_security_on_either_side(spark):
    seen = [("old", "s1", D(2020, 1, 1)), ("new", "s2", D(2020, 9, 1)), ("two", "s3", D(2020, 1, 1)), ("two", "s4", D(2020, 1, 1)), ("late", "s5", D(2021, 1, 1)), ("same", "s6", D(2020, 1, 1)), ("same", "s6", D(2021, 1, 1))]
    said = [(1, "old", "new", D(2020, 6, 1)), (2, "two", "new", D(2020, 6, 1)), (3, "late", "new", D(2020, 6, 1)), (4, "same", "same", D(2020, 6, 1)), (5, "old", "nobody", D(2020, 6, 1)), (6, "old", "new", D(2020, 9, 2))]
    got = N.rename_links(spark.createDataFrame(said, "id int, old string, new string, announced date"), spark.createDataFrame(seen, "name string, security string, day date")).collect()
    assert {r.id: (r.status, r.old_security, r.new_security) for r in got} == {1: ("LINKED", "s1", "s2"), **{i: ("SKIPPED", None, None) for i in (2, 3, 4, 5, 6)}}
    assert {r.id: r.reason for r in got}[4] == "the name is still the same security's"
