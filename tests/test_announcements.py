"""Changes of an index read from announcement texts."""

from datetime import date

import pytest

from tidemark.sources import announcements as A

LEAD = (
    "NEW YORK , Dec. 22, 2010 /Wire/ -- S&P will make the following changes to the S&P 500, S&P MidCap 400, and S&P SmallCap 600 Indices after the close of trading on Monday, January 3, 2011 : "
    "Alpha Mobility Holdings Inc. (NYSE: AMH ) will replace Beta Corp. (NYSE: BTA ) in the S&P 500 index, Beta will replace Gamma Bell Inc. (NYSE: GMB ) in the S&P MidCap 400 index, and Gamma Bell will replace "
    "Delta Corp. (NASD: DLT) in the S&P SmallCap 600 index. S&P 500 constituent Alpha (NYSE: ALP ) is spinning off Alpha Mobility Holdings to its shareholders in a transaction completed after the market close on or about that date."
)
HEADED = "X -- Rock Inc. (NYSE: RCK ) will replace Gene Corp. (NASD: GENE) in\n the S& P 500 index after the close of trading on Friday, April 1, 2011 . Buyer (NYSE: BUY) is acquiring Gene. Following is a summary: S&P 500 INDEX – April {} COMPANY ADDED Rock DELETED Gene"
CASES = [
    ("lead", date(2010, 12, 22), LEAD, [("AMH", "BTA", "AFTER_CLOSE", date(2011, 1, 3), None, "SPINOFF", False, None)]),
    ("head", date(2011, 3, 29), HEADED.format("1, 2011"), [("RCK", "GENE", "AFTER_CLOSE", date(2011, 4, 1), date(2011, 4, 1), "MERGER_OR_ACQUISITION", False, None)]),
    ("differs", date(2011, 3, 29), HEADED.format("4, 2011"), [("RCK", "GENE", "AFTER_CLOSE", date(2011, 4, 1), date(2011, 4, 4), "MERGER_OR_ACQUISITION", True, None)]),
    ("tba", date(2011, 1, 26), "A plc (NYSE: AAA) will replace M Inc. (NYSE: MMM) in the S&P 500 index after the close of trading on a date to be announced. S&P 500 INDEX – TBA", [("AAA", "MMM", "TBA", None, None, "UNSPECIFIED", False, None)]),
    ("no year", date(2012, 7, 26), "E plc (NYSE: ESV) will replace G Corp. (NYSE: GR) in the S&P 500 index after the close of trading on Monday, July 30 . G filed for Chapter 11", [("ESV", "GR", "AFTER_CLOSE", date(2012, 7, 30), None, "BANKRUPTCY", False, None)]),
    ("next year", date(2012, 12, 27), "E plc (NYSE: ESV) will replace G Corp. (NYSE: GR) in the S&P 500 prior to the open of trading on Wednesday, Jan. 2.", [("ESV", "GR", "BEFORE_OPEN", date(2013, 1, 2), None, "UNSPECIFIED", False, None)]),
    ("wrong weekday", date(2012, 7, 26), "E plc (NYSE: ESV) will replace G Corp. (NYSE: GR) in the S&P 500 index after the close of trading on Tuesday, July 30, 2012.", [("ESV", "GR", "UNKNOWN", None, None, "UNSPECIFIED", False, None)]),
    ("shared and own", date(2015, 3, 2), "A Inc. (NYSE: A) will replace B Inc. (NYSE: B) in the S&P 500, and C Co. (NASD: C) will replace D of the North (NYSE: D.B) in the S&P 500 effective March 9, 2015. E (NYSE: E) will replace F (NYSE: F) in the S&P 500 before the opening of trading on March 11, 2015.",
     [("A", "B", "EFFECTIVE_ON_DATE", date(2015, 3, 9), None, "UNSPECIFIED", False, None), ("C", "D.B", "EFFECTIVE_ON_DATE", date(2015, 3, 9), None, "UNSPECIFIED", False, None), ("E", "F", "BEFORE_OPEN", date(2015, 3, 11), None, "UNSPECIFIED", False, None)]),
    ("name only", date(2015, 3, 2), "Joy Global Inc. (NYSE: JOY) is ranked near the bottom. Risk Analytics (NASD: RSK) will replace Joy Global in the S&P 500 effective on March 9, 2015.", [("RSK", "JOY", "EFFECTIVE_ON_DATE", date(2015, 3, 9), None, "UNSPECIFIED", False, None)]),
    ("name unknown", date(2015, 3, 2), "Risk Analytics (NASD: RSK) will replace Joy Global in the S&P 500 effective on March 9, 2015.", [("RSK", None, "EFFECTIVE_ON_DATE", date(2015, 3, 9), None, "UNSPECIFIED", False, "REMOVED_WITHOUT_SYMBOL")]),
    ("who unknown", date(2015, 3, 2), "Beta will replace Joy Global (NYSE: JOY) in the S&P 500 effective on March 9, 2015.", [(None, "JOY", "EFFECTIVE_ON_DATE", date(2015, 3, 9), None, "UNSPECIFIED", False, "ADDED_WITHOUT_SYMBOL")]),
    ("alone", date(2015, 3, 2), "Spun Co. (NYSE: SPN) will be added to the S&P 500 effective March 9, 2015. Old Co. (NYSE: OLD) will be removed from the S&P 500 after the close of trading on March 10, 2015.",
     [("SPN", None, "EFFECTIVE_ON_DATE", date(2015, 3, 9), None, "UNSPECIFIED", False, None), (None, "OLD", "AFTER_CLOSE", date(2015, 3, 10), None, "UNSPECIFIED", False, None)]),
    ("sector", date(2015, 3, 2), "A Inc. (NYSE: A) will replace B Inc. (NYSE: B) in the S&P 500 GICS sector effective March 9, 2015.", []),
    ("none", date(2015, 3, 2), None, []), ("empty", date(2015, 3, 2), "", []), ("prose", date(2015, 3, 2), "Nothing happens in the S&P 500 today. " * 3000, []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(n, d, t, "clash") for n, d, t, _ in CASES], "id string, announced date, body string, timing string")
    out = {}
    for r in A.changes(rows, ["id"], "body", "announced").orderBy("id", "place").collect():
        out.setdefault(r.id, []).append(r)
    return out


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_clauses(found, case):
    got = [(r.added, r.removed, r.timing, r.stated_day, r.header_day, r.reason, r.header_differs, r.problem) for r in found.get(case[0], [])]
    assert got == case[3]


def test_names(spark, found):
    assert (found["lead"][0].added_name, found["lead"][0].removed_name) == ("Alpha Mobility Holdings Inc.", "Beta Corp.")
    assert found["shared and own"][1].removed_name == "D of the North"
    text = "West Energy Inc. (NYSE: WR), to be renamed Evergreen, will replace Dr Pepper Group (NYSE: DPS) in the S&P 500 effective June 5, 2018."
    (r,) = A.changes(spark.createDataFrame([(1, date(2018, 6, 1), text)], "id int, d date, t string"), ["id"], "t", "d").collect()
    assert (r.added, r.added_name, r.renamed_to, r.removed) == ("WR", "West Energy Inc.", "Evergreen", "DPS")
