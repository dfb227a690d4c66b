"""Steps whose cost must not grow with a group: no task sorts a group, nulls are not dealt to one task, common words make no pairs."""

import random
from datetime import date

from pyspark.sql import functions as F

from tests.test_prefix import most_rows
from tidemark.operators import cross_section, identity, models, segments, splits, stats


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_metrics_sort_no_group(spark):
    df = spark.range(400).selectExpr("if(id % 3 = 0, null, 'a') g", "id % 7 y", "cast(id % 5 as double) p")
    got = stats.regression_metrics(df, ["g"], "y", "p")
    assert "Window" not in plan(got)
    rows = {r.g: r for r in got.collect()}
    assert rows.keys() == {None, "a"} and rows[None].n == 134 and all(abs(r.spearman) < 0.2 for r in rows.values())


def test_rank_correlations_sort_no_cohort(spark):
    df = spark.range(60).selectExpr("id % 2 m", "id x", "-id y")
    got = cross_section.rank_correlation(df, ["m"], "x", "y")
    assert "Window" not in plan(got) and [(r.n, round(r.ic, 9)) for r in got.collect()] == [(30, -1.0)] * 2


def test_rows_do_not_move_to_their_folds_fit(spark):
    rows = spark.range(300).selectExpr("id % 2 fold", "id", "if(id % 3 = 0, 'TEST', 'TRAIN') role", "cast(id % 11 as double) x", "cast(id % 13 as double) y", "cast(id % 4 = 0 as int) up")
    fit = splits.train_only_fit(rows, ["fold"], ["x"])
    assert "strategy=broadcast" in plan(splits.standardise(rows, fit, ["fold"], ["x"]))
    assert plan(models.walk_forward(rows, ["fold"], ["x"], "y", "up")).count("strategy=broadcast") == 2


def test_nulls_get_keys_of_their_own(spark):
    """Forty spans without a decided identifier: their runs' keys differ where they join."""
    day = date(2000, 1, 1)
    spans = spark.createDataFrame([(i, day, None) for i in range(40)], "span int, start date, stop date")
    points = spark.createDataFrame([(i, date(2000, 2, 1), None, False, False, ["A", "B"]) for i in range(40)], "span int, day date, isin string, sure boolean, exact boolean, candidates array<string>")
    none = lambda s: spark.createDataFrame([], s)
    got = identity.identity_segments(spans, points, none("old string, new string, day date, continuity string"), none("isin string, issuer string, issued date"), F.lit("2000-12-31").cast("date"))
    assert {r.status for r in got.collect()} == {"PROVISIONAL"} and got.count() == 80  # up to the point and after it
    assert len({r.k for r in identity.own_keys(spark.createDataFrame([(i, 1, None) for i in range(40)], "span int, run int, isin string"), {"k": "isin"}).collect()}) == 40


def test_legs_find_their_segment_without_a_sort_of_the_pool(spark):
    ends = spark.createDataFrame([("p", date(2000, 1, 1), date(2000, 6, 30), date(2000, 1, 2)), ("p", date(2000, 6, 30), date(2000, 12, 31), date(2000, 7, 3))], "pool string, a date, b date, opens date")
    legs = spark.createDataFrame([(i, "p", lo, said) for i, (lo, said) in enumerate([(date(2000, 6, 30), None), (date(2000, 7, 1), None), (None, date(2000, 7, 1)), (date(2001, 1, 1), None), (None, None)])], "leg int, pool string, lo date, said date")
    got = segments.in_segments(legs, ends)
    assert "Window" not in plan(got)
    assert sorted((r.leg, r.b) for r in got.collect()) == [(0, date(2000, 6, 30)), (2, date(2000, 12, 31))]


def test_names_are_linked_as_by_all_pairs(spark):
    """Of names with one very common word, those that share half of all their words, and are alike in size, are linked."""
    rng, rows = random.Random(3), []
    for i in range(160):
        words = {"common", *rng.sample("abcdefghij", rng.randrange(0, 4))}
        gone = i % 2 == 0
        rows.append(("p", 1, 2, f"s{i:03}", " ".join(sorted(words)), "MISSING_REMOVAL" if gone else "MISSING_ADDITION", float(rng.randrange(0, 5)) if gone else None, None if gone else float(rng.randrange(0, 5))))
    got = {r.security: r.linked_with for r in segments._linked(spark.createDataFrame(rows, "pool string, a int, b int, security string, name string, difference string, shares_a double, shares_b double")).collect()}
    want = {}
    for g in rows[::2]:
        for c in rows[1::2]:
            x, y = set(g[4].split()), set(c[4].split())
            if len(x & y) * 2 >= len(x | y) and g[6] > 0 and 0.5 <= c[7] / g[6] <= 2:
                want[g[3]], want[c[3]] = min(want.get(g[3], c[3]), c[3]), min(want.get(c[3], g[3]), g[3])
    assert got == {r[3]: want.get(r[3]) for r in rows} and len(want) > 60
