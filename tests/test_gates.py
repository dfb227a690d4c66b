"""Gates and lookups on stated cases."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import cohorts, continuous, gates

D = dt.date


def test_exact_predictions_and_empty_tables(spark):
    p = spark.createDataFrame([("a", D(2024, 1, 5), D(2024, 1, 6), 1), ("a", D(2024, 1, 5), D(2024, 1, 9), 2), ("a", D(2024, 1, 8), D(2024, 2, 1), 3)], "k string, decided date, generated_at date, prediction_id int")
    asked = spark.createDataFrame([("a", D(2024, 1, 5)), ("a", D(2024, 1, 7)), ("a", D(2024, 1, 20)), ("b", D(2024, 1, 20))], "k string, t date")
    got = {(r.k, r.t.day): r.prediction_id for r in gates.prediction_at(asked, p, ["k"], "t").collect()}
    assert got == {("a", 5): None, ("a", 7): 1, ("a", 20): 2, ("b", 20): None}
    same = p.withColumn("generated_at", F.col("decided"))
    assert {(r.k, r.t.day): r.prediction_id for r in gates.prediction_at(asked, same, ["k"], "t", exact=True).collect()} == {("a", 5): 2, ("a", 7): None, ("a", 20): None, ("b", 20): None}
    assert gates.prediction_at(asked.limit(0), p, ["k"], "t").count() == 0


def test_usable_statuses_and_gates(spark):
    df = spark.createDataFrame([("VALIDATED", True), ("VALIDATED", False), ("SYNTHETIC_FIXTURE", True), (None, True)], "s string, a boolean")
    assert [r[0] for r in df.select(gates.usable_prediction(F.col("s"), F.col("a"))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(gates.usable_prediction(F.col("s"), F.col("a"), True)).collect()] == [True, False, True, False]
    g = spark.createDataFrame([("A", "READY"), ("B", "NOT_APPLICABLE")], "gate string, status string")
    assert tuple(gates.all_ready(g, ["A", "B", "C"]).first()) == (False, "B,C") and gates.all_ready(g, ["A"]).first().ready
    assert tuple(gates.all_ready(g.limit(0), ["A"]).first()) == (False, "A")


def test_ingestion_gaps(spark):
    spans = spark.createDataFrame([(k, D(2024, 1, 1), D(2024, 1, 31)) for k in "abcde"], "k string, start date, end date")
    rows = [("a", 1, 10), ("a", 11, 31), ("b", 1, 10), ("b", 12, 31), ("c", 5, 31)]
    traces = [(k, "p", True, "COMPLETED", D(2024, 1, x), D(2024, 1, y)) for k, x, y in rows] + [("d", "p", True, "FAILED", D(2024, 1, 1), D(2024, 1, 31)), ("e", "q", False, "COMPLETED", D(2024, 1, 1), D(2024, 1, 31))]
    got = {r.k: (r.state, r.covered_to and r.covered_to.day) for r in cohorts.ingestion_state(spans, spark.createDataFrame(traces, "k string, provider string, accepted boolean, status string, period_start date, period_end date"), "k").collect()}
    assert got == {"a": ("VERIFIED_COVERAGE", 31), "b": ("PARTIAL_PERIOD", 10), "c": ("PARTIAL_PERIOD", None), "d": ("ATTEMPTED_FAILED", None), "e": ("NOT_ATTEMPTED", None)}


def test_states_of_price_and_interest(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.01, 2.5), (-0.1, 0.2, -0.01, -3.0), (None, 0.1, 0.1, None)], "p double, oi double, f double, z double")
    got = [tuple(r)[4:] for r in continuous.derivative_states(df, "p", "oi", "f", "z").collect()]
    assert got == [(1, 0, 0, 0, 1, 0), (0, 0, 1, 0, 0, 1), (None, None, None, None, None, None)]
