"""Values name the rows they were made of; those alone make them again, or their loss is told."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import provenance as P

BACK = {"sum3": 2, "level": 0, "change2": 2}


def rule(df, keys):
    w = Window.partitionBy(*keys).orderBy("day")
    x = F.col("x")
    three = F.when(F.count(x).over(w.rowsBetween(-2, 0)) == 3, F.sum(x).over(w.rowsBetween(-2, 0)))
    before = F.lag(x, 2).over(w)
    cols = df.select(*keys, "day", three.alias("sum3"), x.alias("level"), (x - before).alias("change2"))
    each = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("value"), F.when(F.col(k).isNull(), "missing").alias("reason")) for k in BACK])
    return cols.select(*keys, "day", F.explode(each).alias("f")).select(*keys, "day", "f.*")


@pytest.fixture(scope="module")
def world():
    rng = random.Random(8)
    return [(k, d, None if rng.random() < 0.1 else float(rng.randrange(50)), "clash") for k in "abc" for d in sorted(rng.sample(range(40), 12))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, day int, x double, feature_name string")


def test_inputs_and_values_made_again(spark, world):
    facts = P.named(frame(spark, world)).cache()
    names = {(r.key, r.day): r.source_id for r in facts.collect()}
    assert len(set(names.values())) == len(world)
    values = P.explained(facts, ["key"], "day", rule, BACK)
    for r in values.collect():
        days = [d for k, d, *_ in world if k == r.key and d <= r.day][-(BACK[r.feature] + 1):]
        assert r.inputs == [names[r.key, d] for d in days]
    again = P.rebuilt(values, facts, ["key"], "day", rule, BACK).collect()
    assert len(again) == 3 * len(world) and {r.status for r in again} == {"SAME"} and {r.missing for r in again} == {0}


def test_changed_and_lost_rows_are_told(spark, world):
    """A stored row that was changed, and one taken away, spoil the values that name them, and no other; rows stored twice do no harm."""
    facts = P.named(frame(spark, world))
    values = P.explained(facts, ["key"], "day", rule, BACK).cache()
    bad = {("a", sorted(d for k, d, *_ in world if k == "a")[5]), ("b", sorted(d for k, d, *_ in world if k == "b")[0])}
    changed = [(k, d, -1.0, s) if (k, d) in bad and k == "a" else (k, d, x, s) for k, d, x, s in world if not ((k, d) in bad and k == "b")]
    store = P.named(frame(spark, changed + changed[:3]))
    got = P.rebuilt(values, store, ["key"], "day", rule, BACK).collect()
    assert len(got) == 3 * len(world)
    for r in got:
        days = [d for k, d, *_ in world if k == r.key and d <= r.day][-(BACK[r.feature] + 1):]
        hit = sum((r.key, d) in bad for d in days)
        assert (r.status, r.missing) == (("INPUT_MISSING", hit) if hit else ("SAME", 0))


def test_a_false_value_differs(spark, world):
    facts = P.named(frame(spark, world))
    values = P.explained(facts, ["key"], "day", rule, BACK)
    forged = values.withColumn("value", F.when((F.col("key") == "c") & (F.col("feature") == "level"), F.coalesce("value", F.lit(0.0)) + 1).otherwise(F.col("value")))
    got = {(r.key, r.feature, r.status) for r in P.rebuilt(forged, facts, ["key"], "day", rule, BACK).collect()}
    assert got == {(k, f, "DIFFERENT" if (k, f) == ("c", "level") else "SAME") for k in "abc" for f in BACK}


def test_names_and_chain(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), ("a", "null"), (None, "a"), ("a", "'x"), ("a", None)], "p string, q string")
    assert [r.n for r in P.named(rows).groupBy("source_id").agg(F.count("*").alias("n")).orderBy("n").collect()] == [1, 1, 1, 1, 2]
    assert P.named(rows.select("q", "p")).select("source_id").subtract(P.named(rows).select("source_id")).isEmpty()
    facts = P.named(frame(spark, [("k", 1, 2.0, ""), ("k", 2, 3.0, "")]))
    values = P.explained(facts, ["key"], "day", rule, BACK)
    links = facts.filter("day = 1").select("source_id", F.lit("file-1").alias("file"))
    found = P.chain(links, values.filter("feature = 'sum3' and day = 2")).orderBy("position").collect()
    assert [(r.position, r.file) for r in found] == [(0, "file-1"), (1, None)]
    empty = P.explained(facts.limit(0), ["key"], "day", rule, BACK)
    assert P.rebuilt(empty, facts, ["key"], "day", rule, BACK).count() == 0
