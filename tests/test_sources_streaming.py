import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import append, parsers
from tidemark.streaming import known

T = dt.datetime


def test_append_is_idempotent(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    append.append_missing(spark, rows, folder, ["k"])
    append.append_missing(spark, rows.unionByName(spark.createDataFrame([(3, "c")], rows.schema)), folder, ["k"])
    assert sorted(map(tuple, spark.read.parquet(folder).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_archive_names_content_by_its_hash(spark, tmp_path):
    for name, data in (("x", b"same"), ("y", b"same"), ("z", b"other")):
        (tmp_path / name).write_bytes(data)
    kept = append.archive(spark.read.format("binaryFile").load(str(tmp_path)))
    assert kept.count() == 2 and append.verify_archive(kept).count() == 0
    assert append.verify_archive(kept.withColumn("content", F.lit(b"changed"))).count() == 2


def test_filings_and_facts(spark):
    doc = '{"cik":"7","filings":{"recent":{"accessionNumber":["a-1","a-2"],"form":["10-K","8-K"],"filingDate":["2020-02-01","2020-03-01"],"reportDate":["2019-12-31",""],"acceptanceDateTime":["2020-02-01T10:00:00.000Z",null]}}}'
    facts = '{"cik":"7","facts":{"us-gaap":{"Revenues":{"units":{"USD":[{"start":"2019-01-01","end":"2019-12-31","val":5.5,"accn":"a-1","form":"10-K","filed":"2020-02-01"},{"end":"2019-12-31","val":1}]}}}}}'
    df = spark.createDataFrame([(doc, facts)], "d string, f string")
    got = sorted(parsers.filings(df, "d").collect())
    assert [(r.cik, r.accession, r.form, r.period) for r in got] == [("7", "a-1", "10-K", dt.date(2019, 12, 31)), ("7", "a-2", "8-K", None)]
    rows = sorted(parsers.company_facts(df, "f").collect(), key=lambda r: r.value)
    assert [(r.concept, r.unit, r.value, r.period_start) for r in rows] == [("Revenues", "USD", 1.0, None), ("Revenues", "USD", 5.5, dt.date(2019, 1, 1))]
    assert parsers.filings(df.limit(0), "d").count() == 0


def test_acceptance_time_of_the_repeated_hour(spark):
    df = spark.createDataFrame([("<ACCEPTANCE-DATETIME>20211107013000",), ("<ACCEPTANCE-DATETIME>20210701120000",), ("none",)], "h string")
    got = [r[0] for r in df.select(F.date_format(parsers.acceptance_time(F.col("h")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2021-11-07 06:30", "2021-07-01 16:00", None]


def test_instance_without_dimensions(spark):
    xml = '<context id="c1"><period><startDate>2020-01-01</startDate><endDate>2020-12-31</endDate></period></context><context id="c2"><segment><explicitMember>x</explicitMember></segment><period><instant>2020-12-31</instant></period></context><a:Rev contextRef="c1" unitRef="u" decimals="0">12.5</a:Rev><a:Rev contextRef="c2" unitRef="u">3</a:Rev>'
    got = parsers.instance_facts(spark.createDataFrame([(xml,)], "x string"), "x").collect()
    assert [(r.concept, r.value, r.period_end) for r in got] == [("a:Rev", 12.5, dt.date(2020, 12, 31))]


def test_lists_and_tables(spark, tmp_path):
    lines = spark.createDataFrame([("037833 10 0 APPLE COMPANY          ADDED",), ("not a line",)], "l string")
    assert [tuple(r) for r in parsers.holdings_list(lines, "l").collect()] == [("037833100", "APPLE COMPANY", "ADDED")]
    assert parsers.fixed_width(spark.createDataFrame([("AB  2020",)], "l string"), "l", {"a": (1, 4), "b": (5, 4), "c": (9, 2)}).first()[:] == ("AB", "2020", None)
    html = spark.createDataFrame([("<table><tr><th>Name</th><td><b>Acme</b> SA</td></tr></table>",)], "h string")
    assert html.select(parsers.html_pairs(F.col("h")).alias("p")).first().p[0][:] == ("Name", "Acme SA")
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    assert parsers.delimited(spark, str(tmp_path / "t.csv"), "a int, b int").first()[:] == (1, 2)
    with pytest.raises(Exception):
        parsers.delimited(spark, str(tmp_path / "t.csv"), "a int, x int").collect()


def test_known_data_takes_the_last_version_in_time(spark):
    rows = [("m", T(2024, 1, 1), T(2024, 1, 1, 0, 5), 1, 1.0), ("m", T(2024, 1, 1), T(2024, 1, 1, 0, 14), 2, 2.0), ("m", T(2024, 1, 1), T(2024, 1, 1, 0, 16), 3, 3.0), ("m", T(2024, 1, 2), T(2024, 1, 2), 1, 9.0)]
    df = spark.createDataFrame(rows, "k string, t timestamp, av timestamp, v int, x double")
    assert [r.x for r in known.known_data(df, ["k"], "t", "av", "v", F.lit("2024-01-01").cast("timestamp")).collect()] == [2.0]


def test_streams_close_days_and_freeze_first(spark, tmp_path):
    src = tmp_path / "in"
    schema = "k string, t timestamp, av timestamp, x double"
    first = [("a", T(2024, 1, 1, 1), T(2024, 1, 1, 1), 1.0), ("a", T(2024, 1, 1, 2), T(2024, 1, 1, 3), 2.0), ("b", T(2024, 1, 1, 5), T(2024, 1, 1, 5), 5.0)]
    second = [("a", T(2024, 1, 1, 3), T(2024, 1, 1, 2), 7.0), ("a", T(2024, 1, 3), T(2024, 1, 3), 3.0), ("c", T(2024, 1, 4), T(2024, 1, 4), 0.0)]
    out = str(tmp_path / "out")

    def drain(check):
        stream = known.latest_stream(spark.readStream.schema(schema).parquet(str(src)), ["k"], "t", "av", "x").select("k", "day.start", "value", "versions")
        q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).foreachBatch(lambda df, _: known.append_new(df, out, ["k", "start"])).start()
        q.awaitTermination(120)

    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(src))
    drain("c")
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(str(src))
    drain("c")
    drain("c")
    got = sorted(map(tuple, spark.read.parquet(out).select("k", F.to_date("start").cast("string"), "value", "versions").collect()))
    assert got[:2] == [("a", "2024-01-01", 2.0, 3), ("b", "2024-01-01", 5.0, 1)]


def test_reveal_waits_for_the_exact_bar(spark):
    f = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9)], "k string, target int")
    b = spark.createDataFrame([("a", 1, 5.0), ("a", 9, 7.0)], "k string, t int, x double")
    got = {r.target: (r.state, r.outcome) for r in known.reveal(f, b, ["k"], "target", "t", "x", F.lit(5)).collect()}
    assert got == {1: ("REVEALED", 5.0), 2: ("AWAITING_BAR", None), 9: ("PENDING", None)}
