"""Queries over whole tables leave no row out."""

from tidemark import plans

#: Large enough for order keys of 3000 and more.
SF = "/root/testdata/sf0.01"


def test_composition_difference_of_every_order(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber").collect()
    a, b = ({(r.l_orderkey, r.l_partkey) for r in lines if r.l_linenumber % k == 0} for k in (2, 3))
    got = plans.QUERIES["composition_difference"](spark, SF).collect()
    assert max(r.l_orderkey for r in got) >= 3000
    assert sorted((r.l_orderkey, r.l_partkey, r.side) for r in got) == sorted([(*x, "ONLY_A") for x in a - b] + [(*x, "ONLY_B") for x in b - a])


def test_every_order_and_customer_is_asked(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate").collect()
    stored = {r.l_orderkey for r in spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_linenumber = 1").select("l_orderkey").collect()}
    customers = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()
    got = {q: plans.QUERIES[q](spark, SF).collect() for q in ("session_shifts", "append_missing_rows", "resolve_names", "prefix_names")}
    assert sorted(r.d for r in got["session_shifts"]) == sorted({r.o_orderdate.date() for r in orders})
    assert sorted(map(tuple, got["append_missing_rows"])) == sorted((r.o_orderkey, r.o_custkey) for r in orders if r.o_orderkey not in stored)
    assert sorted(r.o_orderkey for r in got["resolve_names"]) == sorted(r.o_orderkey for r in orders)
    assert sorted(r.c_custkey for r in got["prefix_names"]) == sorted(r.c_custkey for r in customers)
