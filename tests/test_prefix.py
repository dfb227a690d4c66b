"""prefix_join against a plain loop, and without a meeting of all pairs."""

from tidemark.operators import targets


def brute(left, right, least):
    out = []
    for i, name in left:
        e = [k for n, k in right if n == name and name is not None]
        b = {k for n, k in right if name is not None and n is not None and len(name) >= least and n.startswith(name)}
        how = "EXACT" if e else "PREFIX" if len(b) == 1 else "AMBIGUOUS" if b else "NONE"
        out.append((i, name, min(e) if e else min(b) if len(b) == 1 else None, how))
    return sorted(out, key=str)


def test_prefix_join_against_a_loop(spark):
    right = [("Customer#01", 1), ("Customer#02", 2), ("Customer#02", 3), ("Customer", 4), ("Short", 5), ("Sho", 6), ("Ñandú ñandú", 7), ("Ñandú ñandú", 7), (None, 8), ("", 9)]
    left = list(enumerate(["Customer#01", "Customer#0", "Customer#02", "Customer", "Custome", "Short", "Sho", "Sh", "Ñandú ña", "Ñandú ñ", "", None, "Nobody at all", "Customer#01"]))
    got = targets.prefix_join(spark.createDataFrame(left, "i int, name string"), spark.createDataFrame(right, "name string, k int"), "name", "k", 8)
    assert sorted(map(tuple, got.select("i", "name", "k", "match").collect()), key=str) == brute(left, right, 8)


def test_prefix_join_makes_no_pairs(spark):
    """400 names with the same first eight characters join to a row each."""
    names = spark.range(400).selectExpr("concat('Customer#', lpad(id, 9, '0')) name", "id k")
    got = targets.prefix_join(names.selectExpr("k i", "name"), names, "name", "k", 8)
    assert sorted((r.i, r.k, r.match) for r in got.collect()) == [(i, i, "EXACT") for i in range(400)]
    assert most_rows(got) < 400 * 20


def most_rows(df):
    """Most rows that a node of the executed plan made."""
    def walk(node):
        if hasattr(node, "toString") and node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        m = node.metrics().get("numOutputRows")
        kids = node.children()
        return max([m.get().value() if m.isDefined() else 0, *(walk(kids.apply(i)) for i in range(kids.size()))])
    return walk(df._jdf.queryExecution().executedPlan())
