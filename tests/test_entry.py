"""The driver's contract: every registered query runs, and equals its SQL twin."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries without SQL, and the test that holds each against a plain version over the whole table.
PLAIN = {
    "ca_collapse": "def test_ca_collapse", "match_discovery": "def test_match_discovery_against_a_loop",
    **dict.fromkeys(("state_machine_log", "state_machine_replay", "trade_milestones", "plan_counterfactual", "trade_metrics"), "def test_state_machine_queries_against_the_loop"),
    **dict.fromkeys(("segment_status", "anchor_members"), "def test_segment_queries_against_the_loop"),
    "identity_segments": "def test_identity_query_against_the_loop",
    "fold_predictions": "def test_fold_predictions_against_a_plain_solver",
    "series_digest": "def test_series_digest_against_a_loop",
}


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}" if float(v) else "0"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name not in plans.ORACLE_SQL:
        assert PLAIN[name] in "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py"))
        return
    result = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert got == want


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("gone", ["tidemark.llm", "corpus_pipeline", "xxhash", "public_tokenizers"])
def test_registry_without_the_optional_subpackage(gone):
    """With the subpackage, the pipeline or a library of theirs missing, the rest still registers."""
    code = f"""import sys
class Gone:
    def find_spec(self, name, *a):
        if name == {gone!r} or name.startswith({gone!r} + "."):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from tidemark import plans
assert set(plans.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
assert ("pipeline" in e.queries()) == False
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent, timeout=120)
