import os

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

#: Set TESSERA_FAST=1 to check a few queries only.
FAST = ["sql_regression", "verify_exact", "verify_include", "script_statements", "suite_rollup", "gen_except",
        "target_scan", "earliest_offsets", "match_line", "stream_eventually"]
OWN = [q for q in sorted(E.queries()) if q != "pipeline" and not q.startswith("op")]  # the others: tests/llm


def test_registry_is_complete():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 74


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "sql_text"


@pytest.mark.parametrize("name", FAST if os.environ.get("TESSERA_FAST") else OWN)
def test_query_matches_oracle(spark, name):
    import duckdb

    from tools.check_oracles import TABLES, rows_key
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    df = E.queries()[name](spark, SF_SMALL)
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(c.lower() for c in cols) == sorted(c.lower() for c in dcols)
    so = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    do = sorted(range(len(dcols)), key=lambda i: dcols[i].lower())
    assert rows_key([tuple(r[i] for i in so) for r in srows]) == \
        rows_key([tuple(r[i] for i in do) for r in res.fetchall()])


@pytest.mark.parametrize("name", ["suite_include_filter", "target_scan", "suite_rollup", "verify_exact"])
def test_plans_stay_linear(spark, name):
    """Reused intermediates are shared, so plans do not repeat upstream lineage."""
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 60
