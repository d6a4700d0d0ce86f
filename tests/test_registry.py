import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["scan_repository", "evidence_buckets", "resolve_dependencies", "validate_graph"])
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "part", "customer", "orders"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    df = entry.queries()[name](spark, SMALL)
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted(tuple(str(v) for v in r) for r in rel.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want


def test_retrieval_plan_has_no_cross_join(spark):
    df = entry.queries()["lexical_search"](spark, SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
