"""Registered queries against their DuckDB twins, on the smallest tables."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_queries_match_their_sql(spark):
    import __spark_entry__
    import duckdb
    from codonlake.plans import catalog

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.queries()) <= set(queries)
    text = lambda v: None if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    for name in catalog.oracle_sql():
        got, want = queries[name](spark, FOLDER), con.execute(sql[name])
        names = sorted(got.columns)
        order = [[d[0] for d in want.description].index(c) for c in names]
        a = sorted((tuple(text(r[c]) for c in names) for r in got.collect()), key=str)
        b = sorted((tuple(text(r[k]) for k in order) for r in want.fetchall()), key=str)
        assert a == b, name
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_is_imported_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); import codonlake.__main__"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
