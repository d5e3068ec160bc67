import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("p") or n.startswith("posting") or n.startswith("p2")))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    rel = c.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    tidy = lambda cols, rows: sorted(tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in (r[cols.index(k)] for k in order)) for r in rows)
    assert tidy(df.columns, [tuple(r) for r in df.collect()]) == tidy(rel.columns, rel.fetchall())
