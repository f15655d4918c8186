import os

import duckdb
import pytest

from trellium.plans import catalog


def _norm(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            p = f"{sf}/{f}"
            c.execute(f"create view {f[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    got = sorted(tuple(_norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    r = duck.execute(catalog.sql()[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted(tuple(_norm(x[cols.index(c)]) for c in sorted(cols)) for x in r.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
