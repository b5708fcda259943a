"""Every query with an SQL oracle gives the oracle's rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from serieslab.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    key = lambda v: (v is None, float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) if v is not None else 0)
    clean = lambda v: float(v) if v is not None and not isinstance(v, (str, bool)) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=lambda r: [key(v) for v in r])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    want = db.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(cols)
    a, b = rows(df.columns, got), rows(cols, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and p == pytest.approx(q, rel=1e-7, abs=1e-9) for p, q in zip(x, y, strict=True)), (x, y)


def test_entry(spark):
    assert entry.entry(spark).count() == 2
