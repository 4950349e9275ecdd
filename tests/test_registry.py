"""Registered queries against their SQL over the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from duetframe import registry

D = "/root/testdata/sf0.001"
SLOW = ("st0", "src", "snk", "rp0", "as0", "dq0")


def plain(v):
    if v is None or v != v:
        return ""
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ in ("Decimal",) else str(v)


@pytest.mark.parametrize("name", [n for n in registry.oracle_sql() if not n.startswith(SLOW)])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "events", "orders", "lineitem", "documents"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got = registry.queries()[name](spark, D)
    want = con.execute(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
