"""Queries against the SQL that says the same, run by another engine over the smallest tables."""

import datetime
import decimal
import os

import pytest

from siftlake.plans import registry, wider, wider_sql

SF = "/root/testdata/sf0.001"
NAMES = sorted({*wider.QUERIES, *wider_sql.PACK, "graph_paths", "zorder_pruning", "stream_ordered_sequences", "load_under_schedule", "logtable_history", "fingerprint_by_aggregates"})


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def cell(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, engine, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    cursor = engine.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(names) == columns and got == want


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
