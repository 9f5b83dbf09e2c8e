"""Queries against their SQL on tables that the standard ones do not show: larger keys, limits, halves."""

import datetime
import random

import pytest

from siftlake.operators.ranks import at_percents
from siftlake.plans import registry


def both(spark, folder, name):
    """Rows of a query and of its SQL over the tables in folder, sorted."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in folder.iterdir():
        con.execute(f"CREATE VIEW {f.name[:-8]} AS SELECT * FROM read_parquet('{f}/*.parquet')")
    df = registry.QUERIES[name](spark, str(folder))
    cursor = con.execute(registry.ORACLE_SQL[name])
    assert [d[0] for d in cursor.description] == df.columns
    return sorted(map(tuple, df.collect())), sorted(cursor.fetchall())


def write_events(spark, folder, users):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at, u, "view", 1.5, '{"k": 3}') for i, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")


def test_addresses_of_users_beyond_255(spark, tmp_path):
    write_events(spark, tmp_path, [0, 7, 255, 256, 1499, 10**7])
    got, want = both(spark, tmp_path, "fn_ipv4_expression")
    assert got == want and len(got) == 6 and all(ip is not None for _, ip in got)


def test_process_tree_beyond_the_limit_of_recursion(spark, tmp_path):
    ids = [*range(700), 5, 21, None, 5_000, -4]  # repeated ids are as many rows as paths lead to them; 700 up are missing
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        got, want = both(spark, tmp_path, "sql_process_tree")
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
    assert got == want and len(got) > 400


def test_process_tree_without_a_root(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (0, 4, 5)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert both(spark, tmp_path, "sql_process_tree") == ([], [])


def test_percentiles_hold_no_values_and_round_halves_to_even(spark, tmp_path):
    prices = [0.005, 0.015, 0.025, None, -3.25, 12.34, 12.34, 10.0**12, -(10.0**12)] * 3
    spark.createDataFrame([(i, p) for i, p in enumerate(prices)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got, want = both(spark, tmp_path, "percentiles")
    assert got == want
    plan = registry.QUERIES["percentiles"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan  # a buffer of every different value


def test_ranks_against_sorted_lists(spark):
    dealt = random.Random(5)
    wide = [dealt.randrange(-(2**63), 2**63) for _ in range(150)] + [-(2**63), 2**63 - 1, 0, -1]
    for values in (wide, [7], [3] * 40 + [5] * 60, list(range(-60, 240)), [dealt.randrange(9) - 4 for _ in range(100)]):
        got = at_percents(spark.createDataFrame([(v,) for v in [*values, None]], "x long"), [1, 50, 95, 99, 100]).first()
        want = [sorted(values)[-(-len(values) * p // 100) - 1] for p in (1, 50, 95, 99, 100)]
        assert list(got) == want
    assert list(at_percents(spark.createDataFrame([(None,)], "x long"), [50, 99]).collect()[0]) == [None, None]
