"""Queries against their SQL on rows that the small tables don't hold."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

MADE = {
    "column_letters": ("part", "select unnest([0, 25, 26, 701, 702, 18277, 18278, 475253, 475254, 1200000, 7000000])::bigint as p_partkey"),
    "date_histogram": ("events", "select unnest([timestamp '2024-01-14 23:59:59.7', '2024-01-14 23:59:59.5', '2024-01-14 23:59:58.5', '2024-01-01 00:00:00', '2023-12-31 23:59:59.9', null]) as ts"),
    "document_dates": (
        "orders",
        "select k::bigint as o_orderkey, d as o_orderdate from range(20) a(k), unnest([timestamp '1998-01-01 00:00:00', '1997-12-31 23:59:59', '1997-12-31 23:59:59.7', '1998-01-01 01:30:00', '1996-02-29 12:00:00.6', null]) b(d)",
    ),
}


@pytest.mark.parametrize("name", MADE)
def test_against_sql(spark, tmp_path, name):
    table, made = MADE[name]
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create table {table} as {made}")
    con.execute(f"copy {table} to '{tmp_path}/{table}.parquet' (format parquet)")
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(con.execute(entry.oracle_sql()[name]).fetchall())
