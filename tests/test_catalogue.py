"""Every named query against its SQL, on two sizes of the test tables."""

from __future__ import annotations

import datetime
import glob
import os
from collections import Counter

import duckdb
import pytest

from quarry.plans.catalogue import oracle_sql, queries


def plain(x):
    if isinstance(x, float):
        return round(x, 9) + 0.0
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_is_its_sql(spark, name, size):
    place = f"/root/testdata/{size}"
    con = duckdb.connect()
    for p in glob.glob(f"{place}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries()[name](spark, place)
    cur = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    expected = Counter(tuple(map(plain, r)) for r in cur.fetchall())
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got == expected


def test_queries_without_sql_run(spark, sf):
    for name in set(queries()) - set(oracle_sql()):
        assert queries()[name](spark, sf).count() > 0
