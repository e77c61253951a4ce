"""Every query against its SQL, at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

from pelagia.oracles import ORACLE_SQL
from pelagia.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "events", "lineitem", "orders")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables aren't here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in cur.fetchall()) == sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


def test_whole_grid_of_many_users(spark, tmp_path):
    """Users so many that the fixture's rows pass 90 degrees: a world box still has every cell of the day."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT k AS event_id, TIMESTAMP '2024-01-10 00:00:00' AS ts, 5000 * k AS user_id, 'view' AS event_type, k + 0.5::double AS value, '' AS props FROM range(12) t(k)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = QUERIES["bbox_clamped"](spark, str(tmp_path))
    cur = con.execute(ORACLE_SQL["bbox_clamped"])
    cols = [c[0] for c in cur.description]
    assert sorted(map(tuple, cur.fetchall())) == sorted(tuple(r[c] for c in cols) for r in df.collect())
