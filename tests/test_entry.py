"""The driver's contract, and all queries with SQL against DuckDB."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(r):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in r), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    assert rows(df.select(columns).collect()) == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_unsorted_starts_of_events_that_share_a_position(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    events = [(i + 100003 * k, i % 3 if i % 10 else None, None if i % 7 == 3 else (i * 37 % 50 - 25) * 999_700 + k * (i % 2)) for i in range(60) for k in range(1 + i % 3)]
    spark.createDataFrame([*events, (None, 1, 5), (None, 1, 7)], "event_id long, user_id long, us long").selectExpr("event_id", "CAST(timestamp_micros(us) AS TIMESTAMP_NTZ) AS ts", "user_id", "'x' AS event_type", "1.5D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    name = "next_greater_start_unsorted"
    got = rows(entry.queries()[name](spark, str(tmp_path)).collect())
    assert got == rows(c.sql(entry.oracle_sql()[name]).fetchall()) and len(got) < len(events)
