"""Events of a user at one moment: the price of a bar is that of the first one in the table, as in the SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

NAME = "r02_r03_daily_close_returns"


@pytest.fixture
def folder(tmp_path):
    # 40 copies of each event with other ids and prices; some of the first copy and all of some moments have no price
    rows = """SELECT 1000 * k + i AS event_id, TIMESTAMP '2024-01-01 09:30:00' + to_hours((5 * i)::INT) AS ts, i % 7 AS user_id, 'view' AS event_type,
        CASE WHEN i % 11 = 3 OR (k = 0 AND i % 5 = 1) THEN NULL ELSE 10 + (i * 37) % 101 + k END AS value, '' AS props
        FROM range(300) a(i), range(40) b(k) ORDER BY (k * 7 + 3) % 40, i"""
    duckdb.sql(rows.replace("10 +", "10.0 +")).write_parquet(str(tmp_path / "events.parquet"))
    return tmp_path


def test_tied_events_equal_sql(spark, folder):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.execute(f"SELECT symbol, asset_type, date, ret FROM ({entry.oracle_sql()[NAME]})").fetchall()
    got = [(r.symbol, r.asset_type, r.date, r.ret) for r in entry.queries()[NAME](spark, str(folder)).collect()]
    assert len(want) > 200 and sorted(got) == sorted(want)


def test_bars_of_a_user_are_dealt_once(spark):
    plan = entry.queries()[NAME](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(user_id" in plan
