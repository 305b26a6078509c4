"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("PANEL_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _rows(rows):
    one = lambda x: repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(one, r)) for r in rows)


SLOW = ("ml0", "st0")
PANEL = sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline")))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", PANEL)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
    assert _rows(tuple(r[c] for c in cols) for r in df.collect()) == _rows(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith(("op", "pipeline"))))
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry_runs(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
