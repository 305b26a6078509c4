"""Tiles are written once and read by the tasks that pair them: returns do not travel once for each tile."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from tests.test_snapshot_tiles import D, S, side
from tidepanel.functions import tiles
from tidepanel.operators import risk, snapshots


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(tiles, "LEAST", 2)
    monkeypatch.setattr(tiles, "TILES", 2)
    monkeypatch.setattr(tiles, "TOGETHER", 2)
    # a tile over 9 grid points has two symbols at most: more tiles than parts
    monkeypatch.setattr(tiles, "CELLS", 18)


@pytest.fixture
def panel(spark, small):
    x = np.random.default_rng(7).normal(0, 1, (11, 9))
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(t), float(x[i, t])) for i in range(11) for t in range(9)]
    return spark.createDataFrame(rows, "symbol long, ts date, ret double"), x


def test_each_return_is_written_once(panel):
    df, x = panel
    made = tiles.on_grid(df)
    assert made.rdd.getNumPartitions() == 3
    rows = [pa.ipc.open_stream(r.data).read_all() for r in made.collect()]
    assert sorted(k for r in rows for k in r.column("symbol").to_pylist()) == list(range(11)) and len(rows) == 6
    assert sum(len(c) for r in rows for c in r.column("cells").to_pylist()) == x.size


def test_no_tile_goes_through_a_shuffle(panel):
    df, x = panel
    for out in (risk.pair_covariance(df), tiles.rolling_pairs(df, 4)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
    want = np.cov(x)
    got = {(r.sym_i, r.sym_j): r.cov for r in risk.conditioned_covariance(df).collect()}
    assert set(got) == {(i, j) for i in range(11) for j in range(i, 11)}
    assert all(abs(v - want[k]) < 1e-12 for k, v in got.items() if k[0] != k[1])
    got = risk.panel_bounds(df).first()
    r = np.abs(want).sum(1) - np.diag(want)
    assert abs(got.lower - (np.diag(want) - r).min()) < 1e-12 and abs(got.upper - (np.diag(want) + r).max()) < 1e-12


def test_sums_of_a_task_leave_once_and_add_up():
    rng = np.random.default_rng(3)
    all_sides = [side(rng.normal(0, 1, (4, D)) * (rng.random((4, D)) < 0.4), k == 3, k) for k in range(4)]
    pairs = lambda: [snapshots._Pair(a, b, a is b) for a in all_sides for b in all_sides if a.tile <= b.tile]

    def total(batches):
        sums, seen, count = np.zeros((4, 4, S)), np.zeros((4, 4, S), bool), 0
        for batch in batches:
            count += batch.num_rows
            for r in batch.to_pylist():
                seen[r["tile"], r["pos"]] |= ~np.isnan(r["r"])
                sums[r["tile"], r["pos"]] += np.nan_to_num(r["r"]) + (np.nan_to_num(r["d"]) if r["d"] else 0)
        return sums, seen, count

    want = total(b for p in pairs() for b in snapshots._row_sums(p))
    got = total(snapshots._row_sums_of(iter(pairs())))
    assert np.allclose(got[0], want[0], rtol=1e-12, atol=1e-12) and (got[1] == want[1]).all()
    assert want[2] == 64 and got[2] == 4 * (4 + 3)


def test_many_small_tiles_give_the_same_bounds(spark, small):
    run = lambda: sorted(map(tuple, entry.queries()["r17_r18_many_snapshots"](spark, "/root/testdata/sf0.001").collect()))
    many = run()
    assert len(many) > 100
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tiles, "LEAST", 32)
        m.setattr(tiles, "CELLS", 1 << 23)
        assert run() == many
