"""Scans, tiles, many snapshots, sorted sums and range covers against plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import tiles, wide
from tidepanel.functions.scan import affine_scan
from tidepanel.functions.windows import dates_indexed
from tidepanel.operators import evaluation, labels, risk, snapshots, technical
from tidepanel.sources import io

D = dt.date(2020, 1, 1)


@pytest.fixture
def split(spark):
    """Shuffles stay as wide as they are and small tables are not broadcast."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "6"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_scan_equals_the_recursion(split):
    rng = random.Random(1)
    rows = [(s, D + dt.timedelta(days=3 * k), rng.choice([0.0, 0.5, 0.99, -0.3, 1.0]), rng.uniform(-1, 1)) for s, n in ((1, 700), (2, 1), (3, 130), (None, 90)) for k in range(n)]
    df = split.createDataFrame(rows, "symbol long, date date, a double, b double")
    got = affine_scan(df, {"y": (F.col("a"), F.col("b")), "z": (F.lit(0.9), F.col("b"))}, {"y": F.col("b"), "z": F.lit(5.0)})
    mine = {(r.symbol, r.date): (r.y, r.z) for r in got.collect()}
    assert len(mine) == len(rows)
    for s in (1, 2, 3, None):
        own = [r for r in rows if r[0] == s]
        y, z = own[0][3], 5.0
        for _, date, a, b in own:
            y, z = a * y + b, 0.9 * z + b
            assert mine[s, date] == pytest.approx((y, z), abs=1e-9)
    # one history lies in several tasks
    assert got.where("symbol = 1").select(F.spark_partition_id()).distinct().count() > 1


def test_averages_have_no_python(spark):
    df = spark.createDataFrame([(1, D + dt.timedelta(days=k), 100.0 + k % 7) for k in range(40)], "symbol long, date date, close double")
    for out in (technical.ema(df, {"e": 5}), technical.ppo_macd(df), technical.rsi_wilder(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
    assert technical.ema(df, {"e": 5}).where(f"date = '{D}' and e = 100").count() == 1


@pytest.mark.parametrize("tile,span", [(3, 4), (128, 4096), (2, 100)])
def test_products_of_tiles(spark, tile, span):
    rng = random.Random(2)
    rows = [(f"s{s}", D + dt.timedelta(days=t), rng.uniform(-1, 1)) for s in range(7) for t in range(20) if rng.random() < 0.4 and (s, t // 10) != (6, 1)]
    x = spark.createDataFrame(rows, "symbol string, ts date, ret double")
    names = tiles.numbered(x, tile)
    place = {(r.tile, r.pos): r.symbol for r in names.collect()}
    got = {(place[r.left, r.i], place[r.right, r.j]): r.xy for r in tiles.gram(x, names, dates_indexed(x, "ts"), tile, span).collect() if (r.left, r.i) in place and (r.right, r.j) in place}
    value = {(s, t): r for s, t, r in rows}
    symbols, days = sorted({s for s, _, _ in rows}), sorted({t for _, t, _ in rows})
    assert len(got) == len(symbols) * (len(symbols) + 1) // 2
    for (i, j), xy in got.items():
        assert xy == pytest.approx(sum(value.get((i, t), 0) * value.get((j, t), 0) for t in days), abs=1e-12)


def test_a_wide_date_over_several_tasks(split):
    rng = random.Random(10)
    rows = [(d, k, rng.choice([None, 0.0, -0.0, 1e9, -3.5, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)])) for d, n in ((1, 500), (2, 1), (3, 4), (None, 50)) for k in range(n)]
    rows += [(4, 0, None), (5, 0, float("inf")), (5, 1, float("-inf")), (5, 2, 1.0), (5, 3, float("nan"))]
    df = split.createDataFrame(rows, "date int, symbol long, x double")
    got = wide.ranked(df, "x", pieces=16)
    mine = {(r.date, r.symbol): (r._rank, r._ties, r._n, r._all) for r in got.collect()}
    key = lambda v: (math.isnan(v), v)
    for d in (1, 2, 3, 4, 5, None):
        own = [(k, v) for dd, k, v in rows if dd == d]
        values = [key(v) for _, v in own if v is not None]
        for k, v in own:
            want = (None, None, len(values), len(own)) if v is None else (1 + sum(x < key(v) for x in values), sum(x == key(v) for x in values) if v == v else 1, len(values), len(own))
            assert mine[d, k] == want, (d, k, v)
    assert got.where("date = 1").select(F.spark_partition_id()).distinct().count() > 2
    finite = df.where("abs(x) < 1e300 or x is null")
    for r in wide.quantiles(finite, "x", [0.0, 0.025, 0.5, 1.0], pieces=16).collect():
        values = [v for dd, _, v in rows if dd == r.date and v is not None and abs(v) < 1e300]
        assert [r.q0, r.q1, r.q2, r.q3] == (pytest.approx(np.quantile(values, [0.0, 0.025, 0.5, 1.0])) if values else [None] * 4)


def test_windows_over_buckets_need_no_shuffle(split, tmp_path):
    bars, rows = panel(split, 12, 20)
    io.write_bucketed(bars, "bucketed_bars", 4, str(tmp_path / "t"))
    out = risk.log_returns(split.table("bucketed_bars"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan
    assert sorted(map(tuple, out.select("symbol", "date", "ret").collect())) == sorted(map(tuple, risk.log_returns(bars).select("symbol", "date", "ret").collect()))
    split.sql("DROP TABLE bucketed_bars")


@pytest.mark.parametrize("tile", [2, 32])
def test_rolling_covariance_of_common_rows(spark, tile):
    rng = random.Random(9)
    rows = [(f"s{s}", D + dt.timedelta(days=t), rng.uniform(-1, 1)) for s in range(5) for t in range(40) if rng.random() < 0.7]
    got = {(r.sym_i, r.sym_j, r.ts): r.cov for r in tiles.rolling_pairs(spark.createDataFrame(rows, "symbol string, ts date, ret double"), 6, tile).collect()}
    value, want = {(s, t): r for s, t, r in rows}, {}
    for i in range(5):
        for j in range(i, 5):
            both = [t for t in sorted({r[1] for r in rows}) if (f"s{i}", t) in value and (f"s{j}", t) in value]
            for k in range(5, len(both)):
                x, y = ([value[f"s{s}", t] for t in both[k - 5 : k + 1]] for s in (i, j))
                want[f"s{i}", f"s{j}", both[k]] = pytest.approx(np.cov(x, y)[0, 1], abs=1e-12)
    assert got == want


def panel(spark, symbols=70, days=60, seed=3):
    rng = np.random.default_rng(seed)
    classes = ["EQUITY", "ETF", "TEFAS_FREE", "TEFAS_LIQUID"]
    rows = []
    for s in range(symbols):
        for t in range(days):
            if rng.random() < 0.5:
                p = float(np.exp(rng.normal(0, 0.1)) * 10)
                v = float(rng.integers(0, 100))
                rows.append((s, D + dt.timedelta(days=t), classes[s % 4], p, p * 1.02, p * 0.97, v, float(rng.integers(0, 1 + int(v))), 1))
    return spark.createDataFrame(rows, "symbol long, date date, asset_type string, close double, high double, low double, volume double, auction_volume double, settlement_days int"), rows


def test_every_snapshot_equals_one_of_its_own(spark):
    bars, rows = panel(spark)
    times = [D + dt.timedelta(days=k) for k in (2, 3, 20, 21, 45, 200)]
    snaps = spark.createDataFrame([(t, t - dt.timedelta(days=1)) for t in times], "snapshot_time date, nav_cutoff date")
    vol = {(r.snapshot_time, r.symbol): (r.vol, r.is_fallback) for r in snapshots.snapshot_volatility(bars, snaps).collect()}
    cov = {(r.snapshot_time, r.sym_i, r.sym_j): r.cov for r in snapshots.bitemporal_cov(bars, snaps).collect()}
    bounds = {r.snapshot_time: r for r in snapshots.cov_bounds(bars, snaps).collect()}
    report = {(r.snapshot_time, r.symbol): r for r in snapshots.risk_report(bars, snaps).collect()}
    nav = F.col("asset_type").isin("TEFAS_FREE", "TEFAS_LIQUID")
    for t in times:
        seen = bars.where((nav & (F.col("date") < t)) | (~nav & (F.col("date") <= t)))
        assert {k[1]: v for k, v in vol.items() if k[0] == t} == {r.symbol: (pytest.approx(r.vol, abs=1e-9), r.is_fallback) for r in risk.snapshot_volatility(seen).collect()}
        x = risk.log_returns(seen).select("symbol", "asset_type", F.col("date").alias("ts"), "ret")
        fast = x.where("asset_type in ('EQUITY', 'ETF')")
        if fast.select("ts").distinct().count() > 1:
            kappa = risk.newey_west_kappa(fast)
            assert bounds[t].kappa == pytest.approx(kappa.first().kappa, abs=1e-9)
            want = {(r.sym_i, r.sym_j): r.cov for r in risk.bitemporal_cov(fast, x, kappa).collect()}
            assert {k[1:]: v for k, v in cov.items() if k[0] == t} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
            symbols = sorted({k[0] for k in want} | {k[1] for k in want})
            m = np.array([[want[min(a, b), max(a, b)] for a in symbols] for b in symbols])
            radius = np.abs(m).sum(1) - np.abs(np.diag(m))
            assert bounds[t].lower == pytest.approx((np.diag(m) - radius).min()) and bounds[t].upper == pytest.approx((np.diag(m) + radius).max())
            for k, s in enumerate(symbols):
                assert report[t, s].variance == pytest.approx(m[k, k] + bounds[t].eps)
            least = np.linalg.eigvalsh(m + np.eye(len(m)) * bounds[t].eps)
            assert least[0] >= 1e-6 - 1e-9 and least[-1] / least[0] <= 1e4 * (1 + 1e-6)
        n = [sum(r[1] > (t if r[2] in ("EQUITY", "ETF") else t - dt.timedelta(days=1)) for r in rows if (r[2] in ("EQUITY", "ETF")) == fast) for fast in (True, False)]
        one = next(r for k, r in report.items() if k[0] == t)
        assert (one.checked, one.filtered, one.intraday_violations, one.nav_violations) == (len(rows), sum(n), *n)


def test_hinges_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = [(D + dt.timedelta(days=d), s, round(rng.uniform(-1, 1), 1), rng.choice([-0.2, 0.0, 0.1, 0.3, 0.31])) for d, n in ((0, 40), (1, 1), (2, 2), (3, 7)) for s in range(n)]
    got = {r.date: r.pair_loss for r in evaluation.pairwise_margin_loss(spark.createDataFrame(rows, "date date, symbol long, score double, actual double")).collect()}
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        terms = [max(0.0, 0.1 - np.sign(a[3] - b[3]) * (a[2] - b[2])) for k, a in enumerate(own) for b in own[k + 1 :]]
        assert got.get(d) == (pytest.approx(sum(terms) / len(terms)) if terms else None)


def test_cover_of_cards(spark):
    rng = random.Random(6)
    bars = [(s, D + dt.timedelta(days=t), 10 + rng.random(), 9 + rng.random()) for s in (1, 2) for t in range(-40, 90) if rng.random() < 0.6]
    cards = [(k, rng.choice([1, 2, 3]), (a := D + dt.timedelta(days=rng.randint(-50, 90))), a + dt.timedelta(days=rng.choice([-3, 0, 1, 6, 7, 63, 64, 100])), 10.9, 9.05) for k in range(300)]
    cards += [(999, 1, dt.date(1969, 12, 1), dt.date(1970, 2, 1), 10.0, 9.0)]
    got = labels.path_barrier_outcome(spark.createDataFrame(cards, "card_id long, symbol long, issue_date date, due_date date, target double, stop double"), spark.createDataFrame(bars, "symbol long, date date, high double, low double")).collect()
    assert len(got) == len(cards)
    want = {}
    for k, s, a, b, _, _ in cards:
        own = [r for r in bars if r[0] == s and a <= r[1] <= b]
        want[k] = (max((r[2] for r in own), default=None), min((r[3] for r in own), default=None))
    assert {r.card_id: (r.max_price, r.min_price) for r in got} == want


def test_uniqueness_of_spans(spark):
    rng = random.Random(7)
    spans = [(rng.choice([1, 2]), (a := rng.randint(0, 60)), a + rng.randint(0, 15), 0.1) for _ in range(120)]
    spans += [spans[0], (3, 5, 5, -0.2)]
    got = sorted((r.symbol, r.start_t, r.end_t, round(r.uniqueness, 9)) for r in labels.label_uniqueness(spark.createDataFrame(spans, "symbol long, start_t int, end_t int, ret double")).collect())
    want = []
    for s, a, b, _ in spans:
        busy = [sum(x[0] == s and x[1] <= t <= x[2] for x in spans) for t in range(a, b + 1)]
        want.append((s, a, b, round(sum(1 / c for c in busy) / len(busy), 9)))
    assert got == sorted(want)
