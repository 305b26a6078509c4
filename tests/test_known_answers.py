"""Operators on small tables with answers worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import crosssec, decisions, fundamentals, ingest, labels, pit, risk, technical

D = dt.date(2026, 1, 1)


def bars(spark, rows):
    """(symbol, day, class, close, volume, auction)"""
    data = [(s, D + dt.timedelta(days=k), c, float(p), float(p), float(p), float(v), float(a), 1) for s, k, c, p, v, a in rows]
    return spark.createDataFrame(data, "symbol long, date date, asset_type string, close double, high double, low double, volume double, auction_volume double, settlement_days int")


def test_temporal_lock_counts(spark):
    ts = lambda s: dt.datetime.fromisoformat(s)
    rows = [(1, "EQUITY", ts("2026-03-20 17:30:00")), (1, "EQUITY", ts("2026-03-20 17:30:01")), (2, "ETF", ts("2026-03-20 17:29:59")), (3, "TEFAS_FREE", ts("2026-03-19 23:59:59")), (3, "TEFAS_FREE", ts("2026-03-20 00:00:00"))]
    df = spark.createDataFrame(rows, "symbol long, asset_type string, ts timestamp")
    snapshot, nav = F.lit("2026-03-20 17:30:00").cast("timestamp"), F.lit("2026-03-19 23:59:59.999999").cast("timestamp")
    assert tuple(pit.lock_audit(df, snapshot, nav, "ts").first()) == (5, 2, 1, 1, True)
    assert pit.temporal_lock(df, snapshot, nav, "ts").count() == 3
    assert {r.reason for r in pit.lock_violations(df, snapshot, nav, "ts").collect()} == {"after snapshot", "after nav cutoff"}
    with pytest.raises(ValueError):
        pit.assert_snapshot(df, snapshot, nav, "ts")


def test_lock_to_the_microsecond(spark):
    at = dt.datetime(2026, 3, 20, 17, 30)
    df = spark.createDataFrame([(1, "EQUITY", at), (2, "EQUITY", at + dt.timedelta(microseconds=1))], "symbol long, asset_type string, ts timestamp")
    kept = pit.temporal_lock(df, F.lit(at), F.lit(at), "ts").collect()
    assert [r.symbol for r in kept] == [1]


def test_visible_as_of(spark):
    facts = spark.createDataFrame([(1, dt.datetime(2026, 3, 17, 9), 5.0)], "symbol long, knowledge_ts timestamp, x double")
    probes = spark.createDataFrame([(1, dt.datetime(2026, 3, 15, 18)), (1, dt.datetime(2026, 3, 17, 10))], "symbol long, probe_ts timestamp")
    got = {r.probe_ts.day: r.x for r in pit.visible_as_of(facts, probes, ["x"]).collect()}
    assert got == {15: None, 17: 5.0}


def test_log_return(spark):
    got = risk.log_returns(bars(spark, [(1, 0, "EQUITY", 100, 1, 0), (1, 1, "EQUITY", 105, 1, 0)])).collect()
    assert len(got) == 1 and math.isclose(got[0].ret, math.log(1.05))


def test_auction_ratio(spark):
    rows = [(1, k, "EQUITY", 10, 100_000, 10_000) for k in range(25)] + [(2, k, "EQUITY", 10, 100_000, 0) for k in range(10)] + [(3, k, "TEFAS_FREE", 10, 1, 0) for k in range(3)]
    got = {r.symbol: r for r in risk.auction_ratio_ma20(bars(spark, rows)).collect()}
    assert math.isclose(got[1].auction_ratio, 0.10) and got[1].days_used == 20 and not got[1].is_floored
    assert got[2].auction_ratio == 1e-6 and got[2].is_floored
    assert got[3].auction_ratio == 1.0 and got[3].days_used == 0


def test_free_float_and_slippage(spark):
    df = spark.createDataFrame([(8.5e6, 1e8, 145.5, 1e6)], "free_float_shares double, total_shares double, price double, volume double")
    r = risk.free_float_table(df).first()
    assert math.isclose(r.float_pct, 8.5) and math.isclose(r.float_value, 1_236_750_000) and round(r.cri, 2) == 1.29 and r.blocked
    o = spark.createDataFrame([(1e6, 1e6, 0.02, 10.0, True), (1.0, 1e9, 0.02, 10.0, False)], "order_volume double, adv double, daily_vol double, price double, limit_down boolean")
    got = risk.slippage_table(o).collect()
    assert got[0].executed_price == 8.0 and not got[0].feasible and got[1].slippage == 0.001


def test_beta_formulas():
    assert math.isclose(0.67 * 0.5 + 0.33, 0.665) and round(0.5 / (1 + 0.8 * 0.5), 3) == 0.357


def test_fib_levels(spark):
    df = bars(spark, [(1, 0, "EQUITY", 330, 1, 0), (1, 1, "EQUITY", 260, 1, 0), (1, 2, "EQUITY", 300, 1, 0)])
    r = technical.fib_levels(df).orderBy("date").collect()[-1]
    assert [round(r[c], 2) for c in technical.RETRACEMENTS] == [313.48, 303.26, 295.0, 286.74, 284.5, 274.98]


def test_pct_rank_avg(spark):
    df = spark.createDataFrame([(1, x) for x in (12.5, 45.0, 8.2, 18.0, 100.0)], "date int, x double")
    assert {r.x: r.pct_rank for r in crosssec.pct_rank_avg(df, "x").collect()} == {12.5: 0.25, 45.0: 0.75, 8.2: 0.0, 18.0: 0.5, 100.0: 1.0}


def test_pct_rank_min_masks_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 3.0)], "date int, x double")
    assert {r.x: r.x_ranked for r in crosssec.pct_rank_min(df, ["x"]).collect()} == {1.0: 0.0, None: None, 3.0: 0.5}


def test_delisted_row_is_decoupled(spark):
    df = spark.createDataFrame([(1, x) for x in (0.15, 0.05, -0.05, -1.0)], "date int, ret double")
    got = {r.ret: (r.is_delisted, r.target) for r in crosssec.delist_decouple(df).collect()}
    assert got[-1.0] == (True, -2.0) and not got[0.15][0]


def test_label_uniqueness(spark):
    df = spark.createDataFrame([(1, 1, 5, 0.03), (1, 2, 6, 0.02), (1, 5, 8, -0.01)], "symbol long, start_t int, end_t int, ret double")
    got = {r.start_t: round(r.uniqueness, 4) for r in labels.label_uniqueness(df).collect()}
    assert got == {1: 0.5667, 2: 0.4667, 5: 0.7083}


BASE = {"ticker": 1, "as_of": D, "sector": 0, "market_cap": 150e9, "net_income": 12e9, "one_off_income": 4e9, "growth_pct": 20.0, "risk_free": 0.3, "net_debt": 1.0, "ebitda": 10.0}


def company(spark, **changes):
    row = {**BASE, **changes}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'date' if k == 'as_of' else 'long' if k in ('ticker', 'sector') else 'double'}" for k in row))


def test_pe_score(spark):
    r = fundamentals.pe_score(company(spark)).first()
    assert r.raw_pe == 12.5 and r.adjusted_pe == 18.75 and r.one_off
    r = fundamentals.pe_score(company(spark, net_income=-20e6, market_cap=100e6, one_off_income=0.0)).first()
    assert r.raw_pe is None and math.isclose(r.earnings_yield, -0.2) and r.label == "BEARISH_NEGATIVE_EARNINGS"


def test_roe_score(spark):
    df = company(spark, net_income=18e9, one_off_income=1.2e9, equity=30e9, ebit=20e9, revenue=100e9, total_assets=85e9)
    r = fundamentals.roe_score(df, inflation=0.38, payout=0.5).first()
    assert round(r.raw_roe, 2) == 0.60 and round(r.core_roe, 2) == 0.56 and round(r.real_roe, 2) == 0.18 and round(r.leverage, 2) == 2.83 and round(r.sgr, 2) == 0.28


def test_liquidity_score(spark):
    df = company(spark, current_assets=85e9, current_liabilities=65e9, inventories=30e9, related_receivables=4e9, doubtful_receivables=1e9, cash=15e9, operating_cash=1e9)
    r = fundamentals.liquidity_score(df).first()
    assert round(r.current_ratio, 3) == 1.308 and round(r.adjusted_ratio, 2) == 1.23 and round(r.quick_ratio, 3) == 0.769 and round(r.cash_ratio, 2) == 0.23 and r.working_capital == 20e9


def test_master_fusion(spark):
    names = [p for parts in decisions.PARTS.values() for p in parts]
    df = spark.createDataFrame([(1, *[0.9] * 19, True, 3.0)], "symbol long, " + ", ".join(f"{n}_score double" for n in names) + ", stealth boolean, confluence double")
    r = decisions.master_fusion(df).first()
    assert r.composite >= 0.85 and r.label.startswith("STRONG_BUY") and r.weight_pct == 12.5 and len(r.drivers) == 2
    r = decisions.master_fusion(df.withColumn("cri", F.lit(9.0))).first()
    assert r.composite == 0 and r.hard_block and r.label.startswith("REJECTED")


def test_consolidation_has_all_pairs(spark):
    df = spark.createDataFrame([(b, a) for b in (-1, 0, 1) for a in (-1, 0, 1)], "engine_b int, engine_a int")
    assert decisions.consolidate(df).where("signal is null").count() == 0


def test_state_keeps_in_the_middle(spark):
    rows = [(1, D + dt.timedelta(days=k), 100.0, 1.0, p) for k, p in enumerate((0.48, 0.6, 0.48, 0.3, 0.48))]
    df = spark.createDataFrame(rows, "symbol long, date date, close double, atr double, p_success double")
    assert [r.code for r in decisions.eod_state(df).orderBy("date").collect()] == [0, 1, 1, -1, -1]


def test_conditioned_matrix_keeps_its_limits(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.normal(size=(6, 4))
    m = a @ a.T
    cov = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(6) for j in range(i, 6)], "sym_i int, sym_j int, cov double")
    out = np.zeros((6, 6))
    for r in risk.cov_condition(cov).collect():
        out[r.sym_i, r.sym_j] = out[r.sym_j, r.sym_i] = r.cov
    w = np.linalg.eigvalsh(out)
    assert w[0] >= 1e-6 and w[-1] / w[0] <= 1e4 * (1 + 1e-9)


def test_covariance_equals_the_dense_one(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 5)) * (rng.random((30, 5)) < 0.6)
    x[:, 4] = 0
    x[7, 4] = 1.0
    df = spark.createDataFrame([(s, t, float(x[t, s])) for t in range(30) for s in range(5) if x[t, s]], "symbol int, ts int, ret double")
    grid = sorted({t for t in range(30) if x[t].any()})
    want = np.cov(x[grid].T)
    for r in risk.pair_covariance(df).collect():
        assert math.isclose(r.cov, want[r.sym_i, r.sym_j], abs_tol=1e-12)


def test_wilder_rsi_short_history_is_null(spark):
    got = technical.rsi_wilder(bars(spark, [(1, k, "EQUITY", 10 + k, 1, 0) for k in range(5)])).collect()
    assert all(r.rsi is None for r in got)


def test_fill_and_validate(spark):
    df = bars(spark, [(1, 0, "EQUITY", 10, 1, 0), (1, 2, "EQUITY", 12, 1, 0), (2, 1, "ETF", 5, 1, 0)])
    got = {(r.symbol, (r.date - D).days): r.close for r in ingest.fill_calendar(df, ["close"]).collect()}
    assert got == {(1, 0): 10, (1, 1): 10, (1, 2): 12, (2, 0): None, (2, 1): 5, (2, 2): 5}
    assert {r.reason for r in ingest.validate_points(df.withColumn("close", F.lit(-1.0))).collect()} == {"price"}


def test_empty_tables_do_not_fail(spark):
    df = bars(spark, [(1, 0, "EQUITY", 10, 1, 0)]).where("symbol < 0")
    for out in (risk.snapshot_volatility(df), technical.ma_cross(df), technical.rvol_flow(df), crosssec.class_zscore(df, ["close"]), labels.label_uniqueness(df.selectExpr("symbol", "1 as start_t", "2 as end_t", "close as ret"))):
        assert out.count() == 0
