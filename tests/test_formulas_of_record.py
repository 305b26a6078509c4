"""Answers worked out by hand for the evaluation formulas, the valuation parts and the streaming state."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import crosssec, decisions, evaluation, factors, fundamentals, micro, technical
from tidepanel.streaming import streams

D = dt.date(2026, 1, 1)
PRED = "date date, symbol long, asset_type string, score double, actual double"


def predictions(spark, pairs, classes="ABCDEFGH"):
    return spark.createDataFrame([(D, k, classes[k % len(classes)], float(p), float(y)) for k, (p, y) in enumerate(pairs)], PRED)


def market(spark, ret, vol):
    return spark.createDataFrame([(D, ret, vol)], "date date, market_return double, market_vol double")


def test_root_cause_of_a_calm_and_a_shocked_market(spark):
    # errors 0.01, 0.03 in sector A and 0.08 alone in B; the order is right, so ranking counts nothing
    df = predictions(spark, [(0.02, 0.01), (0.06, 0.03), (0.18, 0.10)], "AAB")
    calm = evaluation.root_cause(df, market(spark, -0.03, 0.04)).first()
    assert calm.mae == pytest.approx(0.04) and calm.shock == 0.10 and calm.sector_noise == 0.2 and calm.spearman == 1.0
    assert calm.deviation == pytest.approx(math.sqrt((0.03**2 + 0.01**2 + 0.04**2) / 3))
    assert calm.ranking_weight == 0 and calm.learning_rate == 1e-6
    assert calm.summary == "shock 10.0 %, sector noise 20.0 %, ranking 0.0 %, NDCG@10 1.00, Spearman 1.00"
    # the wrong order: 1 - (0.5 * 0.10 + 0.3 * 0.2) = 0.89; a fall of 4 % with volatility 0.006 gives 0.8 + 0.1
    df = predictions(spark, [(0.03, 0.01), (0.02, 0.02), (0.01, 0.03)], "AAB")
    assert evaluation.root_cause(df, market(spark, 0.0, 0.0)).first().ranking_weight == pytest.approx(0.89)
    shocked = evaluation.root_cause(df, market(spark, -0.04, 0.006)).first()
    assert shocked.shock == pytest.approx(0.9) and shocked.ranking_weight == pytest.approx(0.49) and shocked.learning_rate == pytest.approx(0.49e-4)
    assert evaluation.root_cause(df, market(spark, 0.2, 0.5)).first().shock == 1.0
    # two sectors of two with errors 0.01 and 0.07: their deviation is 0.03
    noisy = predictions(spark, [(0.01, 0.0), (0.01, 0.0), (0.07, 0.0), (0.07, 0.0)], "AABB")
    assert evaluation.root_cause(noisy, market(spark, 0.0, 0.0)).first().sector_noise == 0.5


def test_proximity(spark):
    df = predictions(spark, [(0.009, 0), (0.029, 0), (0.049, 0), (0.099, 0), (0.101, 0)])
    assert [r.proximity for r in evaluation.proximity_score(df).orderBy("symbol").collect()] == [100, 50, 20, 0, -50]
    # 0.5 * (0.015 / 0.03)^2 = 0.125 and 0.06 / 0.03 - 0.5 = 1.5
    assert evaluation.huber_proximity(predictions(spark, [(0.015, 0), (0.06, 0)])).first().huber == pytest.approx(0.8125)


def test_tail_loss(spark):
    # right order, scores 1 apart: nothing; all scores equal: every pair 0.1, each tail 0.2
    assert evaluation.triplet_tail_loss(predictions(spark, [(k, k) for k in range(6)])).first().tail_loss == 0
    assert evaluation.triplet_tail_loss(predictions(spark, [(0, k) for k in range(6)])).first().tail_loss == pytest.approx(0.1 + 0.2 + 0.2)
    assert evaluation.triplet_tail_loss(predictions(spark, [(0, k) for k in range(5)])).first().tail_loss == 0


def test_soft_ndcg_of_two(spark):
    # z = -+1 / (1 + 1e-5); their difference of 2 at temperature 0.1 is clamped to 10
    got = evaluation.soft_ndcg_loss(predictions(spark, [(-1, 0.1), (1, 0.2)])).first().soft_loss
    near, far = 1 + 1 / (1 + math.exp(10)), 1 + 1 / (1 + math.exp(-10))
    one = 31 / math.log2(near + 1) * (1 + 4 * math.exp(-0.8 * (near - 1) ** 2)) / 31
    share = math.exp(1) / (math.exp(1) + math.exp(-1))
    assert far > near and got == pytest.approx(1 - one + 2 * (share - 0.15))
    # one asset: no gain on either side, spread 0, all the weight on it; crashed, it adds a logistic of its score
    assert evaluation.soft_ndcg_loss(predictions(spark, [(2, -0.95)])).first().soft_loss == pytest.approx(0.5 * (2 - (31 / math.log2(2) * 5) / 31 - 0) + 1 / (1 + math.exp(-2)) + 0.5 + 2 * 0.85)


EV = {"ticker": 1, "as_of": D, "sector": 0, "market_cap": 100.0, "gross_debt": 40.0, "leases": 5.0, "cash": 20.0, "restricted_cash": 8.0, "associates": 6.0, "minority": 10.0, "ebitda": 12.0, "capex": 2.0}


def test_enterprise_value(spark):
    df = spark.createDataFrame([tuple(EV.values())], ", ".join(f"{k} {'date' if k == 'as_of' else 'long' if k in ('ticker', 'sector') else 'double'}" for k in EV))
    r = fundamentals.ev_score(df).first()
    # 100 + 40 + 5 - (20 - 8) - 6 + 2
    assert r.ev == 129 and r.restricted_cash_adjusted and r.ev_leverage == pytest.approx(40 / 129) and r.ev_after_capex == pytest.approx(12.9)


def test_earnings_with_expenses_added_back(spark):
    names = "ticker long, as_of date, sector long, market_cap double, net_income double, one_off_income double, one_off_expense double, growth_pct double, risk_free double, net_debt double, ebitda double"
    r = fundamentals.pe_score(spark.createDataFrame([(1, D, 0, 150.0, 12.0, 4.0, 2.0, 20.0, 0.3, 1.0, 10.0)], names)).first()
    assert r.adjusted_pe == 15.0 and r.raw_pe == 12.5


def test_flags_of_delisted_rows(spark):
    df = spark.createDataFrame([(D, 1, -0.95, False), (D, 2, 0.1, True), (D, 3, 0.2, None), (dt.date(2026, 1, 2), 1, 0.1, True)], "date date, symbol long, ret double, gone boolean")
    got = {(r.date.day, r.symbol): (r.is_delisted, r.target, r.spread) for r in crosssec.delist_decouple(df, flag="gone", low=0.0, high=1.0).collect()}
    assert got == {(1, 1): (False, -0.95, pytest.approx(1.15)), (1, 2): (True, -2.0, pytest.approx(1.15)), (1, 3): (False, 0.2, pytest.approx(1.15)), (2, 1): (True, -2.0, 0.0)}


def test_small_parts(spark):
    flow = micro.money_flow_fusion(spark.createDataFrame([(0.5, -0.25, 0.5, 1.0, -0.1), (0.0, 0.0, None, -1.0, 0.1)], "obi double, concentration double, custody double, net_flow double, price_change double")).collect()
    assert [(r.custody_score, r.label) for r in flow] == [(0.5, "STRONG_BULLISH_INSTITUTIONAL_BUY"), (0.8, "NEUTRAL")]
    bars = spark.createDataFrame([(1, D, 10.0, 5.0, 4.0, 1.0), (1, dt.date(2026, 1, 2), 11.0, 5.0, None, 2.0)], "symbol long, date date, close double, volume double, bid_volume double, ask_volume double")
    assert [r.delta for r in technical.rvol_flow(bars).orderBy("date").collect()] == [3.0, -2.0]
    assert [r.delta for r in technical.rvol_flow(bars.drop("bid_volume")).collect()] == [0.0, 0.0]
    days = [(s, D + dt.timedelta(days=k), 100.0 + s * k, s % 2) for s in range(4) for k in range(70)]
    got = factors.horizon_factors(spark.createDataFrame(days, "symbol long, date date, close double, sector long"), sector="sector").where(f"date = '{D + dt.timedelta(days=69)}'").collect()
    ret = {s: (100 + s * 69) / (100 + s * 48) - 1 for s in range(4)}
    for r in got:
        assert r.rs_sector == pytest.approx(ret[r.symbol] - (ret[r.symbol % 2] + ret[r.symbol % 2 + 2]) / 2)
        mean = lambda n, s=r.symbol: sum(100 + s * k for k in range(70 - n, 70)) / n
        assert r.vwap_ratio == pytest.approx(mean(21) / mean(63) - 1)


STORE = "spark.sql.streaming.stateStore.providerClass"


def streamed(spark, tmp_path, parts, schema, build):
    """Rows that a stream makes of parts, one file each, one file a batch."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
        out.writeStream.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()


def test_late_rows_are_decided_in_order(spark, tmp_path):
    rng = random.Random(8)
    rows = [(s, D + dt.timedelta(days=k), 100 + rng.uniform(-6, 6), 2.0, rng.uniform(0.3, 0.6)) for s in (1, 2) for k in range(12)]
    schema = "symbol long, date date, close double, atr double, p_success double"
    want = sorted((r.symbol, r.date, r.code, r.days_held, r.p_prev) for r in decisions.eod_state(spark.createDataFrame(rows, schema)).collect())
    shuffled = sorted(rows, key=lambda r: (r[1].toordinal() + rng.choice([0, 4])) // 4)
    parts = [shuffled[:9], shuffled[9:], [(-1, dt.date(2030, 1, 1), 1.0, 1.0, 0.5)]]
    got = streamed(spark, tmp_path, parts, schema, lambda s: streams.stream_eod_state(s, "20 days"))
    assert sorted((r.symbol, r.date, r.code, r.days_held, r.p_prev) for r in got) == want


def test_a_later_signal_changes_later_alerts(spark, tmp_path):
    at = lambda h: dt.datetime(2026, 1, 5, h)
    nothing = (None, None, None)
    tick, signal = lambda h, p: (1, at(h), False, p, *nothing), lambda h, stop: (1, at(h), True, None, stop, 0.0, 100.0)
    parts = [[tick(9, 50.0), signal(10, 90.0), tick(11, 95.0)], [signal(13, 99.0), tick(12, 97.0), tick(14, 98.0), tick(13, 98.5)], [(-1, dt.datetime(2030, 1, 1), False, 1.0, *nothing)]]
    schema = "symbol long, ts timestamp, is_signal boolean, price double, stop double, atr double, prev_close double"
    got = streamed(spark, tmp_path, parts, schema, lambda s: streams.stream_gap_sentinel(s.where("not is_signal"), s.where("is_signal"), "10 hours"))
    # 95 is 5 % below the close of 100: a gap under the first signal; 98.5 and 98 are below the stop of the second one
    assert sorted((r.ts.hour, r.price, r.alert) for r in got) == [(11, 95.0, "GAP"), (13, 98.5, "STOP"), (14, 98.0, "STOP")]
