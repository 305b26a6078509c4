"""Queries for fundamentals, microstructure, decisions, evaluation, models and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.cuts import cut
from tidepanel.operators import crosssec, decisions, evaluation, fundamentals, labels, micro, ml, pit, risk, technical
from tidepanel.plans.queries_data import ADV, FWD, PEN, labelled
from tidepanel.plans.registry import Tables, add
from tidepanel.sources import io
from tidepanel.streaming import streams

BY = "PARTITION BY symbol ORDER BY date"
BANDS = "CASE WHEN {p} >= 0.75 THEN 'BULLISH' WHEN {p} >= 0.60 THEN 'MODERATE_BULLISH' WHEN {p} >= 0.40 THEN 'NEUTRAL' ELSE 'BEARISH' END"

# -- fundamentals ---------------------------------------------------------------------------------------------------
PE = """pe1 AS (SELECT *, net_income <= 0 OR market_cap <= 0 AS negative, CASE WHEN net_income > 0 AND market_cap > 0 THEN greatest(1, least(500, market_cap / net_income)) END AS raw_pe, CASE WHEN net_income - one_off_income + one_off_expense > 0 AND market_cap > 0 THEN greatest(1, least(500, market_cap / (net_income - one_off_income + one_off_expense))) END AS adjusted_pe FROM company),
pe2 AS (SELECT *, coalesce(adjusted_pe, raw_pe) AS pe FROM pe1), pe3 AS (SELECT *, quantile_cont(pe, 0.5) OVER (PARTITION BY as_of, sector) AS sector_pe, avg(pe) OVER w AS pm, stddev_samp(pe) OVER w AS ps FROM pe2 WINDOW w AS (PARTITION BY ticker ORDER BY date_diff('day', DATE '1970-01-01', as_of) RANGE BETWEEN 1825 PRECEDING AND CURRENT ROW)),
pe4 AS (SELECT *, pe / greatest(0.1, growth_pct) AS peg, CASE WHEN pe IS NOT NULL AND sector_pe > 0 THEN pe / sector_pe ELSE 1 END AS rel, CASE WHEN pe IS NOT NULL THEN 1 / pe - risk_free ELSE -risk_free END AS erp, net_debt / greatest(1, ebitda) AS lev, CASE WHEN pe IS NOT NULL AND ps > 1e-9 THEN (pe - pm) / ps ELSE 0 END AS pe_z, sector IN (1, 3) AS cyc, one_off_income > 0 AS oo FROM pe3),
pe5 AS (SELECT *, round(least(1, greatest(0, 0.5 + CASE WHEN rel < 0.8 THEN 0.15 WHEN rel > 1.5 THEN -0.2 ELSE 0 END + CASE WHEN risk_free > 0.2 AND rel > 1.2 THEN -0.15 ELSE 0 END + CASE WHEN erp > 0.05 THEN 0.05 WHEN erp < 0 THEN -0.05 ELSE 0 END)), 6) AS pts FROM pe4),
pex AS (SELECT *, CASE WHEN negative THEN 0.15 WHEN pe > 1.5 * sector_pe AND peg > 2 THEN 0.2 WHEN (pe < 3 AND oo) OR lev > 5 THEN 0.25 WHEN rel < 0.8 AND peg < 1 AND lev < 2 THEN 0.85 WHEN peg < 1 THEN CASE WHEN erp > 0 THEN 0.8 ELSE 0.75 END WHEN cyc AND (oo OR rel > 1.2) THEN 0.32 ELSE pts END AS score,
 CASE WHEN negative THEN 'BEARISH_NEGATIVE_EARNINGS' WHEN pe > 1.5 * sector_pe AND peg > 2 THEN 'SELL_BUBBLE_PRICING' WHEN (pe < 3 AND oo) OR lev > 5 THEN 'BEARISH_VALUE_TRAP' WHEN rel < 0.8 AND peg < 1 AND lev < 2 THEN 'STRONG_BUY' WHEN peg < 1 THEN 'BUY' WHEN cyc AND (oo OR rel > 1.2) THEN 'NEUTRAL_TO_BEARISH' WHEN pts >= 0.75 THEN 'STRONG_BUY' WHEN pts >= 0.6 THEN 'BUY' WHEN pts >= 0.4 THEN 'NEUTRAL' WHEN pts >= 0.25 THEN 'NEUTRAL_TO_BEARISH' ELSE 'SELL' END AS label FROM pe5)"""
add("v01_pe_score", lambda v: fundamentals.pe_score(v("company")), "company", f"WITH {PE} SELECT ticker, as_of, label, raw_pe, adjusted_pe, peg, rel AS pe_rel, erp, pe_z, score FROM pex", "ticker as_of label", "raw_pe adjusted_pe peg pe_rel erp pe_z score", 4)
PB = f"""pb1 AS (SELECT *, equity <= 0 OR market_cap <= 0 AS dead, equity - goodwill - intangibles - deferred_tax AS tbv FROM company), pb2 AS (SELECT *, CASE WHEN NOT dead THEN net_income / equity END AS roe, CASE WHEN NOT dead THEN greatest(0.1, least(100, market_cap / equity)) END AS raw_pb, CASE WHEN NOT dead AND tbv > 0 THEN greatest(0.1, least(100, market_cap / tbv)) END AS tangible_pb FROM pb1),
pb3 AS (SELECT *, CASE WHEN NOT dead THEN greatest(0.2, (roe - 0.05) / 0.2) END AS justified_pb FROM pb2), pb4 AS (SELECT *, CASE WHEN dead THEN 0 ELSE (justified_pb - raw_pb) / justified_pb END AS discount FROM pb3),
pb5 AS (SELECT *, NOT dead AND (tbv <= 0 OR coalesce(raw_pb < 1 AND tangible_pb > 2, false)) AS gt, coalesce(raw_pb < 1 AND roe < 0.25, false) AS vt, coalesce(raw_pb < 1 AND roe >= 0.25 AND tangible_pb < 1, false) AS td, NOT dead AND (revaluation > 0 OR discount > 0.2) AS ha, coalesce(net_debt > 0 AND tbv > 0 AND net_debt / tbv > 3, false) AS lr FROM pb4),
pb6 AS (SELECT *, round(least(1, greatest(0, 0.5 + CASE WHEN discount > 0.25 THEN 0.2 WHEN discount < -0.3 THEN -0.2 ELSE 0 END + CASE WHEN ha THEN 0.1 ELSE 0 END)), 6) AS pts FROM pb5),
pbx AS (SELECT *, CASE WHEN dead THEN 0.1 WHEN gt THEN 0.25 WHEN vt THEN 0.3 WHEN td AND roe > 0.3 AND NOT lr THEN 0.88 ELSE pts END AS score, CASE WHEN dead THEN 'SOLVENCY_DISTRESS_RISK' WHEN gt THEN 'BEARISH_GOODWILL_TRAP' WHEN vt THEN 'BEARISH_VALUE_TRAP' WHEN td AND roe > 0.3 AND NOT lr THEN 'STRONG_BUY' ELSE {BANDS.format(p='pts')} END AS label FROM pb6)"""
add("v02_pb_score", lambda v: fundamentals.pb_score(v("company")), "company", f"WITH {PB} SELECT ticker, as_of, label, raw_pb, tangible_pb, justified_pb, discount, score FROM pbx", "ticker as_of label", "raw_pb tangible_pb justified_pb discount score", 4)
EB = f"""eb1 AS (SELECT *, ebit + depreciation AS re FROM company), eb2 AS (SELECT *, greatest(0.01, re - leases - stock_pay - capitalised_capex) AS ae FROM eb1), eb3 AS (SELECT *, ae / greatest(1, revenue) AS margin, (operating_cash - capex) / ae AS conversion, net_debt / ae AS leverage, re > 0 AND leases / re > 0.1 AS f1, re > 0 AND stock_pay / re > 0.05 AS f2, re > 0 AND capitalised_capex / re > 0.03 AS f3 FROM eb2),
eb4 AS (SELECT *, round(least(1, greatest(0, 0.6 + CASE WHEN conversion >= 0.4 THEN 0.15 ELSE 0 END + CASE WHEN margin > 0.1 THEN 0.1 ELSE 0 END + CASE WHEN leverage < 3 THEN 0.05 WHEN leverage > 4 THEN -0.15 ELSE 0 END + CASE WHEN f3 THEN -0.05 ELSE 0 END + CASE WHEN f1 THEN -0.04 ELSE 0 END + CASE WHEN f2 THEN -0.1 ELSE 0 END)), 6) AS pts FROM eb3),
ebx AS (SELECT *, CASE WHEN conversion < 0.3 THEN 0.18 WHEN net_income < 0 AND leverage < 4 THEN 0.78 ELSE pts END AS score, CASE WHEN conversion < 0.3 THEN 'VALUE_TRAP_NO_CASH_CONVERSION' WHEN net_income < 0 AND leverage < 4 THEN 'TURNAROUND_BUY' ELSE {BANDS.format(p='pts')} END AS label FROM eb4)"""
add("v03_ebitda_score", lambda v: fundamentals.ebitda_score(v("company")), "company", f"WITH {EB} SELECT ticker, as_of, label, re AS raw_ebitda, margin, score FROM ebx", "ticker as_of label", {"raw_ebitda": 2, "margin": 5, "score": 4})
EV = f"""ev1 AS (SELECT *, market_cap + gross_debt + leases - (cash - restricted_cash) - associates + minority * 0.20 AS ev, gross_debt AS gross FROM company), ev2 AS (SELECT *, CASE WHEN ebitda > 0 THEN ev / ebitda END AS ev_ebitda, CASE WHEN ebitda > 0 THEN CASE WHEN ebitda > capex THEN ev / (ebitda - capex) ELSE 999 END END AS eac, gross / greatest(1, CASE WHEN ebitda > 0 THEN abs(ev) ELSE ev END) AS lev FROM ev1),
ev3 AS (SELECT *, quantile_cont(ev_ebitda, 0.5) OVER (PARTITION BY as_of, sector) AS med, coalesce(eac / greatest(0.1, ev_ebitda) > 2.5, false) AS trap FROM ev2), ev4 AS (SELECT *, coalesce(ev_ebitda < 0.75 * med, false) AND NOT trap AS tt FROM ev3),
ev5 AS (SELECT *, round(least(1, greatest(0, 0.5 + CASE WHEN ev_ebitda < 0.85 * med THEN 0.15 WHEN ev_ebitda > 1.4 * med THEN -0.2 ELSE 0 END + CASE WHEN tt THEN 0.1 ELSE 0 END + CASE WHEN lev > 0.6 THEN -0.15 ELSE 0 END)), 6) AS pts FROM ev4),
evx AS (SELECT *, CASE WHEN ebitda <= 0 THEN 0.15 WHEN ev < 0 THEN 0.95 WHEN trap THEN 0.22 WHEN ev_ebitda < 0.7 * med AND lev < 0.5 THEN 0.86 ELSE pts END AS score, CASE WHEN ebitda <= 0 THEN 'CASH_BURN_RED_FLAG' WHEN ev < 0 THEN 'STRONG_BUY_NET_NET_LIQUIDATION' WHEN trap THEN 'BEARISH_CAPEX_TRAP' WHEN ev_ebitda < 0.7 * med AND lev < 0.5 THEN 'BULLISH' ELSE {BANDS.format(p='pts')} END AS label FROM ev5)"""
add("v04_ev_score", lambda v: fundamentals.ev_score(v("company")), "company", f"WITH {EV} SELECT ticker, as_of, label, trap AS capex_trap, tt AS takeover_target, restricted_cash > 0 AS restricted_cash_adjusted, ev, lev AS ev_leverage, score FROM evx", "ticker as_of label capex_trap takeover_target restricted_cash_adjusted", {"ev": 2, "ev_leverage": 5, "score": 4})
RO = f"""ro1 AS (SELECT *, (equity + coalesce(lag(equity, 4) OVER (PARTITION BY ticker ORDER BY as_of), equity)) / 2 AS ae FROM company), ro2 AS (SELECT *, CASE WHEN ae > 0 THEN net_income / ae END AS raw_roe, CASE WHEN ae > 0 THEN (net_income - one_off_income) / ae END AS core_roe, CASE WHEN ae > 0 THEN greatest(1, total_assets) / ae END AS lev, CASE WHEN ae > 0 THEN greatest(1, revenue) / greatest(1, total_assets) END AS turn, CASE WHEN ae > 0 THEN ebit / greatest(1, revenue) END AS em FROM ro1),
ro3 AS (SELECT *, CASE WHEN NOT ae > 0 THEN 'DOUBLE_NEGATIVE_BANKRUPTCY' WHEN lev > 5 THEN 'LEVERAGE_DRIVEN' WHEN turn > 2 THEN 'ASSET_TURNOVER_DRIVEN' WHEN em > 0.15 THEN 'MOAT_MARGIN_DRIVEN' ELSE 'BALANCED' END AS driver FROM ro2),
ro4 AS (SELECT *, round(least(1, greatest(0, CASE WHEN core_roe > 0.25 AND lev < 4 THEN 0.85 ELSE 0.5 END + CASE WHEN core_roe - 0.1 > 0.15 THEN 0.07 ELSE 0 END + CASE WHEN driver IN ('ASSET_TURNOVER_DRIVEN', 'MOAT_MARGIN_DRIVEN') THEN 0.05 ELSE 0 END)), 6) AS pts FROM ro3),
rox AS (SELECT *, CASE WHEN NOT ae > 0 THEN 0.1 WHEN lev > 5 THEN 0.2 WHEN core_roe - 0.1 < 0 THEN 0.25 ELSE pts END AS score, CASE WHEN NOT ae > 0 THEN 'DOUBLE_NEGATIVE_BANKRUPTCY_TRAP' WHEN lev > 5 THEN 'BEARISH_HIGH_LEVERAGE_ROE' WHEN core_roe - 0.1 < 0 THEN 'CAPITAL_DESTRUCTION_TRAP' ELSE {BANDS.format(p='pts')} END AS label FROM ro4)"""
add("v05_roe_score", lambda v: fundamentals.roe_score(v("company")), "company", f"WITH {RO} SELECT ticker, as_of, driver, label, raw_roe, core_roe, core_roe * 0.7 AS sgr, lev AS leverage, score FROM rox", "ticker as_of driver label", "raw_roe core_roe sgr leverage score", 4)
LQ = """lq1 AS (SELECT *, greatest(1, current_liabilities) AS cl, current_assets - related_receivables - doubtful_receivables AS ca FROM company), lq2 AS (SELECT *, current_assets / cl AS current_ratio, ca / cl AS a, (ca - inventories) / cl AS q, cash / cl AS c, operating_cash / cl AS cfo, sector = 2 AND ca / cl >= 0.75 AS rt FROM lq1),
lqx AS (SELECT *, a > 1.1 AND q < 0.85 AS heavy, CASE WHEN NOT rt AND a < 1 AND c < 0.15 AND cfo < 0.1 THEN 0.08 WHEN rt THEN 0.75 WHEN a >= 1.5 AND q >= 1 THEN 0.89 WHEN a >= 1.2 THEN 0.68 WHEN a >= 1 THEN 0.45 ELSE 0.2 END AS score, CASE WHEN NOT rt AND a < 1 AND c < 0.15 AND cfo < 0.1 THEN 'CRITICAL_LIQUIDITY_RISK' WHEN rt THEN 'NEUTRAL' WHEN a >= 1.5 AND q >= 1 THEN 'BULLISH' WHEN a >= 1.2 THEN 'NEUTRAL' WHEN a >= 1 THEN 'BEARISH_LIQUIDITY_WARNING' ELSE 'CRITICAL_LIQUIDITY_RISK' END AS label FROM lq2)"""
add("v06_liquidity_score", lambda v: fundamentals.liquidity_score(v("company")), "company", f"WITH {LQ} SELECT ticker, as_of, rt AS retail_exception, heavy AS inventory_heavy, label, current_ratio, a AS adjusted_ratio, q AS quick_ratio, c AS cash_ratio, score FROM lqx", "ticker as_of retail_exception inventory_heavy label", "current_ratio adjusted_ratio quick_ratio cash_ratio score", 4)
add("v07_rate_regime", lambda v: fundamentals.rate_regime(v("company")).groupBy("regime", "pe_penalty", "growth_tolerance").agg(F.count("*").alias("n")), "company", "SELECT CASE WHEN risk_free > 0.2 THEN 'HIGH_INTEREST_RATE' WHEN risk_free < 0.03 THEN 'ZERO_INTEREST_RATE' ELSE 'NORMAL_RATE' END AS regime, CASE WHEN risk_free > 0.2 THEN 1.8 WHEN risk_free < 0.03 THEN 0.5 ELSE 1 END AS pe_penalty, CASE WHEN risk_free > 0.2 THEN 0.6 WHEN risk_free < 0.03 THEN 1.5 ELSE 1 END AS growth_tolerance, count(*) AS n FROM company GROUP BY 1, 2, 3", "regime n", "pe_penalty growth_tolerance")
add("v08_feedback_weights", lambda v: fundamentals.feedback_rmse_weights(v("predictions")), "predictions", f"WITH a AS (SELECT symbol, date, (actual - (score - 0.5) * 0.4) ** 2 AS e, row_number() OVER ({BY}) AS n FROM predictions), b AS (SELECT *, CASE WHEN n >= 10 THEN sqrt(avg(e) OVER ({BY} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) END AS rmse FROM a), c AS (SELECT *, sum(CASE WHEN rmse > 0.15 THEN 1 ELSE 0 END) OVER ({BY}) AS k FROM b) SELECT symbol, date, rmse, greatest(0.15, 0.4 - 0.05 * k) AS pe_weight, 0.35 + 0.025 * k AS ev_weight, 0.25 + 0.025 * k AS fcf_weight FROM c", "symbol date", "rmse pe_weight ev_weight fcf_weight", 4)

# -- microstructure -------------------------------------------------------------------------------------------------
BI = "bi AS (SELECT ticker, ts, bid, ask, CASE WHEN bid + ask > 0 THEN (bid - ask) / (bid + ask) ELSE 0 END AS obi FROM (SELECT ticker, ts, sum(CASE WHEN side = 'BID' THEN volume ELSE 0 END) AS bid, sum(CASE WHEN side = 'ASK' THEN volume ELSE 0 END) AS ask FROM book_levels GROUP BY 1, 2) z)"
W20 = "(PARTITION BY ticker ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
add("m01_book_imbalance", lambda v: micro.book_imbalance(v("book_levels")), "book_levels", f"WITH {BI}, b AS (SELECT *, bid + ask - lag(bid + ask) OVER (PARTITION BY ticker ORDER BY ts) AS d FROM bi), c AS (SELECT *, CASE WHEN count(d) OVER {W20} >= 5 THEN stddev_samp(d) OVER {W20} END AS s, CASE WHEN count(d) OVER {W20} >= 5 THEN avg(d) OVER {W20} END AS m FROM b) SELECT ticker, ts, bid, ask, obi, CASE WHEN s > 1e-9 THEN (d - m) / s ELSE 0 END AS depth_z, 0.5 + 0.4 * obi AS score, CASE WHEN obi > 0.2 THEN 'BULLISH_ORDER_FLOW' WHEN obi < -0.2 THEN 'BEARISH_ORDER_FLOW' ELSE 'NEUTRAL_ORDER_FLOW' END AS label FROM c", "ticker ts label", "bid ask obi depth_z score", 4)
BC = "bc AS (SELECT ticker, as_of, sum(CASE WHEN b <= 5 AND net_lot > 0 THEN net_lot ELSE 0 END) / sum(gross_lot) AS buyer_share, sum(CASE WHEN s <= 5 AND net_lot < 0 THEN -net_lot ELSE 0 END) / sum(gross_lot) AS seller_share, max(CASE WHEN b = 1 AND net_lot > 0 THEN broker END) AS dominant_broker FROM (SELECT *, row_number() OVER (PARTITION BY ticker, as_of ORDER BY net_lot DESC, broker) AS b, row_number() OVER (PARTITION BY ticker, as_of ORDER BY net_lot, broker) AS s FROM broker_flow) t GROUP BY 1, 2)"
add("m02_broker_concentration", lambda v: micro.broker_concentration(v("broker_flow")), "broker_flow", f"WITH {BC} SELECT *, buyer_share - seller_share AS concentration, CASE WHEN buyer_share > 0.7 THEN 'STRONG_INSTITUTIONAL_ACCUMULATION' ELSE 'NEUTRAL' END AS regime FROM bc", "ticker as_of dominant_broker regime", "buyer_share seller_share concentration")
add("m03_custody_concentration", lambda v: micro.custody_concentration(v("custody")), "custody", "SELECT ticker, week, top / al AS top_share, 1.1 * top / al AS index, top / al >= 0.7 AS tight_float, al - lag(al) OVER (PARTITION BY ticker ORDER BY week) AS weekly_change FROM (SELECT ticker, week, sum(CASE WHEN k <= 3 THEN shares ELSE 0 END) AS top, sum(shares) AS al FROM (SELECT *, row_number() OVER (PARTITION BY ticker, week ORDER BY shares DESC, custodian) AS k FROM custody) a GROUP BY 1, 2) b", "ticker week tight_float", {"top_share": 6, "index": 6, "weekly_change": 3})


def flow_facts(v):
    """Book imbalance of the last update, broker concentration and price change of each ticker and quarter."""
    broker = micro.broker_concentration(v("broker_flow"))
    book = micro.book_imbalance(v("book_levels")).groupBy("ticker").agg(F.max_by("obi", "ts").alias("obi"))
    net = v("broker_flow").groupBy("ticker", "as_of").agg(F.sum("net_lot").alias("net_flow"))
    price = v("company").withColumn("price_change", F.col("price") / F.lag("price").over(pit.series("ticker", "as_of")) - 1).select("ticker", "as_of", "price_change")
    held = micro.custody_concentration(v("custody")).groupBy("ticker", F.trunc("week", "quarter").alias("as_of")).agg(F.max_by("score", "week").alias("custody"))
    return broker.join(net, ["ticker", "as_of"]).join(book, "ticker").join(price, ["ticker", "as_of"]).join(held, ["ticker", "as_of"], "left")


FF = f"{BC}, {BI}, hs AS (SELECT ticker, CAST(date_trunc('quarter', week) AS DATE) AS as_of, max_by(CASE WHEN top / al >= 0.7 THEN 0.80 ELSE 0.50 END, week) AS held FROM (SELECT ticker, week, sum(CASE WHEN k <= 3 THEN shares ELSE 0 END) AS top, sum(shares) AS al FROM (SELECT *, row_number() OVER (PARTITION BY ticker, week ORDER BY shares DESC, custodian) AS k FROM custody) a GROUP BY 1, 2) b GROUP BY 1, 2), ff AS (SELECT bc.ticker, bc.as_of, held, buyer_share - seller_share AS concentration, obi, net_flow, price_change FROM bc JOIN (SELECT ticker, as_of, sum(net_lot) AS net_flow FROM broker_flow GROUP BY 1, 2) n USING (ticker, as_of) JOIN (SELECT ticker, max_by(obi, ts) AS obi FROM bi GROUP BY 1) o USING (ticker) JOIN (SELECT ticker, as_of, price / lag(price) OVER (PARTITION BY ticker ORDER BY as_of) - 1 AS price_change FROM company) c USING (ticker, as_of) LEFT JOIN hs USING (ticker, as_of))"
add("m04_money_flow_fusion", lambda v: micro.money_flow_fusion(flow_facts(v)), "company broker_flow book_levels custody", f"WITH {FF} SELECT ticker, as_of, 0.5 + 0.4 * obi AS order_book_score, 0.5 + 0.4 * concentration AS broker_score, coalesce(held, 0.80) AS custody_score, CASE WHEN net_flow > 0 THEN 0.85 ELSE 0.4 END AS money_flow_score, CASE WHEN price_change < 0 AND net_flow > 0 THEN 0.88 ELSE 0.5 END AS signal, CASE WHEN price_change < 0 AND net_flow > 0 THEN 'STEALTH_ACCUMULATION_DETECTED' ELSE 'NEUTRAL' END AS regime, CASE WHEN price_change < 0 AND net_flow > 0 THEN 'STRONG_BULLISH_INSTITUTIONAL_BUY' ELSE 'NEUTRAL' END AS label FROM ff", "ticker as_of regime label", "order_book_score broker_score custody_score money_flow_score signal")


def macro_facts(v):
    index = v("monthly_panel").groupBy("date").agg(F.avg("close").alias("close")).withColumn("symbol", F.lit(0))
    ema = technical.ema(index, {"ema": 20}).select("date", "ema")
    return index.join(ema, "date").select("date", F.col("close").alias("index"), "ema", (F.lit(20.0) + F.pmod(F.month("date") * 7, F.lit(25))).alias("vix"), (F.month("date") == 11).alias("crash"))


add("m05_macro_regime", lambda v: micro.macro_regime(macro_facts(v)), "monthly_panel", "WITH i AS (SELECT date, avg(close) AS close, row_number() OVER (ORDER BY date) AS n FROM monthly_panel GROUP BY date), e AS (SELECT x.date, max(x.close) AS index, sum(CASE WHEN y.n = 1 THEN (19.0 / 21) ** (x.n - 1) ELSE 2.0 / 21 * (19.0 / 21) ** (x.n - y.n) END * y.close) AS ema FROM i x JOIN i y ON y.n <= x.n GROUP BY x.date) SELECT date, index, ema, month(date) = 11 OR (index < ema AND 20 + (month(date) * 7) % 25 > 30) AS cash FROM e", "date cash", "index ema", 3)

# -- decisions ------------------------------------------------------------------------------------------------------
def fusion_facts(v) -> DataFrame:
    # written once: each of the scores and their medians would make the table anew
    c = cut(v("company"))
    out = c.select("ticker", "as_of", "sector", "price", "volume")
    for name, scored in (("pe", fundamentals.pe_score(c)), ("pb", fundamentals.pb_score(c)), ("ebitda", fundamentals.ebitda_score(c)), ("ev", fundamentals.ev_score(c)), ("roe", fundamentals.roe_score(c).withColumn("dn", F.col("double_negative"))), ("liquidity", fundamentals.liquidity_score(c))):
        extra = {"roe": [F.col("double_negative")], "liquidity": [F.col("distress")]}.get(name, [])
        out = out.join(scored.select("ticker", "as_of", F.col("score").alias(f"{name}_score"), *extra), ["ticker", "as_of"], "left")
    ff = risk.free_float_table(c.withColumn("total_shares", F.col("shares_outstanding"))).select("ticker", "as_of", "cri", (F.col("blocked") & (F.col("ticker") % 4 == 0)).alias("blocked"), (1 - F.col("risk_score")).alias("float_liquidity_score"))
    return out.join(ff, ["ticker", "as_of"], "left").withColumn("cri", F.lit(0.0))


FUS = f"""{PE}, {PB}, {EB}, {EV}, {RO}, {LQ}, ffl AS (SELECT ticker, as_of, (fp < 10 OR cri > 8) AND ticker % 4 = 0 AS blocked, 1 - least(1, greatest(0, cri / 10)) AS fls FROM (SELECT *, CASE WHEN fp > 0 THEN 1 / (CASE WHEN fv > 1 THEN log10(fv) ELSE 1 END * fp / 100) ELSE 99 END AS cri FROM (SELECT *, free_float_shares / shares_outstanding * 100 AS fp, free_float_shares * price AS fv FROM company) a) b),
fu1 AS (SELECT c.ticker, c.as_of, (pex.score + pbx.score + ebx.score + evx.score + rox.score + lqx.score) / 6 AS fundamental_part, 0.5 AS technical_part, (0.5 + fls + 0.5) / 3 AS risk_part, blocked, NOT rox.ae > 0 AS dn, NOT lqx.rt AND lqx.a < 1 AS ds FROM company c JOIN pex USING (ticker, as_of) JOIN pbx USING (ticker, as_of) JOIN ebx USING (ticker, as_of) JOIN evx USING (ticker, as_of) JOIN rox USING (ticker, as_of) JOIN lqx USING (ticker, as_of) JOIN ffl USING (ticker, as_of)),
fu2 AS (SELECT *, CASE WHEN blocked THEN 0 ELSE (0.3 * fundamental_part + 0.25 * 0.5 + 0.25 * 0.5 + 0.2 * risk_part) * CASE WHEN dn THEN 0.5 ELSE 1 END * CASE WHEN ds THEN 0.7 ELSE 1 END END AS composite FROM fu1)"""
add("d01_master_fusion", lambda v: decisions.master_fusion(fusion_facts(v)).withColumn("warnings", F.concat_ws(";", "warnings")), "company", f"WITH {FUS} SELECT ticker, as_of, CASE WHEN blocked THEN 'REJECTED_LOW_FLOAT_CORNERING_RISK' WHEN composite >= 0.8 THEN 'STRONG_BUY_INSTITUTIONAL_CONFLUENCE' WHEN composite >= 0.65 THEN 'BUY_ACCUMULATE' WHEN composite >= 0.4 THEN 'NEUTRAL_HOLD' ELSE 'STRONG_SELL_REDUCE_EXPOSURE' END AS label, CASE WHEN blocked THEN 'low float block' ELSE concat_ws(';', CASE WHEN dn THEN 'double negative equity' END, CASE WHEN ds THEN 'liquidity distress' END) END AS warnings, fundamental_part, risk_part, composite FROM fu2", "ticker as_of label warnings", "fundamental_part risk_part composite", 4)
add("d02_meta_label", lambda v: decisions.meta_label(v("signals").select("symbol", "date", (F.col("symbol") % 3 - 1).cast("int").alias("side"), F.col("p_success").alias("win_rate"), (F.col("symbol") % 7 * 0.002).alias("spread"), (F.col("p_bull") - 0.5).alias("obi"), F.lit(0.01537).alias("volatility"))), "signals", "SELECT symbol, date, p AS p_success, 2 * p - 1 AS p_size, side <> 0 AND p >= 0.55 AS approved FROM (SELECT symbol, date, symbol % 3 - 1 AS side, CASE WHEN symbol % 3 = 1 THEN 0.5 ELSE least(1, greatest(0, p_success + least(0.2, greatest(-0.15, (p_bull - 0.5) * 0.25)) + 0.02315 - least(0.15, symbol % 7 * 0.02))) END AS p FROM signals) t", "symbol date approved", "p_success p_size", 5)
EN = "en AS (SELECT *, CASE WHEN p_bull > p_bear AND p_bull >= 0.35 THEN 1 WHEN p_bear > 0.45 THEN -1 ELSE 0 END AS engine_a, CASE WHEN p_success >= 0.52 THEN 1 WHEN p_success < 0.4 THEN -1 ELSE 0 END AS engine_b FROM signals)"
MX = "mx(engine_b, engine_a, signal, advice) AS (VALUES " + ", ".join(f"({b}, {a}, '{s}', '{t}')" for b, a, s, t in decisions.MATRIX) + ")"
add("d03_d04_consolidated_signals", lambda v: decisions.consolidate(decisions.engine_signals(v("signals"))), "signals", f"WITH {EN}, {MX} SELECT symbol, date, engine_a, engine_b, signal, advice FROM en JOIN mx USING (engine_a, engine_b)", "symbol date engine_a engine_b signal advice")


def states(v) -> DataFrame:
    return decisions.eod_state(v("signals"))


def lagged(c: str) -> str:
    return f"lag({c}) OVER ({BY})"


ST = f"st1 AS (SELECT *, row_number() OVER ({BY}) - 1 AS days_held, coalesce({lagged('p_success')}, p_success) AS p_prev, {lagged('close')} AS pc FROM signals), st2 AS (SELECT *, CASE WHEN coalesce(close / pc - 1 <= -greatest(1.8 * atr / pc, 0.04), false) OR p_success < 0.4 OR (p_success < 0.45 AND days_held >= 20) THEN -1 WHEN p_success >= 0.52 THEN 1 END AS ev FROM st1), st AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS code FROM st2)"
add("d06_eod_state", states, "signals", f"WITH {ST} SELECT symbol, date, code, days_held, p_prev FROM st", "symbol date code days_held", "p_prev")
TGT = f"{ST}, tv AS (SELECT *, greatest(1.5 * atr / close, 0.04) AS vf FROM st), tl AS (SELECT *, CASE code WHEN 1 THEN greatest(0.045, (p_success - 0.5) * 0.3 + vf) WHEN -1 THEN 0 ELSE greatest(0.015, vf * 0.5) END AS lo FROM tv), tx AS (SELECT *, close * (1 + lo) AS target_low, close * (1 + CASE code WHEN 1 THEN lo + vf WHEN -1 THEN greatest(0.01, vf * 0.3) ELSE lo + vf * 0.7 END) AS target_high, close * (1 - CASE code WHEN -1 THEN greatest(0.045, vf * 1.3) ELSE greatest(0.035, vf) END) AS stop FROM tl)"
add("d05_price_targets", lambda v: decisions.price_targets(states(v)), "signals", f"WITH {TGT} SELECT symbol, date, target_low, target_high, stop FROM tx", "symbol date", "target_low target_high stop", 3)
add("d07_latest_signal", lambda v: decisions.latest_signal(states(v)), "signals", f"WITH {ST} SELECT symbol, max(date) AS date, max_by(code, date) AS code, max_by(p_success, date) AS p_success FROM st GROUP BY symbol", "symbol date code", "p_success")
add("d08_scan_top_k", lambda v: decisions.scan_top_k(states(v)), "signals", f"WITH {ST}, l AS (SELECT symbol, max_by(code, date) AS code, max_by(p_success, date) AS p FROM st GROUP BY symbol) SELECT * FROM (SELECT code, symbol, row_number() OVER (PARTITION BY code ORDER BY p DESC, symbol) AS place FROM l) t WHERE place <= 5", "code symbol place")
add("d09_watchlist_alerts", lambda v: decisions.watchlist_alerts(states(v), v("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("symbol"))), "signals", f"WITH {ST} SELECT symbol, date, code, code_before FROM (SELECT *, coalesce(lag(code) OVER ({BY}), 0) AS code_before FROM st) t WHERE code <> code_before AND code <> 0 AND symbol % 3 = 0", "symbol date code code_before")
add("d09_watchlist_status", lambda v: decisions.watchlist_status(states(v), v("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("symbol"))), "signals", f"WITH {ST} SELECT s_suppkey AS symbol, max(date) AS date, max_by(code, date) AS code FROM supplier LEFT JOIN st ON symbol = s_suppkey WHERE s_suppkey % 3 = 0 GROUP BY 1", "symbol date code")
add("d10_opportunity_cards", lambda v: decisions.opportunity_cards(v("signals")), "signals", "SELECT 'REC_' || strftime(date, '%Y%m%d') || '_' || symbol AS rec_id, symbol, date, close * 1.1 AS target_low, close * 1.15 AS target_high, close * 0.95 AS stop, CAST(date + 30 AS DATE) AS due_date, 'PENDING' AS status FROM signals", "rec_id symbol date due_date status", "target_low target_high stop", 3)


def advisory(v) -> DataFrame:
    x = v("signals").select("symbol", "date", (F.col("symbol") % 5).alias("sector"), "p_success", (F.col("p_bull") / 100).alias("weight"), F.col("p_success").alias("rank_score"), F.col("p_bull").alias("momentum_score"), (F.col("symbol") % 11 / 10.0).alias("size_score"))
    return decisions.advisory_table(x, ["rank", "momentum", "size"])


add("d11_advisory", advisory, "signals", """WITH a AS (SELECT symbol, date, symbol % 5 AS sector, p_success, p_bull / 100 AS weight, [{'v': p_success - 0.5, 'part': 'rank'}, {'v': p_bull - 0.5, 'part': 'momentum'}, {'v': symbol % 11 / 10.0 - 0.5, 'part': 'size'}] AS ps FROM signals)
SELECT symbol, date, CASE WHEN p_success > 0.6 THEN 'ACCUMULATE_BUY' ELSE 'NEUTRAL_HOLD' END AS action, p_success * 100 AS confidence_pct, 100 * weight AS weight_pct, array_to_string(list_transform(list_slice(list_reverse_sort(list_filter(ps, lambda s: s.v > 0)), 1, 2), lambda s: s.part), ',') AS positive, array_to_string(list_transform(list_slice(list_sort(list_filter(ps, lambda s: s.v < 0)), 1, 2), lambda s: s.part), ',') AS negative, sum(weight) OVER (PARTITION BY date, sector) AS sector_exposure FROM a""", "symbol date action positive negative", "confidence_pct weight_pct sector_exposure", 4)
RK = "row_number() OVER (PARTITION BY date ORDER BY {c} {d}, symbol)"
PRED = "pq AS (SELECT date, symbol, asset_type, score, actual, " + ", ".join(f"{RK.format(c=c, d=d)} AS {n}" for c, d, n in (("score", "DESC", "pt"), ("actual", "DESC", "at_"), ("score", "ASC", "pb"), ("actual", "ASC", "ab"))) + ", count(*) OVER (PARTITION BY date) AS n FROM predictions)"
add("d12_top_bottom", lambda v: decisions.top_bottom(v("predictions")), "predictions", f"WITH {PRED} SELECT date, symbol, pt AS rank_top, pb AS rank_bottom FROM pq WHERE pt <= 3 OR pb <= 3", "date symbol rank_top rank_bottom")
add("d13_quota_top_k", lambda v: decisions.quota_top_k(v("predictions")), "predictions", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY date, asset_type <> 'EQUITY' ORDER BY score DESC, symbol) AS k FROM predictions), b AS (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS place FROM a WHERE asset_type = 'EQUITY' OR k <= 1) SELECT * FROM b WHERE place <= 3", "date symbol place")
add("d14_consensus_gate", lambda v: decisions.consensus_gate(v("predictions").select("date", "symbol", "asset_type", "score", F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("pass")).withColumn("score", F.col("score") + 0.05 * ((F.col("symbol") * 7 + F.col("pass") * 13) % 10))), "predictions", """WITH p AS (SELECT date, symbol, asset_type, pass, score + 0.05 * ((symbol * 7 + pass * 13) % 10) AS score FROM predictions, (SELECT unnest([0, 1, 2, 3, 4]) AS pass) u),
a AS (SELECT *, row_number() OVER (PARTITION BY date, pass, asset_type <> 'EQUITY' ORDER BY score DESC, symbol) AS k FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY date, pass ORDER BY score DESC, symbol) AS place FROM a WHERE asset_type = 'EQUITY' OR k <= 1),
c AS (SELECT date, symbol, asset_type, count(*) AS votes FROM b WHERE place <= 3 GROUP BY 1, 2, 3), d AS (SELECT *, row_number() OVER (PARTITION BY date, asset_type <> 'EQUITY' ORDER BY votes DESC, symbol) AS k FROM c), e AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY votes DESC, symbol) AS place FROM d WHERE asset_type = 'EQUITY' OR k <= 1)
SELECT date, array_to_string(list_sort(list(symbol)), ',') AS chosen, sum(votes) / 15.0 AS consensus, sum(votes) / 15.0 >= 0.6 AS confident FROM e WHERE place <= 3 GROUP BY date""", "date chosen confident", "consensus")
add("d15_card_metrics", lambda v: decisions.card_metrics(decisions.price_targets(states(v)).withColumn("target_high", F.when(F.col("symbol") % 2 == 0, F.col("target_high")))), "signals", f"WITH {TGT} SELECT symbol, date, (target_low / close - 1) * 100 AS low_pct, (coalesce(CASE WHEN symbol % 2 = 0 THEN target_high END, close * 1.095) / close - 1) * 100 AS high_pct, (stop / close - 1) * 100 AS stop_pct, greatest(20 - days_held, 1) AS days_left FROM tx", "symbol date days_left", "low_pct high_pct stop_pct", 4)

# -- evaluation -----------------------------------------------------------------------------------------------------
G = "(2 ** greatest(actual, 0) - 1)"
ND = f"nd AS (SELECT date, CASE WHEN sum(CASE WHEN at_ <= 10 THEN {G} / log2(at_ + 1) ELSE 0 END) <= 1e-8 THEN 1 ELSE sum(CASE WHEN pt <= 10 THEN {G} / log2(pt + 1) ELSE 0 END) / sum(CASE WHEN at_ <= 10 THEN {G} / log2(at_ + 1) ELSE 0 END) END AS ndcg FROM pq GROUP BY date)"
add("e01_ndcg_at_k", lambda v: evaluation.ndcg_at_k(v("predictions")), "predictions", f"WITH {PRED}, {ND} SELECT * FROM nd", "date", "ndcg", 5)
add("e02_spearman", lambda v: evaluation.spearman(v("predictions")), "predictions", "WITH r AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS p, rank() OVER (PARTITION BY date ORDER BY actual) + (count(*) OVER (PARTITION BY date, actual) - 1) / 2.0 AS a FROM predictions) SELECT date, CASE WHEN count(*) < 3 OR stddev_pop(p) = 0 OR stddev_pop(a) = 0 THEN 0 ELSE corr(p, a) END AS spearman FROM r GROUP BY date", "date", "spearman", 3)
def market_facts(v):
    return v("predictions").groupBy("date").agg((F.avg("actual") / 4).alias("market_return"), (F.stddev_pop("actual") / 20).alias("market_vol"))


SPEAR = "sp AS (SELECT date, CASE WHEN count(*) < 3 OR stddev_pop(p) = 0 OR stddev_pop(a) = 0 THEN 0 ELSE corr(p, a) END AS spearman FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS p, rank() OVER (PARTITION BY date ORDER BY actual) + (count(*) OVER (PARTITION BY date, actual) - 1) / 2.0 AS a FROM predictions) r GROUP BY date)"
add("e03_root_cause", lambda v: evaluation.root_cause(v("predictions"), market_facts(v)).withColumns({"rate": 1e6 * F.col("learning_rate")}), "predictions", f"""WITH {PRED}, {ND}, {SPEAR}, o AS (SELECT date, avg(abs(score - actual)) AS mae, stddev_pop(score - actual) AS deviation, abs(avg(actual) / 4) AS mk, stddev_pop(actual) / 20 AS mv FROM predictions GROUP BY date),
s AS (SELECT date, coalesce(stddev_pop(m) FILTER (n > 1), 0) AS sd FROM (SELECT date, asset_type, avg(abs(score - actual)) AS m, count(*) AS n FROM predictions GROUP BY 1, 2) t GROUP BY date),
k AS (SELECT *, CASE WHEN mk > 0.03 OR mv > 0.04 THEN least(1.0, mk / 0.05 + mv / 0.06) ELSE 0.10 END AS shock, CASE WHEN sd > 0.02 THEN 0.50 ELSE 0.20 END AS sector_noise FROM o JOIN s USING (date) JOIN nd USING (date) JOIN sp USING (date)),
r AS (SELECT *, greatest(0.0, 1.0 - (shock * 0.5 + sector_noise * 0.3)) * (1.0 - greatest(0.0, spearman)) AS ranking_weight FROM k)
SELECT date, mae, deviation, shock, sector_noise, ranking_weight, 1e6 * least(1e-4, greatest(1e-6, 1e-4 * ranking_weight)) AS rate, ndcg, spearman FROM r""", "date", "mae deviation shock sector_noise ranking_weight rate ndcg spearman", 4)
add("e04_topk_hits", lambda v: evaluation.topk_hits(v("predictions")), "predictions", f"WITH {PRED}, h AS (SELECT date, count(*) FILTER (pt <= 3 AND at_ <= 3) AS top_hits, count(*) FILTER (pb <= 3 AND ab <= 3) AS bottom_hits FROM pq GROUP BY date) SELECT *, list_extract([0, 10, 50, 100], top_hits + 1) + list_extract([0, 10, 50, 100], bottom_hits + 1) AS points FROM h", "date top_hits bottom_hits points")
add("e05_proximity_score", lambda v: evaluation.proximity_score(v("predictions")), "predictions", "SELECT date, symbol, CASE WHEN e <= 1 THEN 100 WHEN e <= 3 THEN 50 WHEN e <= 5 THEN 20 WHEN e <= 10 THEN 0 ELSE -50 END AS proximity FROM (SELECT *, abs(score - actual) * 100 AS e FROM predictions) t", "date symbol proximity")
add("e06_huber_proximity", lambda v: evaluation.huber_proximity(v("predictions")), "predictions", "SELECT date, avg(CASE WHEN e < 0.03 THEN 0.5 * (e / 0.03) ** 2 ELSE e / 0.03 - 0.5 END) AS huber FROM (SELECT date, abs(score - actual) AS e FROM predictions) t GROUP BY date", "date", "huber", 4)
PL = "pl AS (SELECT a.date, avg(greatest(0, 0.1 - sign(a.actual - b.actual) * (a.score - b.score))) AS pair_loss FROM predictions a JOIN predictions b ON a.date = b.date AND a.symbol < b.symbol GROUP BY 1)"
add("e07_pairwise_margin_loss", lambda v: evaluation.pairwise_margin_loss(v("predictions")), "predictions", f"WITH {PL} SELECT * FROM pl", "date", "pair_loss", 4)
add("e08_triplet_tail_loss", lambda v: evaluation.triplet_tail_loss(v("predictions")), "predictions", f"WITH {PRED}, {PL}, t AS (SELECT date, max(n) AS n, min(score) FILTER (at_ <= 3) AS wt, max(score) FILTER (at_ = 4) AS f, max(score) FILTER (ab <= 3) AS bb, min(score) FILTER (ab = 4) AS g FROM pq GROUP BY date) SELECT t.date, CASE WHEN n < 6 THEN 0 ELSE pair_loss + greatest(0, f - wt + 0.2) + greatest(0, bb - g + 0.2) END AS tail_loss FROM t LEFT JOIN pl USING (date)", "date", "tail_loss", 4)
add("e09_soft_ndcg_loss", lambda v: evaluation.soft_ndcg_loss(v("predictions")), "predictions", """WITH a AS (SELECT date, symbol, score, actual, (score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-5) AS z, count(*) OVER w AS n, row_number() OVER (PARTITION BY date ORDER BY actual, symbol) - 1 AS k, exp(score - max(score) OVER w) AS e FROM predictions WINDOW w AS (PARTITION BY date)),
s AS (SELECT i.date, i.symbol, 1 + sum(1 / (1 + exp(-x))) - 0.5 AS up, 1 + sum(1 / (1 + exp(x))) - 0.5 AS down FROM (SELECT i.date, i.symbol, least(10, greatest(-10, (j.z - i.z) / 0.1)) AS x FROM a i JOIN a j ON i.date = j.date) i GROUP BY 1, 2),
b AS (SELECT a.*, up, down, 2 ** (5.0 * k / greatest(1, n - 1)) - 1 AS gu, 2 ** (5.0 * (1 - k / greatest(1, n - 1))) - 1 AS gd FROM a JOIN s ON s.date = a.date AND s.symbol = a.symbol)
SELECT date, 0.5 * (1 - sum(gu / log2(up + 1) * (1 + 4 * exp(-0.8 * (up - 1) ** 2))) / greatest(1e-6, sum(gu / log2(n - k + 1)))) + 0.5 * (1 - sum(gd / log2(down + 1) * (1 + 4 * exp(-0.8 * (down - 1) ** 2))) / greatest(1e-6, sum(gd / log2(k + 2))))
 + sum(CASE WHEN actual <= -0.9 THEN 1 / (1 + exp(-score)) ELSE 0 END) + 0.5 * (stddev_pop(score) - 1) ** 2 + 2 * greatest(0, max(e) / sum(e) - 0.15) AS soft_loss FROM b GROUP BY date""", "date", "soft_loss", 4)
add("e10_trajectory_error", lambda v: evaluation.trajectory_error(v("predictions")), "predictions", "WITH i AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM predictions) d), x AS (SELECT * FROM predictions JOIN i USING (date)), s AS (SELECT a.date, b.i, avg(abs(a.score - b.actual)) AS e FROM x a JOIN x b ON a.symbol = b.symbol AND b.i > a.i AND b.i <= a.i + 21 GROUP BY 1, 2) SELECT date, avg(e) AS trajectory, count(*) AS steps FROM s GROUP BY date", "date steps", "trajectory", 4)
add("e11_rank_report", lambda v: evaluation.rank_report(v("predictions")), "predictions", f"WITH {PRED} SELECT date, symbol, pt AS predicted_rank, at_ AS actual_rank, pt - at_ AS rank_gap FROM pq", "date symbol predicted_rank actual_rank rank_gap")
add("e12_monthly_signal_audit", lambda v: evaluation.monthly_signal_audit(states(v), labels.forward_return(v("monthly_panel"), 1)), "signals", f"WITH {ST}, f AS (SELECT symbol, date, lead(close) OVER ({BY}) / close - 1 AS fwd FROM monthly_panel) SELECT symbol, count(*) AS calls, count(*) FILTER ((code = 1 AND fwd > 0) OR (code = -1 AND fwd < 0)) AS hits, count(*) FILTER ((code = 1 AND fwd > 0) OR (code = -1 AND fwd < 0)) * 1.0 / count(*) AS accuracy FROM st JOIN f USING (symbol, date) WHERE fwd IS NOT NULL AND code <> 0 GROUP BY symbol", "symbol calls hits", "accuracy")
add("e13_topn_vs_universe", lambda v: evaluation.topn_vs_universe(v("predictions")), "predictions", f"WITH {PRED} SELECT date, avg(actual) FILTER (pt <= 10) AS top_mean, avg(actual) AS universe_mean, avg(actual) FILTER (pt <= 10) - avg(actual) AS spread FROM pq GROUP BY date", "date", "top_mean universe_mean spread", 4)
add("e14_noise_sensitivity", lambda v: evaluation.noise_sensitivity(v("predictions")))
PR = "pf AS (SELECT portfolio, step, sum(weight * coalesce(ret, 0)) AS ret, avg(coalesce(ret, 0)) AS bm_ret FROM weights GROUP BY 1, 2)"
add("e15_portfolio_return", lambda v: evaluation.portfolio_return(v("weights")), "weights", f"WITH {PR} SELECT * FROM pf", "portfolio step", "ret bm_ret", 5)
TO = "so AS (SELECT portfolio, step, lead(step) OVER (PARTITION BY portfolio ORDER BY step) AS nx FROM (SELECT DISTINCT portfolio, step FROM weights) d), tr AS (SELECT portfolio, step, sum(abs(w - b)) AS turnover FROM (SELECT portfolio, step, symbol, sum(w) AS w, sum(b) AS b FROM (SELECT portfolio, step, symbol, weight AS w, 0 AS b FROM weights UNION ALL SELECT w.portfolio, nx, symbol, 0, weight FROM weights w JOIN so ON so.portfolio = w.portfolio AND so.step = w.step WHERE nx IS NOT NULL) u GROUP BY 1, 2, 3) z GROUP BY 1, 2)"
add("e16_turnover", lambda v: evaluation.turnover(v("weights")), "weights", f"WITH {TO} SELECT * FROM tr", "portfolio step", "turnover")
add("e17_trade_costs", lambda v: evaluation.trade_costs(v("weights"), risk.penalties(v("daily_bars"))), "weights", f"WITH {TO}, {PEN} SELECT w.portfolio, w.step, sum(weight * weight * coalesce(impact, 0)) AS impact_cost, sum(abs(weight * coalesce(settlement, 0))) * 1e6 AS settlement_cost, 0.002 * max(turnover) AS turnover_cost FROM weights w LEFT JOIN pn ON pn.symbol = w.symbol JOIN tr ON tr.portfolio = w.portfolio AND tr.step = w.step GROUP BY 1, 2", "portfolio step", {"impact_cost": 3, "settlement_cost": 3, "turnover_cost": 6})
NV = f"{PR}, nv AS (SELECT *, CASE WHEN max(CASE WHEN ret <= -1 THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(ln(1 + CASE WHEN ret > -1 THEN ret ELSE 0 END)) OVER w) END AS nav, CASE WHEN max(CASE WHEN bm_ret <= -1 THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(ln(1 + CASE WHEN bm_ret > -1 THEN bm_ret ELSE 0 END)) OVER w) END AS bm_nav FROM pf WINDOW w AS (PARTITION BY portfolio ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
add("e18_nav_curve", lambda v: evaluation.nav_curve(evaluation.portfolio_return(v("weights"))).select("portfolio", "step", F.log10("nav").alias("log_nav"), F.log10("bm_nav").alias("log_bm")), "weights", f"WITH {NV} SELECT portfolio, step, log10(nav) AS log_nav, log10(bm_nav) AS log_bm FROM nv", "portfolio step", "log_nav log_bm", 5)
add("e19_portfolio_stats", lambda v: evaluation.portfolio_stats(evaluation.portfolio_return(v("weights"))), "weights", f"WITH {NV}, x AS (SELECT *, 1 - nav / greatest(max(nav) OVER (PARTITION BY portfolio ORDER BY step), 1) AS dd FROM nv), s AS (SELECT portfolio, max(dd) AS max_drawdown, avg(ret) AS m, stddev_samp(ret) AS s, max_by(nav, step) AS nav, max_by(bm_nav, step) AS bm, count(*) AS n FROM x GROUP BY 1) SELECT portfolio, max_drawdown, CASE WHEN s > 1e-12 THEN m / s * sqrt(12) ELSE 0 END AS sharpe, nav ** (12.0 / n) - 1 AS cagr, nav ** (12.0 / n) - bm ** (12.0 / n) AS alpha FROM s", "portfolio", {"max_drawdown": 5, "sharpe": 5, "cagr": 2, "alpha": 2})
add("e20_weight_limits_check", lambda v: evaluation.weight_limits_check(v("weights")), "weights", "SELECT portfolio, step, symbol, 'box' AS rule, weight AS value FROM weights WHERE weight > 0.35 UNION ALL SELECT portfolio, step, symbol, 'long only', weight FROM weights WHERE weight < 0 UNION ALL SELECT portfolio, step, NULL, 'budget', sum(weight) FROM weights GROUP BY 1, 2 HAVING abs(sum(weight) - 1) > 1e-6", "portfolio step symbol rule", "value")
CAPS = "caps(sector, least, most) AS (VALUES (0, 0.05, 0.30), (1, 0.00, 0.25), (2, 0.22, 1.00), (3, 0.10, 0.40))"
LIMITS = f"""WITH {CAPS}, w AS (SELECT portfolio, step, symbol, symbol % 4 AS sector, weight FROM weights),
st AS (SELECT portfolio, step, lead(step) OVER (PARTITION BY portfolio ORDER BY step) AS after FROM (SELECT DISTINCT portfolio, step FROM w) x),
g AS (SELECT st.portfolio, st.step, caps.sector, coalesce(sum(weight), 0) AS value, max(least) AS least, max(most) AS most FROM st CROSS JOIN caps LEFT JOIN w ON w.portfolio = st.portfolio AND w.step = st.step AND w.sector = caps.sector GROUP BY 1, 2, 3),
mv AS (SELECT portfolio, step, symbol, weight FROM w UNION ALL SELECT st.portfolio, st.after, symbol, -weight FROM st JOIN w ON w.portfolio = st.portfolio AND w.step = st.step WHERE st.after IS NOT NULL),
tn AS (SELECT portfolio, step, sum(abs(d)) AS value FROM (SELECT portfolio, step, symbol, sum(weight) AS d FROM mv GROUP BY 1, 2, 3) y WHERE step > (SELECT min(step) FROM st WHERE st.portfolio = y.portfolio) GROUP BY 1, 2)
SELECT portfolio, step, symbol, NULL AS sector, 'box' AS rule, weight AS value FROM w WHERE weight > 0.12
UNION ALL SELECT portfolio, step, NULL, sector, 'group max', value FROM g WHERE value > most + 1e-9
UNION ALL SELECT portfolio, step, NULL, sector, 'group min', value FROM g WHERE value < least - 1e-9
UNION ALL SELECT portfolio, step, NULL, NULL, 'turnover', value FROM tn WHERE value > 0.9 + 1e-9"""


def limits_violated(v) -> DataFrame:
    caps = v.spark.createDataFrame([(0, 0.05, 0.30), (1, 0.00, 0.25), (2, 0.22, 1.00), (3, 0.10, 0.40)], "sector long, least double, most double")
    w = v("weights").withColumn("sector", F.col("symbol") % 4)
    box = evaluation.weight_limits_check(w, most=0.12).where("rule <> 'budget'").withColumn("sector", F.lit(None).cast("long"))
    return box.unionByName(evaluation.group_limits_check(w, caps, "sector")).unionByName(evaluation.turnover_check(w, 0.9).withColumn("sector", F.lit(None).cast("long")))


add("e20_weight_limits_caps", limits_violated, "weights", LIMITS, "portfolio step symbol sector rule", "value")
add("e21_run_stats", lambda v: evaluation.run_stats(v("weights")), "weights", "SELECT portfolio, step, count(*) FILTER (abs(weight) > 1e-6) AS active, max(weight) AS max_weight, min(weight) AS min_weight, sum(weight) AS total FROM weights GROUP BY 1, 2", "portfolio step active", "max_weight min_weight total")
add("e22_classification_metrics", lambda v: evaluation.classification_metrics(states(v).withColumn("predicted", F.when(F.col("p_success") >= 0.5, 1).otherwise(-1)).withColumn("label", F.col("code"))), "signals", f"WITH {ST} SELECT avg(CASE WHEN code = CASE WHEN p_success >= 0.5 THEN 1 ELSE -1 END THEN 1.0 ELSE 0 END) AS accuracy, min(p_success) AS p_min, max(p_success) AS p_max, stddev_pop(p_success) AS p_std, count(DISTINCT symbol) AS n_symbols, count(*) AS n_rows FROM st", "n_symbols n_rows", "accuracy p_min p_max p_std")

# -- models ---------------------------------------------------------------------------------------------------------
def training_table(v) -> tuple[DataFrame, DataFrame]:
    """Ranked features, labels and weights of the daily bars: train and test rows of the purged split.

    The table is written once: each fit reads it several times, and computing it takes windows over the whole panel.
    """
    x = technical.moving_stats(technical.rsi_simple(technical.atr(v("daily_bars")))).withColumn("rsi", F.col("rsi_simple"))
    x = crosssec.pct_rank_min(x, ["zscore_price", "zscore_volume", "rsi", "atr"])
    rows = labels.sample_weights(labels.date_uniqueness(labelled(v))).select("symbol", "date", "label", "weight")
    x = x.join(rows, ["symbol", "date"]).select("symbol", "date", "label", "weight", *[f"{c}_ranked" for c in ("zscore_price", "zscore_volume", "rsi", "atr")])
    x = pit.purged_split(x)
    x = stored(v, x.where("split in ('train', 'test')"))
    return x.where("split = 'train'").drop("split"), x.where("split = 'test'").drop("split")


def scored_panel(v) -> DataFrame:
    train, test = training_table(v)
    direction = ml.train_direction(train)
    return ml.score_panel(test, direction, ml.train_meta(train, direction))


add("ml01_ml02_ml05_score_panel", lambda v: scored_panel(v).select("symbol", "date", "label", "predicted", "p_bear", "p_neutral", "p_bull", "p_success"))


def calibrated(v) -> DataFrame:
    scored = scored_panel(v).withColumn("right", (F.col("predicted") == F.col("label")).cast("double"))
    fold = F.pmod(F.xxhash64("symbol", "date"), F.lit(2)) == 0
    curve = ml.calibrate(scored.where(fold), "p_raw", "right")
    return ml.rescale_probability(curve.transform(scored.where(~fold)).withColumn("p_cal", ml.vector_to_array("calibrated_p")[1]), "p_cal").select("symbol", "date", "p_raw", "p_cal", "p_success")


add("ml03_ml04_calibrated", calibrated)
add("ml04_rescale_probability", lambda v: ml.rescale_probability(v("predictions"), "score"), "predictions", "SELECT date, symbol, 0.15 + (score - lo) / (hi - lo) * 0.7 AS p_success FROM predictions, (SELECT min(score) AS lo, max(score) AS hi FROM predictions) e", "date symbol", "p_success")


def champion(v) -> DataFrame:
    train, test = training_table(v)
    return ml.champion_challenger(test, {"champion": ml.train_direction(train, trees=5, depth=3), "challenger": ml.train_direction(train, trees=10, depth=4)})


add("ml06_champion_challenger", champion)
add("ml07_per_asset_model", lambda v: ml.per_asset_model(v("predictions"), ["score"], "actual", ridge=0.0 + 1e-3), "predictions", "SELECT symbol, n, (sy * (sxx + 1e-3) - sx * sxy) / ((n + 1e-3) * (sxx + 1e-3) - sx * sx) AS intercept, ((n + 1e-3) * sxy - sx * sy) / ((n + 1e-3) * (sxx + 1e-3) - sx * sx) AS w_score FROM (SELECT symbol, count(*) AS n, sum(score) AS sx, sum(actual) AS sy, sum(score * score) AS sxx, sum(score * actual) AS sxy FROM predictions GROUP BY 1) t", "symbol n", "intercept w_score", 4)

# -- sources and streams --------------------------------------------------------------------------------------------
def folder(v) -> str:
    """A new folder that executors share: under spark.checkpoint.dir, or a temporary one on a single machine."""
    root = v.spark.conf.get("spark.checkpoint.dir", None)
    if not root and v.spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or tempfile.mkdtemp(prefix="spark-panel-")
    return f"{root.rstrip('/')}/panel-{uuid.uuid4().hex}"


def stored(v, df: DataFrame) -> DataFrame:
    """The table read back from a new folder."""
    path = folder(v)
    df.write.parquet(path)
    return v.spark.read.schema(df.schema).parquet(path)


def stored_panel(v) -> DataFrame:
    path = folder(v)
    io.write_panel(v("daily_bars"), path)
    return io.read_panel(v.spark, path, io.PANEL + ", year int")


def written_panel(v) -> DataFrame:
    return stored_panel(v)


def bucketed_panel(v) -> DataFrame:
    """Log returns over a bucketed table, whose windows need no shuffle."""
    name = f"panel_{uuid.uuid4().hex}"
    io.write_bucketed(v("daily_bars").select("symbol", "date", "close"), name, 8, folder(v))
    return risk.log_returns(v.spark.table(name))


# pruning is the feature: whole years by folder, then the date inside the files
add("s01_read_panel_pruned", lambda v: stored_panel(v).where("year >= 1996 and date >= '1996-01-01'").groupBy("asset_type").agg(F.count("*").alias("n"), F.sum("close").alias("total")), "daily_bars", "SELECT asset_type, count(*) AS n, sum(close) AS total FROM daily_bars WHERE date >= DATE '1996-01-01' GROUP BY asset_type", "asset_type n", "total", 2)

add("s02_write_panel", written_panel, "daily_bars", "SELECT symbol, date, close, volume FROM daily_bars", "symbol date", "close volume", 8)
add("s01_s02_bucketed_panel", bucketed_panel, "daily_bars", "SELECT * FROM (SELECT symbol, date, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS ret FROM daily_bars) t WHERE ret IS NOT NULL", "symbol date", "ret")


def written_metrics(v) -> DataFrame:
    path = folder(v)
    x = v("events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("event"), F.create_map(F.lit("value"), F.col("value")).alias("metrics"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"))
    io.append_metrics(x.where("event <> 'view'"), path)
    io.append_metrics(x.where("event = 'view'"), path)
    return io.read_metrics(v.spark, path).groupBy("event").agg(F.count("*").alias("n"), F.sum(F.col("metrics")["value"]).alias("total"))


add("s03_metrics_jsonl", written_metrics, "", "SELECT event_type AS event, count(*) AS n, sum(value) AS total FROM events GROUP BY 1", "event n", "total", 2)


def written_signals(v) -> DataFrame:
    path = folder(v)
    for part in ("symbol % 2 = 0", "symbol % 2 = 1"):
        io.append_signals(states(v).where(part), path)
    return v.spark.read.parquet(path)


add("s04_append_signals", written_signals, "signals", f"WITH {ST} SELECT symbol, date, code FROM st", "symbol date code")


def replay(v, source: DataFrame, build, files: int | None = None, order: str | None = None, mode: str = "append") -> DataFrame:
    """Rows that a streaming query makes of a bounded source: written as files, read as a stream, all available at once.

    Every task writes its own files. With an order they come in `files` steps of time, and the stream runs once for each.
    """
    path = folder(v)
    if not order:
        source.write.parquet(f"{path}/in")
        stream = v.spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1000).parquet(f"{path}/in")
        return written(v, build(stream), path, mode)
    at = source.select(F.percentile_approx(F.unix_date(F.to_date(order)), F.array(*[F.lit(k / files) for k in range(1, files)])).alias("q"))
    part = F.size(F.filter("q", lambda q: q < F.unix_date(F.to_date(order))))
    return fed(v, source.join(F.broadcast(at)).withColumn("_part", part).drop("q"), "_part", range(files), build, path, mode)


def fed(v, placed: DataFrame, part: str, steps, build, path: str, mode: str = "append") -> DataFrame:
    """What a stream makes of rows that a feed brings step by step: dealt into folders once, then one run a step."""
    schema = placed.drop(part).schema
    placed.write.partitionBy(part).parquet(f"{path}/placed")
    out, result, dealt = None, None, v.spark.read.schema(placed.schema).parquet(f"{path}/placed")
    for k in steps:
        dealt.where(F.col(part) == k).drop(part).write.mode("append").parquet(f"{path}/in")
        out = out or build(v.spark.readStream.schema(schema).parquet(f"{path}/in"))
        result = written(v, out, path, mode)
    return result


STORE = "spark.sql.streaming.stateStore.providerClass"


def written(v, out: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """What a streaming DataFrame gives when all that is there has been read; state is kept in RocksDB meanwhile."""
    before = v.spark.conf.get(STORE)
    v.spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).format("parquet").option("path", f"{path}/out").start().awaitTermination()
    finally:
        v.spark.conf.set(STORE, before)
    return v.spark.read.schema(out.schema).parquet(f"{path}/out")


def closing(df: DataFrame, ts: str, fill: dict) -> DataFrame:
    """The rows and one far later, of its own key, whose time closes every window of the others."""
    last = df.limit(1).select(*[fill[c].cast(t).alias(c) if c in fill else F.col(c) for c, t in df.dtypes])
    return df.unionByName(last)


FAR = "2100-01-01 00:00:00"


def ticks(v) -> DataFrame:
    return v("events").select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), (1 + F.col("event_id") % 97).cast("double").alias("volume"))


def sentinel(v) -> DataFrame:
    base = ticks(v)
    latest = v("intraday_bars").groupBy("symbol").agg(F.min("low").alias("stop"), F.avg("price").alias("prev_close")).withColumn("atr", F.col("prev_close") * 0.3).withColumn("stop", F.col("stop") * 1.01)
    return replay(v, base, lambda s: streams.gap_sentinel(s, latest))


add("st01_gap_sentinel", sentinel, "intraday_bars", "WITH l AS (SELECT symbol, min(low) * 1.01 AS stop, avg(price) AS pc FROM intraday_bars GROUP BY 1) SELECT user_id AS symbol, ts, value AS price, CASE WHEN value <= stop THEN 'STOP' ELSE 'GAP' END AS alert FROM events JOIN l ON symbol = user_id WHERE value <= stop OR value / pc - 1 <= -greatest(1.8 * pc * 0.3 / pc, 0.04)", "symbol alert", "price", 4)


def bars(v) -> DataFrame:
    src = closing(ticks(v), "ts", {"symbol": F.lit(-1), "ts": F.lit(FAR)})
    return replay(v, src, streams.stream_bars, 4, "ts").where("symbol >= 0")


add("st02_stream_bars", bars, "", "SELECT user_id AS symbol, time_bucket(INTERVAL '15 minutes', ts) AS ts, min_by(value, struct_pack(t := ts, v := value)) AS open, max(value) AS high, min(value) AS low, max_by(value, struct_pack(t := ts, v := value)) AS close, sum(1 + event_id % 97) AS volume FROM events GROUP BY 1, 2", "symbol", "open high low close volume", 4)


def lock_stream(v) -> DataFrame:
    src = v("daily_bars").select("symbol", "asset_type", "date")
    cut = (F.lit("1997-06-30").cast("date"), F.lit("1997-06-29").cast("date"))
    path = folder(v)
    src.write.parquet(f"{path}/in")
    sides = []
    for k in range(2):
        stream = v.spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1000).parquet(f"{path}/in")
        sides.append(written(v, streams.stream_temporal_lock(stream, *cut, ts="date")[k], f"{path}/{k}").withColumn("kept", F.lit(k == 0)))
    return sides[0].unionByName(sides[1])


add("st03_stream_temporal_lock", lock_stream, "daily_bars", "SELECT symbol, asset_type, date, date <= CASE WHEN asset_type IN ('TEFAS_FREE', 'TEFAS_LIQUID') THEN DATE '1997-06-29' ELSE DATE '1997-06-30' END AS kept FROM daily_bars", "symbol asset_type date kept")


def late_signals(v) -> DataFrame:
    """Daily decisions of a feed that brings a third of its rows a batch late, and one row far ahead that ends the wait."""
    x = v("signals").select(F.col("symbol").cast("long").alias("symbol"), "date", "close", "atr", "p_success")
    x = closing(x, "date", {"symbol": F.lit(-1), "date": F.lit("2100-01-01")})
    # a step a year; of each year a third comes with the next one
    batch = F.least(F.year("date") + F.when((F.col("symbol") > -1) & (F.hash("symbol", "date") % 3 == 0), 1).otherwise(0), F.lit(2100))
    first, last = x.where("symbol > -1").agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    return fed(v, x.withColumn("_part", batch), "_part", [*range(first, last + 2), 2100], lambda s: streams.stream_eod_state(s, "800 days"), folder(v))


add("st04_stream_eod_state", late_signals, "signals", f"WITH {ST} SELECT symbol, date, code, days_held, p_prev FROM st", "symbol date code days_held", "p_prev")


def watched(v) -> DataFrame:
    """Ticks and daily signals (yesterday's lowest and last price of each symbol) as two streams."""
    base = closing(ticks(v).select("symbol", "ts", "price"), "ts", {"symbol": F.lit(-1), "ts": F.lit(FAR)})
    days = v("intraday_bars").groupBy("symbol", F.to_date("ts").alias("day")).agg(F.min("low").alias("low"), F.max_by("price", "ts").alias("prev_close"))
    signals = days.select("symbol", F.date_add("day", 1).cast("timestamp").alias("ts"), (F.col("low") * 1.01).alias("stop"), (F.col("prev_close") * 0.3).alias("atr"), "prev_close")
    signals = closing(signals, "ts", {"symbol": F.lit(-1), "ts": F.lit(FAR)})
    path = folder(v)
    base.repartition(3).write.parquet(f"{path}/ticks")
    signals.write.parquet(f"{path}/signals")
    read = lambda df, name: v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1000).parquet(f"{path}/{name}")
    return written(v, streams.stream_gap_sentinel(read(base, "ticks"), read(signals, "signals")), path)


add("st01_streamed_signals", watched, "intraday_bars", """WITH s AS (SELECT symbol, CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) AS t, min(low) * 1.01 AS stop, max_by(price, ts) AS pc FROM intraday_bars GROUP BY 1, 2)
SELECT user_id AS symbol, ts, value AS price, CASE WHEN value <= stop THEN 'STOP' ELSE 'GAP' END AS alert FROM events e ASOF JOIN s ON s.symbol = e.user_id AND e.ts >= s.t WHERE value <= stop OR value / pc - 1 <= -greatest(1.8 * 0.3, 0.04)""", "symbol alert", "price", 4)


def appended(v) -> DataFrame:
    src = v("signals").select("symbol", F.col("date").cast("timestamp").alias("ts"), "p_success")
    path = folder(v)
    src.unionByName(src).repartitionByRange(2, "ts").write.parquet(f"{path}/in")
    stream = v.spark.readStream.schema(src.schema).parquet(f"{path}/in")
    streams.stream_signal_append(stream, f"{path}/out", f"{path}/ck", "4000 days").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(f"{path}/out").select("symbol", F.to_date("ts").alias("date"), "p_success")


add("st05_stream_signal_append", appended, "signals", "SELECT symbol, date, p_success FROM signals", "symbol date", "p_success")


def imbalance(v) -> DataFrame:
    levels = v("book_levels").select("ticker", F.col("ts").cast("timestamp").alias("ts"), "side", "volume")
    return replay(v, closing(levels, "ts", {"ticker": F.lit(-1), "ts": F.lit(FAR)}), streams.stream_imbalance, 4, "ts").where("ticker >= 0").groupBy("ticker").agg(F.count("*").alias("windows"), F.sum("obi").alias("total"))


add("st06_stream_imbalance", imbalance, "book_levels", "WITH x AS (SELECT ticker, side, volume, time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes' * k AS w FROM book_levels, (SELECT unnest([0, 1, 2, 3]) AS k) u), y AS (SELECT ticker, w, sum(CASE WHEN side = 'BID' THEN volume ELSE 0 END) AS b, sum(CASE WHEN side = 'ASK' THEN volume ELSE 0 END) AS a FROM x GROUP BY 1, 2) SELECT ticker, count(*) AS windows, sum(CASE WHEN a + b > 0 THEN (b - a) / (a + b) ELSE 0 END) AS total FROM y GROUP BY 1", "ticker windows", "total", 5)


def metrics(v) -> DataFrame:
    src = v("events").select(F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return replay(v, closing(src, "ts", {"event": F.lit("~"), "ts": F.lit(FAR)}), streams.stream_metrics, 4, "ts").where("event <> '~'").withColumn("day", F.to_date("ts"))


add("st07_stream_metrics", metrics, "", "SELECT event_type AS event, CAST(ts AS DATE) AS day, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY 1, 2", "event day n", "mean_value", 4)
