"""Queries for ingest, point-in-time, risk, technical and factor operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.cuts import cut
from tidepanel.operators import crosssec, factors, ingest, labels, pit, risk, technical
from tidepanel.plans.registry import add
from tidepanel.plans.views import dealt_as_bars

NAV = "asset_type IN ('TEFAS_FREE', 'TEFAS_LIQUID')"
SNAP, NAVCUT = "DATE '1997-06-30'", "DATE '1997-06-29'"
def snap():
    return F.lit("1997-06-30").cast("date")


def navcut():
    return F.lit("1997-06-29").cast("date")


LOCK = f"((NOT {NAV} AND date <= {SNAP}) OR ({NAV} AND date <= {NAVCUT}))"
BY = "PARTITION BY symbol ORDER BY date"


def last(n: int) -> str:
    return f"({BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(expr: str, arg: str, n: int, least: int) -> str:
    return f"CASE WHEN count({arg}) OVER {last(n)} >= {least} THEN {expr} OVER {last(n)} END"


RET = f"SELECT *, close / lag(close) OVER ({BY}) - 1 AS r, ln(close / lag(close) OVER ({BY})) AS lr"

# -- ingest ---------------------------------------------------------------------------------------------------------
add("s05_watchlist", lambda v: ingest.watchlist_remove(ingest.watchlist_add(v("nation").where("n_regionkey < 2").select(F.col("n_name").alias("ticker")), v("nation").where("n_regionkey < 4").select(F.lower("n_name").alias("ticker"))), v("nation").where("n_nationkey % 5 = 0").select(F.col("n_name").alias("ticker"))), "", "SELECT upper(n_name) AS ticker FROM nation WHERE n_regionkey < 4 AND n_nationkey % 5 <> 0", "ticker")
def wide_long(v):
    x = v("monthly_panel")
    return ingest.tiles_to_long(*ingest.long_to_tiles(x, "date", "symbol", "close"), "date", "symbol", "close").select("date", F.col("symbol").cast("long").alias("symbol"), "close")


add("s06_wide_long", wide_long, "monthly_panel", "SELECT date, CAST(symbol AS BIGINT) AS symbol, close FROM monthly_panel", "date symbol", "close", 8)
add("s07_align_panels", lambda v: ingest.align_panels(v("monthly_panel").select("symbol", "date", F.col("close").alias("a")), v("monthly_panel").select("symbol", F.add_months("date", 1).alias("date"), F.col("volume").alias("b")), ["symbol", "date"]), "monthly_panel", "SELECT coalesce(x.symbol, y.symbol) AS symbol, coalesce(x.date, y.date) AS date, a, b FROM (SELECT symbol, date, close AS a FROM monthly_panel) x FULL JOIN (SELECT symbol, CAST(date + INTERVAL 1 MONTH AS DATE) AS date, volume AS b FROM monthly_panel) y ON x.symbol = y.symbol AND x.date = y.date", "symbol date", "a b", 8)
add("s08_fill_calendar", lambda v: ingest.fill_calendar(v("monthly_panel"), ["close", "volume"], backward=True), "monthly_panel", """WITH g AS (SELECT s.symbol, d.date, p.close, p.volume FROM (SELECT DISTINCT symbol FROM monthly_panel) s CROSS JOIN (SELECT DISTINCT date FROM monthly_panel) d
LEFT JOIN monthly_panel p ON p.symbol = s.symbol AND p.date = d.date)
SELECT symbol, date, coalesce(last_value(close IGNORE NULLS) OVER a, first_value(close IGNORE NULLS) OVER b) AS close, coalesce(last_value(volume IGNORE NULLS) OVER a, first_value(volume IGNORE NULLS) OVER b) AS volume
FROM g WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", "symbol date", "close volume", 8)
add("s09_dedupe_keep_first", lambda v: ingest.dedupe_keep_first(v("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]), "", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) t WHERE n = 1", "l_orderkey l_linenumber l_partkey l_suppkey", "l_quantity l_extendedprice", 2)
_BAD = "CASE WHEN symbol % 17 = 0 THEN -close ELSE close END AS close, CASE WHEN symbol % 13 = 0 THEN NULL WHEN symbol % 11 = 0 THEN -volume ELSE volume END AS volume, auction_volume, settlement_days - CASE WHEN symbol % 7 = 0 THEN 2 ELSE 0 END AS settlement_days, CASE WHEN symbol % 19 = 0 THEN 'BOND' ELSE asset_type END AS asset_type"
add("s10_validate_points", lambda v: ingest.validate_points(v("daily_bars").selectExpr("symbol", "date", *[x.strip() for x in ["CASE WHEN symbol % 17 = 0 THEN -close ELSE close END AS close", "CASE WHEN symbol % 13 = 0 THEN NULL WHEN symbol % 11 = 0 THEN -volume ELSE volume END AS volume", "auction_volume", "settlement_days - CASE WHEN symbol % 7 = 0 THEN 2 ELSE 0 END AS settlement_days", "CASE WHEN symbol % 19 = 0 THEN 'BOND' ELSE asset_type END AS asset_type"]])).groupBy("reason").agg(F.count("*").alias("n")), "daily_bars", f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN close <= 0 THEN 'price' WHEN volume < 0 THEN 'volume' WHEN auction_volume < 0 THEN 'auction volume'
WHEN settlement_days < 0 THEN 'settlement days' WHEN asset_type = 'BOND' THEN 'asset type' END AS reason FROM (SELECT symbol, date, {_BAD} FROM daily_bars) a) b GROUP BY reason""", "reason n")
add("s11_apply_defaults", lambda v: ingest.apply_defaults(v("daily_bars").selectExpr("symbol", "date", "asset_type", "CAST(close AS STRING) AS close", "CASE WHEN symbol % 3 = 0 THEN NULL ELSE volume END AS volume", "CAST(NULL AS DOUBLE) AS auction_volume", "CASE WHEN symbol % 2 = 0 THEN NULL ELSE settlement_days END AS settlement_days")), "daily_bars", "SELECT symbol, date, asset_type, close, CASE WHEN symbol % 3 = 0 THEN 0 ELSE volume END AS volume, 0 AS auction_volume, CASE WHEN symbol % 2 = 0 THEN CASE asset_type WHEN 'EQUITY' THEN 2 WHEN 'TEFAS_LIQUID' THEN 0 ELSE 1 END ELSE settlement_days END AS settlement_days FROM daily_bars", "symbol date asset_type settlement_days", "close volume auction_volume", 8)
add("s12_resample_month_end", lambda v: ingest.resample_month_end(v("daily_bars")), "daily_bars", """WITH m AS (SELECT symbol, last_day(date) AS date, max_by(close, date) AS close FROM daily_bars GROUP BY symbol, last_day(date)),
g AS (SELECT s.symbol, d.date, m.close FROM (SELECT DISTINCT symbol FROM m) s CROSS JOIN (SELECT DISTINCT date FROM m) d LEFT JOIN m ON m.symbol = s.symbol AND m.date = d.date)
SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM g""", "symbol date", "close", 8)
add("s13_first_row_per_month", lambda v: ingest.first_row_per_month(v("daily_bars")), "daily_bars", "SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS date, min_by(close, date) AS close FROM daily_bars GROUP BY 1, 2", "symbol month date", "close", 8)
add("s14_emit_json", lambda v: ingest.emit_json(v("region").select("r_regionkey", "r_name").withColumn("share", F.col("r_regionkey") / 8.0), {"share": 3}), "", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\",\"share\":' || CAST(round(r_regionkey / 8.0, 3) AS DOUBLE) || '}' AS json FROM region", "json")
add("s15_dataset_profile", lambda v: ingest.dataset_profile(v("daily_bars")), "daily_bars", "SELECT count(DISTINCT symbol) AS n_symbols, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows FROM daily_bars", "n_symbols first_date last_date n_rows")

# -- point in time --------------------------------------------------------------------------------------------------
add("p01_temporal_lock", lambda v: pit.temporal_lock(v("daily_bars"), snap(), navcut()).select("symbol", "date", "asset_type"), "daily_bars", f"SELECT symbol, date, asset_type FROM daily_bars WHERE {LOCK}", "symbol date asset_type")
add("p02_lock_audit", lambda v: pit.lock_audit(v("daily_bars"), snap(), navcut()), "daily_bars", f"SELECT count(*) AS checked, count(*) FILTER (NOT {LOCK}) AS filtered, count(*) FILTER (NOT {LOCK} AND NOT {NAV}) AS intraday_violations, count(*) FILTER (NOT {LOCK} AND {NAV}) AS nav_violations, count(*) FILTER (NOT {LOCK}) > 0 AS has_violations FROM daily_bars", "checked filtered intraday_violations nav_violations has_violations")
add("p03_lock_violations", lambda v: pit.lock_violations(v("daily_bars"), snap(), navcut()), "daily_bars", f"SELECT symbol, asset_type, date, CASE WHEN {NAV} THEN {NAVCUT} ELSE {SNAP} END AS cutoff, CASE WHEN {NAV} THEN 'after nav cutoff' ELSE 'after snapshot' END AS reason FROM daily_bars WHERE NOT {LOCK}", "symbol asset_type date cutoff reason")
add("p04_assert_snapshot", lambda v: pit.assert_snapshot(pit.temporal_lock(v("daily_bars"), snap(), navcut()), snap(), navcut()).groupBy("asset_type").agg(F.count("*").alias("n")), "daily_bars", f"SELECT asset_type, count(*) AS n FROM daily_bars WHERE {LOCK} GROUP BY asset_type", "asset_type n")
add("p05_multi_snapshot", lambda v: pit.multi_snapshot(v("daily_bars"), v("daily_bars").where("dayofweek(date) = 6").select(F.col("date").alias("snapshot_time"), F.date_sub("date", 1).alias("nav_cutoff")).distinct(), 28).groupBy("snapshot_time", "asset_type").agg(F.count("*").alias("n"), F.sum("close").alias("total")), "daily_bars", f"SELECT s.t AS snapshot_time, asset_type, count(*) AS n, sum(close) AS total FROM daily_bars b JOIN (SELECT DISTINCT date AS t FROM daily_bars WHERE isodow(date) = 5) s ON b.date > s.t - 28 AND b.date <= CASE WHEN {NAV} THEN s.t - 1 ELSE s.t END GROUP BY 1, 2", "snapshot_time asset_type n", "total", 2)
add("p06_p07_visible_as_of", lambda v: pit.visible_as_of(pit.knowledge_lag(v("daily_bars").select("symbol", "date", "close")), v("monthly_panel").select("symbol", F.last_day("date").alias("probe_ts")), ["close", "date"]).select("symbol", "probe_ts", "close", F.col("date").alias("fact_date")), "monthly_panel", "SELECT m.symbol, last_day(m.date) AS probe_ts, max_by(b.close, b.date) AS close, max(b.date) AS fact_date FROM monthly_panel m LEFT JOIN daily_bars b ON b.symbol = m.symbol AND b.date + 2 <= last_day(m.date) GROUP BY 1, 2", "symbol probe_ts fact_date", "close", 8)
add("p08_post_listing_filter", lambda v: pit.post_listing_filter(v("daily_bars")).groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first")), "daily_bars", f"SELECT symbol, count(*) AS n, min(date) AS first FROM (SELECT *, row_number() OVER ({BY}) AS k FROM daily_bars) t WHERE k > 60 GROUP BY symbol", "symbol n first")
add("p09_exclude_delisted", lambda v: pit.exclude_delisted(v("customer").select("c_name", "c_mktsegment"), "c_mktsegment", "AUTO").groupBy("c_mktsegment").agg(F.count("*").alias("n")), "", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment NOT LIKE 'AUTO%' GROUP BY 1", "c_mktsegment n")
add("p10_coverage_guard", lambda v: pit.coverage_guard(v("monthly_panel"), v("supplier").select(F.col("s_suppkey").alias("symbol")), 0.9).select("date", "matched", "expected", "coverage", "passed", F.size("missing").cast("long").alias("n_missing")), "monthly_panel", "SELECT date, count(DISTINCT symbol) AS matched, n AS expected, count(DISTINCT symbol) * 1.0 / n AS coverage, count(DISTINCT symbol) * 1.0 / n >= 0.9 AS passed, n - count(DISTINCT symbol) AS n_missing FROM monthly_panel JOIN supplier ON s_suppkey = symbol, (SELECT count(*) AS n FROM supplier) u GROUP BY date, n", "date matched expected passed n_missing", "coverage")
add("p11_purged_split", lambda v: pit.purged_split(v("daily_bars")).groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")), "daily_bars", "WITH d AS (SELECT date, count(*) OVER () - row_number() OVER (ORDER BY date) + 1 AS back FROM (SELECT DISTINCT date FROM daily_bars) x) SELECT CASE WHEN back <= 252 THEN 'test' WHEN back <= 273 THEN 'embargo' WHEN back <= 525 THEN 'val' WHEN back <= 546 THEN 'embargo' ELSE 'train' END AS split, count(*) AS n, min(date) AS first, max(date) AS last FROM daily_bars JOIN d USING (date) GROUP BY 1", "split n first last")
add("p12_walk_forward_schedule", lambda v: pit.walk_forward_schedule(v("daily_bars")), "daily_bars", "WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM daily_bars) x), e AS (SELECT *, lag(date, 21) OVER (ORDER BY i) AS train_end, lead(date, 21) OVER (ORDER BY i) AS realize_date, least(504, CAST(floor(n * 0.3) AS INT)) AS w FROM d) SELECT train_end, date AS predict_date, realize_date FROM e WHERE i >= w + 21 AND (i - w - 21) % 21 = 0 AND realize_date IS NOT NULL", "train_end predict_date realize_date")
add("p13_snapshot_inventory", lambda v: pit.snapshot_inventory(v("daily_bars").withColumn("year", F.year("date")), "year"), "daily_bars", "SELECT year, asset_type, count(DISTINCT symbol) AS n_symbols, count(*) AS n_rows FROM (SELECT *, CAST(year(date) AS INT) AS year FROM daily_bars) t GROUP BY ROLLUP (year, asset_type)", "year asset_type n_symbols n_rows")
add("p14_time_of_week", lambda v: pit.time_of_week_filter(v("events")).groupBy("event_type").agg(F.count("*").alias("n")), "", "SELECT event_type, count(*) AS n FROM events WHERE (isodow(ts) = 5 AND hour(ts) * 60 + minute(ts) >= 1090) OR (isodow(ts) = 6 AND hour(ts) < 6) GROUP BY 1", "event_type n")

# -- risk -----------------------------------------------------------------------------------------------------------
add("r01_log_returns", lambda v: risk.log_returns(v("daily_bars")), "daily_bars", f"SELECT * FROM (SELECT symbol, date, ln(close / lag(close) OVER ({BY})) AS ret FROM daily_bars) t WHERE ret IS NOT NULL", "symbol date", "ret")
add("r02_r03_daily_close_returns", lambda v: risk.daily_close_returns(v("intraday_bars")), "intraday_bars", f"SELECT symbol, asset_type, date, ret FROM (SELECT *, ln(close / lag(close) OVER ({BY})) AS ret FROM (SELECT symbol, asset_type, CAST(ts AS DATE) AS date, max_by(price, ts) AS close FROM intraday_bars GROUP BY 1, 2, 3) d) t WHERE ret IS NOT NULL", "symbol asset_type date", "ret")
add("r05_simple_returns", lambda v: risk.simple_returns(risk.simple_returns(v("daily_bars"), 1), 21), "daily_bars", f"SELECT symbol, date, coalesce(close / lag(close) OVER ({BY}) - 1, 0) AS ret_1, coalesce(close / lag(close, 21) OVER ({BY}) - 1, 0) AS ret_21 FROM daily_bars", "symbol date", "ret_1 ret_21")
AUCTION = "a AS (SELECT symbol, asset_type, date, CASE WHEN sum(volume) > 0 THEN least(1, greatest(0, sum(auction_volume) / sum(volume))) ELSE 0 END AS ratio FROM daily_bars GROUP BY 1, 2, 3), am AS (SELECT symbol, asset_type, avg(ratio) AS m, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM a) x WHERE k <= 20 GROUP BY 1, 2), " f"ar AS (SELECT symbol, asset_type, CASE WHEN {NAV} THEN 1 ELSE greatest(m, 1e-6) END AS auction_ratio, CASE WHEN {NAV} THEN 0 ELSE n END AS days_used, NOT {NAV} AND m < 1e-6 AS is_floored FROM am)"
add("r06_auction_ratio_daily", lambda v: risk.auction_ratio_daily(v("daily_bars")), "daily_bars", f"WITH {AUCTION} SELECT symbol, asset_type, date, ratio FROM a", "symbol asset_type date", "ratio")
add("r07_auction_ratio_ma20", lambda v: risk.auction_ratio_ma20(v("daily_bars")), "daily_bars", f"WITH {AUCTION} SELECT * FROM ar", "symbol asset_type days_used is_floored", "auction_ratio")
VOL = f"""pk AS (SELECT symbol, greatest(sqrt(avg(ln(high / low) ** 2) / (4 * ln(2))) * sqrt(252), 1e-4) AS parkinson FROM daily_bars WHERE high > 0 AND low > 0 AND high >= low AND NOT {NAV} GROUP BY symbol),
lr AS (SELECT symbol, asset_type, date, ret FROM (SELECT *, ln(close / lag(close) OVER ({BY})) AS ret FROM daily_bars) t WHERE ret IS NOT NULL),
ew AS (SELECT symbol, count(*) AS n, CASE WHEN count(*) < 5 THEN 1e-4 ELSE greatest(sqrt(sum(w * (ret - m) ** 2 * CASE WHEN ret < 0 THEN 1.2 ELSE 0.8 END) / sum(w)) * sqrt(252), 1e-4) END AS ewma
 FROM (SELECT symbol, ret, 0.94 ** (row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1) AS w, avg(ret) OVER (PARTITION BY symbol) AS m FROM lr) x GROUP BY symbol),
sd AS (SELECT symbol, stddev_samp(ret) AS s FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM lr) x WHERE k <= 30 GROUP BY symbol),
sv AS (SELECT b.symbol, b.asset_type, CASE WHEN b.n < 2 THEN 1e-4 ELSE greatest(0.5 * coalesce(ewma, 1e-4) + 0.5 * coalesce(parkinson, 1e-4), 1e-4) END AS vol, b.n < 2 AS is_fallback
 FROM (SELECT symbol, asset_type, count(*) AS n FROM daily_bars WHERE NOT {NAV} GROUP BY 1, 2) b LEFT JOIN pk USING (symbol) LEFT JOIN ew USING (symbol)
 UNION ALL SELECT b.symbol, b.asset_type, CASE WHEN coalesce(ew.n, 0) < 10 THEN fl ELSE greatest(0.5 * s * sqrt(252) + 0.5 * ewma, fl) END AS vol, coalesce(ew.n, 0) < 10 AS is_fallback
 FROM (SELECT DISTINCT symbol, asset_type, CASE asset_type WHEN 'TEFAS_FREE' THEN 0.005 ELSE 1e-4 END AS fl FROM daily_bars WHERE {NAV}) b LEFT JOIN sd USING (symbol) LEFT JOIN ew USING (symbol))"""
add("r08_parkinson_vol", lambda v: risk.parkinson_vol(v("daily_bars").where("asset_type in ('EQUITY', 'ETF')")), "daily_bars", f"WITH {VOL} SELECT symbol, parkinson FROM pk", "symbol", "parkinson")
add("r09_ewma_asym_vol", lambda v: risk.ewma_asym_vol(risk.log_returns(v("daily_bars"))), "daily_bars", f"WITH {VOL} SELECT symbol, n AS n_returns, ewma FROM ew", "symbol n_returns", "ewma")
add("r10_hybrid_vol", lambda v: risk.hybrid_vol(v("daily_bars")), "daily_bars", f"WITH {VOL} SELECT * FROM sv WHERE NOT {NAV}", "symbol asset_type is_fallback", "vol")
add("r11_nav_vol", lambda v: risk.nav_vol(v("daily_bars")), "daily_bars", f"WITH {VOL} SELECT * FROM sv WHERE {NAV}", "symbol asset_type is_fallback", "vol")
add("r12_snapshot_volatility", lambda v: risk.snapshot_volatility(v("daily_bars")), "daily_bars", f"WITH {VOL} SELECT * FROM sv", "symbol asset_type is_fallback", "vol")
# return panel of all months, absent returns zero
def panel(v):
    return v("panel_returns").where("ret is not null").select("symbol", "asset_type", F.col("date").alias("ts"), "ret")


PANEL = "pr AS (SELECT symbol, asset_type, date AS ts, ret FROM panel_returns WHERE ret IS NOT NULL), grid AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM pr) x), dense AS (SELECT s.symbol, g.ts, g.i, coalesce(p.ret, 0) AS ret FROM (SELECT DISTINCT symbol FROM pr) s CROSS JOIN grid g LEFT JOIN pr p ON p.symbol = s.symbol AND p.ts = g.ts)"
KAPPA = f"{PANEL}, mv AS (SELECT symbol FROM dense GROUP BY symbol HAVING var_samp(ret) >= 1e-16), rk AS (SELECT d.symbol, k, CASE WHEN var_pop(d.ret) > 1e-18 AND var_pop(e.ret) > 1e-18 THEN corr(d.ret, e.ret) ELSE 0 END * (1 - k / 5.0) AS rho FROM (SELECT unnest([1, 2, 3, 4]) AS k) ks, dense d JOIN mv USING (symbol) JOIN dense e ON e.symbol = d.symbol WHERE e.i = d.i + k GROUP BY d.symbol, k), kap AS (SELECT avg(r) AS avg_rho, coalesce(least(75, greatest(30, 175 * (1 + 2 * avg(r)))), 45) AS kappa FROM (SELECT symbol, sum(rho) AS r FROM rk GROUP BY symbol) x)"
COV = f"{KAPPA}, cv AS (SELECT a.symbol AS sym_i, b.symbol AS sym_j, covar_samp(a.ret, b.ret) AS cov FROM dense a JOIN dense b ON a.ts = b.ts AND a.symbol <= b.symbol GROUP BY 1, 2)"
add("r04_r13_newey_west_kappa", lambda v: risk.newey_west_kappa(panel(v)), "panel_returns", f"WITH {KAPPA} SELECT avg_rho, kappa FROM kap", "", "avg_rho kappa")
add("r04_r14_pair_covariance", lambda v: risk.pair_covariance(panel(v)), "panel_returns", f"WITH {COV} SELECT * FROM cv", "sym_i sym_j", "cov", 4)


def bitemporal(v):
    # read for both blocks, the members of one and kappa
    x = cut(panel(v))
    fast = x.where("asset_type in ('EQUITY', 'ETF')")
    return risk.bitemporal_cov(fast, x, risk.newey_west_kappa(fast))


FAST = "fr AS (SELECT * FROM panel_returns WHERE ret IS NOT NULL AND asset_type IN ('EQUITY', 'ETF'))"
BIT = COV.replace("FROM panel_returns WHERE ret IS NOT NULL", "FROM panel_returns WHERE asset_type IN ('EQUITY', 'ETF') AND ret IS NOT NULL")
SLOW = "dx AS (SELECT s.symbol, s.fast, g.ts, coalesce(p.ret, 0) AS ret FROM (SELECT DISTINCT symbol, asset_type IN ('EQUITY', 'ETF') AS fast FROM q) s CROSS JOIN (SELECT DISTINCT date AS ts FROM q) g LEFT JOIN q p ON p.symbol = s.symbol AND p.date = g.ts)"
add("r14_bitemporal_cov", bitemporal, "panel_returns", f"WITH {BIT}, q AS (SELECT symbol, asset_type, date, ret FROM panel_returns WHERE ret IS NOT NULL), {SLOW} SELECT sym_i, sym_j, cov * kappa AS cov FROM cv, kap UNION ALL SELECT a.symbol, b.symbol, covar_samp(a.ret, b.ret) * 5 FROM dx a JOIN dx b ON a.ts = b.ts AND a.symbol <= b.symbol WHERE NOT (a.fast AND b.fast) GROUP BY 1, 2", "sym_i sym_j", "cov", 3)
add("r15_rolling_cov", lambda v: risk.rolling_cov(v("panel_returns").where("ret is not null")), "panel_returns", "WITH p AS (SELECT symbol, date, ret FROM panel_returns WHERE ret IS NOT NULL), m AS (SELECT a.date, a.symbol AS sym_i, b.symbol AS sym_j, a.ret AS x, b.ret AS y FROM p a JOIN p b ON a.date = b.date AND a.symbol <= b.symbol) SELECT date, sym_i, sym_j, cov FROM (SELECT date, sym_i, sym_j, CASE WHEN count(*) OVER w >= 20 THEN covar_samp(x, y) OVER w + CASE WHEN sym_i = sym_j THEN 1e-5 ELSE 0 END END AS cov FROM m WINDOW w AS (PARTITION BY sym_i, sym_j ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) t WHERE cov IS NOT NULL", "date sym_i sym_j", "cov", 4)
add("r16_cov_vols", lambda v: risk.cov_vols(risk.variances(panel(v))), "panel_returns", f"WITH {COV} SELECT sym_i AS symbol, sqrt(cov) AS vol FROM cv WHERE sym_i = sym_j", "symbol", "vol", 4)
BOUND = f"{COV}, mir AS (SELECT * FROM cv UNION ALL SELECT sym_j, sym_i, cov FROM cv WHERE sym_i < sym_j), gr AS (SELECT sym_i, sum(CASE WHEN sym_i = sym_j THEN cov ELSE 0 END) AS d, sum(CASE WHEN sym_i <> sym_j THEN abs(cov) ELSE 0 END) AS r FROM mir GROUP BY sym_i), bd AS (SELECT min(d - r) AS lower, max(d + r) AS upper FROM gr)"
add("r17_cov_bounds", lambda v: risk.panel_bounds(panel(v)), "panel_returns", f"WITH {BOUND} SELECT lower, upper, CASE WHEN lower > 0 THEN upper / lower END AS condition_bound, lower > 0 AS surely_definite FROM bd", "surely_definite", "lower upper condition_bound", 3)
EPS = "greatest(1e-6 - lower, (upper - 1e4 * lower) / (1e4 - 1), 0)"
add("r18_cov_condition", lambda v: risk.conditioned_covariance(panel(v)), "panel_returns", f"WITH {BOUND} SELECT sym_i, sym_j, cov + CASE WHEN sym_i = sym_j THEN {EPS} ELSE 0 END AS cov, {EPS} AS eps FROM cv, bd", "sym_i sym_j", "cov eps", 3)
ADV = "av AS (SELECT symbol, asset_type, avg(x) AS adv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM (SELECT symbol, asset_type, date, sum(close * volume) AS x FROM daily_bars GROUP BY 1, 2, 3) d) e WHERE k <= 20 GROUP BY 1, 2)"
PEN = f"{AUCTION}, {VOL}, {ADV}, pe AS (SELECT av.symbol, av.asset_type, adv, greatest(adv * coalesce(auction_ratio, 1), 1e-6) AS adv_effective, vol, st FROM av LEFT JOIN ar USING (symbol) LEFT JOIN sv USING (symbol) LEFT JOIN (SELECT symbol, max_by(settlement_days, date) AS st FROM daily_bars GROUP BY symbol) l USING (symbol)), pn AS (SELECT symbol, asset_type, adv, adv_effective, CASE WHEN {NAV} THEN 0 ELSE 0.01 * vol * 1e12 / (adv_effective * adv_effective) END AS impact, 0.001 * st AS settlement FROM pe)"
add("r19_adv20", lambda v: risk.adv20(v("daily_bars")), "daily_bars", f"WITH {ADV} SELECT * FROM av", "symbol asset_type", "adv", 1)
add("r20_r22_penalties", lambda v: risk.penalties(v("daily_bars")), "daily_bars", f"WITH {PEN} SELECT * FROM pn", "symbol asset_type", {"adv_effective": 1, "impact": 3, "settlement": 6})
add("r23_total_penalty", lambda v: risk.total_penalty(risk.penalties(v("daily_bars")), risk.panel_bounds(panel(v))), "panel_returns", f"WITH {BOUND}, {PEN} SELECT symbol, least(impact + settlement, 100 * upper) AS penalty FROM pn, bd", "symbol", "penalty", 3)
add("r24_risk_report", lambda v: risk.risk_report(v("daily_bars"), risk.cov_condition(risk.variances(panel(v)), bounds=risk.panel_bounds(panel(v)))), "panel_returns", f"WITH {BOUND}, {AUCTION}, {VOL} SELECT ar.symbol, ar.asset_type, days_used, is_floored, auction_ratio, vol, variance FROM ar LEFT JOIN sv USING (symbol) LEFT JOIN (SELECT sym_i AS symbol, cov + {EPS} AS variance FROM cv, bd WHERE sym_i = sym_j) z USING (symbol)", "symbol asset_type days_used is_floored", {"auction_ratio": 6, "vol": 6, "variance": 3})


def market(v):
    x = v("panel_returns").where("ret is not null")
    return x, x.groupBy("date").agg(F.avg("ret").alias("mkt"))


MK = "x AS (SELECT symbol, date, ret, mkt FROM panel_returns JOIN (SELECT date, avg(ret) AS mkt FROM panel_returns WHERE ret IS NOT NULL GROUP BY date) m USING (date) WHERE ret IS NOT NULL)"
add("r25_beta_table", lambda v: risk.beta_table(*market(v)), "panel_returns", f"WITH {MK}, b AS (SELECT symbol, regr_slope(ret, mkt) AS beta, corr(ret, mkt) AS corr, regr_slope(ret, mkt) FILTER (mkt > 0) AS up, regr_slope(ret, mkt) FILTER (mkt < 0) AS down, count(*) AS n FROM x GROUP BY symbol) SELECT symbol, beta, corr, 0.67 * beta + 0.33 AS blume, beta / 1.4 AS unlevered, up, down, CASE WHEN down > 0 THEN up / down ELSE 1 END AS asymmetry, CASE WHEN 0.67 * beta + 0.33 > 1.2 THEN 0.8 ELSE 0.5 END AS score, CASE WHEN 0.67 * beta + 0.33 > 1.2 THEN 'OVERWEIGHT_IN_BULL_MARKET' WHEN 0.67 * beta + 0.33 < 0.7 THEN 'DEFENSIVE_SAFE_HAVEN' ELSE 'NEUTRAL_MARKET_PERFORMANCE' END AS label FROM b WHERE n >= 3", "symbol label", "beta corr blume unlevered up down score", 4)
add("r26_sharpe_table", lambda v: risk.sharpe_table(v("panel_returns").where("ret is not null"), 12.0), "panel_returns", f"""WITH x AS (SELECT symbol, ret, lag(ret) OVER ({BY}) AS prev FROM panel_returns WHERE ret IS NOT NULL), m AS (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS s, count(*) AS n, avg(ret ** 2) AS m2, avg(ret ** 3) AS m3, avg(ret ** 4) AS m4, corr(ret, prev) AS rho FROM x GROUP BY symbol),
y AS (SELECT *, (m - 0.05 / 252) * 12 / (s * sqrt(12)) AS sharpe, (m3 - 3 * m * m2 + 2 * m ** 3) / (m2 - m ** 2) ** 1.5 AS skew, (m4 - 4 * m * m3 + 6 * m ** 2 * m2 - 3 * m ** 4) / (m2 - m ** 2) ** 2 AS kurt FROM m WHERE n >= 3 AND s > 1e-12)
SELECT symbol, sharpe, sharpe / sqrt(1 + 2 * coalesce(greatest(rho, -0.45), 0)) AS lo_sharpe, sharpe * (1 + skew / 6 * sharpe - (kurt - 3) / 24 * sharpe * sharpe) AS adjusted_sharpe, skew, kurt, 0.95 AS deflated, skew < -0.5 AS tail_risk, 0.85 AS score FROM y""", "symbol tail_risk", "sharpe lo_sharpe adjusted_sharpe skew kurt deflated score", 4)
add("r27_free_float_table", lambda v: risk.free_float_table(v("company").withColumn("total_shares", F.col("shares_outstanding"))), "company", """SELECT ticker, as_of, fp AS float_pct, fv AS float_value, cri, fp < 10 OR cri > 8 AS blocked, CASE WHEN free_float_shares > 0 THEN volume / free_float_shares ELSE 0 END AS rotation, least(1, greatest(0, cri / 10)) AS risk_score
FROM (SELECT *, CASE WHEN fp > 0 THEN 1 / (CASE WHEN fv > 1 THEN log10(fv) ELSE 1 END * fp / 100) ELSE 99 END AS cri FROM (SELECT *, free_float_shares / shares_outstanding * 100 AS fp, free_float_shares * price AS fv FROM company) a) b""", "ticker as_of blocked", "float_pct float_value cri rotation risk_score", 3)
add("r28_slippage_table", lambda v: risk.slippage_table(v("cards").join(risk.adv20(v("daily_bars")).select("symbol", "adv"), "symbol").select("card_id", "symbol", "price", (F.col("card_id") % 1000 + 1.0).alias("order_volume"), "adv", F.lit(0.03).alias("daily_vol"), (F.col("card_id") % 10 == 0).alias("limit_down"))), "daily_bars cards", f"WITH {ADV} SELECT card_id, symbol, sl AS slippage, price * (1 - sl) AS executed_price, NOT ld AS feasible FROM (SELECT card_id, symbol, price, card_id % 10 = 0 AS ld, CASE WHEN card_id % 10 = 0 THEN 0.2 ELSE greatest(0.001, 0.5 * ((card_id % 1000 + 1.0) / CASE WHEN adv > 0 THEN adv ELSE 1 END) ** 0.6 * 0.03) END AS sl FROM cards JOIN av USING (symbol)) t", "card_id symbol feasible", {"slippage": 6, "executed_price": 3})

# -- technical ------------------------------------------------------------------------------------------------------
add("t01_t02_moving_stats", lambda v: technical.moving_stats(v("daily_bars")), "daily_bars", f"SELECT *, (close - sma) / greatest(std, 1e-5) AS zscore_price, (volume - vm) / greatest(vs, 1e-5) AS zscore_volume FROM (SELECT symbol, date, close, volume, {full('avg(close)', 'close', 20, 5)} AS sma, {full('stddev_samp(close)', 'close', 20, 5)} AS std, {full('avg(volume)', 'volume', 20, 5)} AS vm, {full('stddev_samp(volume)', 'volume', 20, 5)} AS vs FROM daily_bars) t".replace("greatest(std, 1e-5)", "CASE WHEN std < 1e-5 THEN 1e-5 ELSE std END").replace("greatest(vs, 1e-5)", "CASE WHEN vs < 1e-5 THEN 1e-5 ELSE vs END"), "symbol date", "sma std zscore_price zscore_volume", 4)


def ema_sql(source: str, column: str, span: str) -> str:
    """Weights of an exponential average written out over the rows so far (oracle only)."""
    a = f"(2.0 / ({span} + 1))"
    return f"(SELECT x.symbol, x.date, sum(CASE WHEN y.n = 1 THEN (1 - {a}) ** (x.n - 1) ELSE {a} * (1 - {a}) ** (x.n - y.n) END * y.{column}) AS e FROM {source} x JOIN {source} y ON x.symbol = y.symbol AND y.n <= x.n GROUP BY 1, 2)"


add("t03_ema", lambda v: technical.ema(v("monthly_panel"), {"ema_12": 12, "ema_26": 26}), "monthly_panel", f"WITH z AS (SELECT symbol, date, close, row_number() OVER ({BY}) AS n FROM monthly_panel) SELECT a.symbol, a.date, a.e AS ema_12, b.e AS ema_26 FROM {ema_sql('z', 'close', '12')} a JOIN {ema_sql('z', 'close', '26')} b ON a.symbol = b.symbol AND a.date = b.date", "symbol date", "ema_12 ema_26", 4)
add("t04_ppo_macd", lambda v: technical.ppo_macd(v("monthly_panel")), "monthly_panel", f"""WITH z AS (SELECT symbol, date, close, row_number() OVER ({BY}) AS n FROM monthly_panel),
p AS (SELECT z.symbol, z.date, z.n, (a.e - b.e) / greatest(0.001, b.e) * 100 AS ppo FROM z JOIN {ema_sql('z', 'close', '12')} a ON a.symbol = z.symbol AND a.date = z.date JOIN {ema_sql('z', 'close', '26')} b ON b.symbol = z.symbol AND b.date = z.date),
s AS (SELECT p.*, g.e AS signal, p.ppo - g.e AS hist FROM p JOIN {ema_sql('p', 'ppo', '9')} g ON g.symbol = p.symbol AND g.date = p.date),
d AS (SELECT *, hist - lag(hist) OVER ({BY}) AS delta, ppo > signal AS bullish_cross FROM s)
SELECT symbol, date, ppo, signal, hist, delta, delta - lag(delta) OVER ({BY}) AS accel, CASE WHEN ppo > 0 THEN 'ABOVE_ZERO_BULLISH' ELSE 'BELOW_ZERO_BEARISH' END AS zero_line, coalesce(hist > 0 AND delta < 0, false) AS decelerating FROM d""", "symbol date zero_line", "ppo signal hist delta accel", 4)
add("t05_rsi_wilder", lambda v: technical.rsi_wilder(v("monthly_panel")), "monthly_panel", f"""WITH z AS (SELECT symbol, date, close, row_number() OVER ({BY}) AS n, close - lag(close) OVER ({BY}) AS c FROM monthly_panel),
s AS (SELECT symbol, avg(greatest(c, 0)) AS g0, avg(greatest(-c, 0)) AS l0 FROM z WHERE n BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14),
w AS (SELECT x.symbol, x.date, x.n, (13.0 / 14) ** (x.n - 15) * max(g0) + coalesce(sum((13.0 / 14) ** (x.n - y.n) / 14 * greatest(y.c, 0)), 0) AS g, (13.0 / 14) ** (x.n - 15) * max(l0) + coalesce(sum((13.0 / 14) ** (x.n - y.n) / 14 * greatest(-y.c, 0)), 0) AS l
 FROM z x JOIN s USING (symbol) LEFT JOIN z y ON y.symbol = x.symbol AND y.n > 15 AND y.n <= x.n WHERE x.n >= 15 GROUP BY 1, 2, 3),
r AS (SELECT z.symbol, z.date, 100 - 100 / (1 + g / greatest(l, 0.0001)) AS rsi FROM z LEFT JOIN w ON w.symbol = z.symbol AND w.date = z.date)
SELECT symbol, date, rsi, rsi - lag(rsi) OVER ({BY}) AS velocity FROM r""", "symbol date", "rsi velocity", 4)
RSI = f"rs AS (SELECT symbol, date, close, 100 - 100 / (1 + g / CASE WHEN l < 1e-5 THEN 1e-5 ELSE l END) AS rsi FROM (SELECT symbol, date, close, {full('avg(greatest(d, 0))', 'd', 20, 5)} AS g, {full('avg(greatest(-d, 0))', 'd', 20, 5)} AS l FROM (SELECT *, coalesce(close - lag(close) OVER ({BY}), 0) AS d FROM daily_bars) a) b)"
add("t06_rsi_simple", lambda v: technical.rsi_simple(v("daily_bars")), "daily_bars", f"WITH {RSI} SELECT symbol, date, rsi AS rsi_simple FROM rs", "symbol date", "rsi_simple", 4)
add("t07_rsi_signal", lambda v: technical.rsi_signal(technical.rsi_simple(v("daily_bars")).withColumnRenamed("rsi_simple", "rsi")), "daily_bars", f"WITH {RSI} SELECT symbol, date, rsi > 75 AS is_overbought, rsi < 32 AS is_oversold, close > fc AS bearish_divergence, CASE WHEN close > fc THEN 0.35 WHEN rsi > 75 THEN 0.25 WHEN rsi < 32 THEN 0.75 ELSE 0.5 END AS score, CASE WHEN close > fc THEN 'BEARISH_REVERSAL_RISK' WHEN rsi > 75 THEN 'OVERBOUGHT_SELL_SIGNAL' WHEN rsi < 32 THEN 'OVERSOLD_BUY_SIGNAL' ELSE 'NEUTRAL_MOMENTUM' END AS label FROM (SELECT *, first_value(close) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fc FROM rs WHERE rsi IS NOT NULL) t", "symbol date is_overbought is_oversold bearish_divergence label", "score")
ATR = f"atrs AS (SELECT symbol, date, close, {full('avg(tr)', 'tr', 20, 5)} AS atr FROM (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(close - pc)) END AS tr FROM (SELECT *, lag(close) OVER ({BY}) AS pc FROM daily_bars) a) b)"
add("t08_t14_atr", lambda v: technical.atr(v("daily_bars")), "daily_bars", f"WITH {ATR} SELECT symbol, date, atr FROM atrs", "symbol date", "atr", 4)
add("t09_ma_cross", lambda v: technical.ma_cross(v("daily_bars")), "daily_bars", f"""WITH a AS (SELECT symbol, date, close, avg(close) OVER {last(50)} AS ma_short, avg(close) OVER {last(200)} AS ma_long, row_number() OVER ({BY}) AS n, first_value(close) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fc FROM daily_bars)
SELECT symbol, date, ma_short, ma_long, (ma_short / ma_long - 1) * 100 AS spread, (ma_long - fc) / n AS slope, close / ma_long - 1 AS distance FROM a""", "symbol date", "ma_short ma_long spread slope distance", 3)
add("t10_bollinger", lambda v: technical.bollinger(v("daily_bars")), "daily_bars", f"""WITH a AS (SELECT * FROM (SELECT symbol, date, close, {full('avg(close)', 'close', 20, 20)} AS mid, {full('stddev_pop(close)', 'close', 20, 20)} AS s FROM daily_bars) t WHERE mid IS NOT NULL),
b AS (SELECT *, 4 * s / greatest(0.001, mid) AS bandwidth, (close - mid + 2 * s) / greatest(0.001, 4 * s) AS pct_b FROM a),
c AS (SELECT *, {full('avg(bandwidth)', 'bandwidth', 20, 5)} AS bm, {full('stddev_samp(bandwidth)', 'bandwidth', 20, 5)} AS bs FROM b)
SELECT symbol, date, mid + 2 * s AS upper, mid, mid - 2 * s AS lower, bandwidth, pct_b, CASE WHEN bs > 1e-9 THEN (bandwidth - bm) / bs ELSE 0 END AS bandwidth_z, CASE WHEN pct_b > 0.5 THEN 'UPWARD_EXPANSION' ELSE 'DOWNWARD_EXPANSION' END AS direction, CASE WHEN pct_b > 1 THEN 0.7 WHEN pct_b < 0 THEN 0.1 ELSE 0.5 END AS score FROM c""", "symbol date direction", "upper mid lower bandwidth pct_b bandwidth_z score", 3)
OBV = f"ob AS (SELECT *, 1000000 + sum(mv) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv FROM (SELECT *, coalesce(sign(close - lag(close) OVER ({BY})), 0) * volume AS mv FROM daily_bars) a)"
add("t11_obv", lambda v: technical.obv(v("daily_bars")), "daily_bars", f"WITH {OBV} SELECT symbol, date, obv, avg(obv) OVER {last(20)} AS obv_mean FROM ob", "symbol date", "obv obv_mean", 3)
add("t12_rvol_flow", lambda v: technical.rvol_flow(v("daily_bars").withColumns({"bid_volume": F.col("auction_volume").cast("double"), "ask_volume": (F.col("volume") - F.col("auction_volume")).cast("double")})), "daily_bars", f"""WITH {OBV}, a AS (SELECT symbol, date, obv, 2 * auction_volume - volume AS delta, volume / greatest(1, avg(volume) OVER r) AS rvol, close - first_value(close) OVER r AS dp, obv - first_value(obv) OVER r AS dv FROM ob WINDOW r AS ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT symbol, date, obv, delta, rvol, rvol > 2 AS is_spike, rvol < 0.5 AS is_illiquid, dp < 0 AND dv > 0 AS accumulation, CASE WHEN dp < 0 AND dv > 0 THEN 0.9 WHEN dp > 0 AND rvol < 0.6 THEN 0.18 WHEN rvol > 2 THEN 0.85 ELSE 0.5 END AS score FROM a""", "symbol date is_spike is_illiquid accumulation", "obv rvol delta score", 3)
add("t13_fib_levels", lambda v: technical.fib_levels(v("daily_bars")), "daily_bars", f"""WITH a AS (SELECT symbol, date, close, max(high) OVER {last(60)} AS h, min(low) OVER {last(60)} AS l FROM daily_bars)
SELECT symbol, date, h AS swing_high, l AS swing_low, {', '.join(f"h - (h - l) * {s} AS {n}" for n, s in technical.RETRACEMENTS.items())}, close < h - (h - l) * 0.786 AS invalidated, CASE WHEN close < h - (h - l) * 0.786 THEN 'BELOW_0786_BROKEN' WHEN close < h - (h - l) * 0.618 THEN 'LEVEL_0786' WHEN close < h - (h - l) * 0.5 THEN 'LEVEL_0618' WHEN close < h - (h - l) * 0.382 THEN 'LEVEL_0500' WHEN close < h - (h - l) * 0.236 THEN 'LEVEL_0382' ELSE 'ABOVE_0236' END AS zone FROM a""", "symbol date invalidated zone", "swing_high swing_low " + " ".join(technical.RETRACEMENTS), 4)

# -- factors --------------------------------------------------------------------------------------------------------
FACTOR = f"""f1 AS (SELECT *, coalesce(close / lag(close) OVER ({BY}) - 1, 0) AS ret_1 FROM monthly_panel),
f2 AS (SELECT *, sum(ret_1) OVER {last(4)} AS mom_4, sum(ret_1) OVER {last(12)} AS mom_12, 1 - 1 / (1 + avg(greatest(ret_1, 0)) OVER {last(4)} / (avg(greatest(-ret_1, 0)) OVER {last(4)} + 1e-6)) AS rsi_4,
 CASE WHEN avg(volume) OVER {last(4)} > 0 THEN volume / avg(volume) OVER {last(4)} ELSE 1 END AS vol_accel, close / (avg(close) OVER {last(20)} + 1e-6) - 1 AS ma20_dist, close / (max(close) OVER {last(12)} + 1e-6) - 1 AS high12_dist,
 coalesce(stddev_samp(ret_1) OVER {last(5)}, 0.01) AS vol_5, coalesce((ret_1 + lag(ret_1, 1) OVER ({BY})) / 2 - (lag(ret_1, 3) OVER ({BY}) + lag(ret_1, 4) OVER ({BY})) / 2, 0) AS trend_slope,
 (max(close) OVER {last(20)} - min(close) OVER {last(20)}) / (avg(close) OVER {last(20)} + 1e-6 + 1e-5) AS bb_bandwidth, (close - min(close) OVER {last(20)}) / (max(close) OVER {last(20)} - min(close) OVER {last(20)} + 1e-5) AS stoch_k, lead(ret_1) OVER ({BY}) AS next_return FROM f1),
f3 AS (SELECT *, avg(stoch_k) OVER {last(3)} AS stoch_d, abs(ret_1) / (vol_5 + 1e-5) AS vol_ratio, ret_1 * vol_accel AS mfi_proxy, mom_4 - mom_12 / 3 AS macd_hist, mom_12 / (vol_5 + 1e-5) AS sharpe_ratio, avg(ret_1) OVER (PARTITION BY date) AS mkt_climate,
 quantile_cont(ret_1, 0.5) OVER (PARTITION BY date) AS med, count(*) OVER (PARTITION BY date) AS nd FROM f2),
fx AS (SELECT *, ret_1 - mkt_climate AS rel_alpha, ret_1 - med AS sector_rel_mom FROM f3)"""
_FCOLS = "ret_1 mom_4 mom_12 rsi_4 vol_accel ma20_dist high12_dist vol_5 trend_slope rel_alpha vol_ratio mkt_climate mfi_proxy bb_bandwidth macd_hist stoch_k stoch_d sharpe_ratio sector_rel_mom next_return"
add("f01_f20_f23_period_factors", lambda v: factors.period_factors(v("monthly_panel")), "monthly_panel", f"WITH {FACTOR} SELECT * FROM fx", "symbol date", _FCOLS, 4)
add("f09_rank_mom4", lambda v: factors.period_factors(v("monthly_panel").withColumn("close", F.round("close", 2))).withColumn("q", F.round("mom_4", 6)), "monthly_panel", f"WITH {FACTOR.replace('FROM monthly_panel', 'FROM (SELECT symbol, date, round(close, 2) AS close, volume FROM monthly_panel) mp')} SELECT symbol, date, round(mom_4, 6) AS q FROM fx", "symbol date", "q", 3)
add("f21_f22_clean_features", lambda v: factors.clean_features(factors.period_factors(v("monthly_panel"))).select("symbol", "date", "mom_12", F.element_at("last3", 3).alias("l1"), F.element_at("last3", 2).alias("l2"), F.element_at("last3", 1).alias("l3")), "monthly_panel", f"WITH {FACTOR}, ix AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM monthly_panel) d), ll AS (SELECT symbol, date, lag(ret_1, 1) OVER ({BY}) AS l2, lag(ret_1, 2) OVER ({BY}) AS l3 FROM f1) SELECT fx.symbol, fx.date, mom_12, ret_1 AS l1, l2, l3 FROM fx JOIN ix USING (date) JOIN ll ON ll.symbol = fx.symbol AND ll.date = fx.date WHERE i >= 5", "symbol date", "mom_12 l1 l2 l3", 4)
HZ = f"""h1 AS (SELECT *, close / lag(close, 21) OVER ({BY}) - 1 AS ret_21d, close / lag(close) OVER ({BY}) - 1 AS r, close * volume AS pv FROM daily_bars),
h2 AS (SELECT *, {full('avg(r)', 'r', 21, 21)} / ({full('stddev_samp(r)', 'r', 21, 21)} + 1e-5) * sqrt(252) AS sharpe_momentum, ({full('sum(pv)', 'pv', 21, 21)} / {full('sum(volume)', 'volume', 21, 21)}) / ({full('sum(pv)', 'pv', 63, 63)} / {full('sum(volume)', 'volume', 63, 63)}) - 1 AS vwap_ratio, quantile_cont(ret_21d, 0.5) OVER (PARTITION BY date) AS macro_spread FROM h1),
hx AS (SELECT *, ret_21d - macro_spread AS rs_sector FROM h2)"""
add("h01_h05_horizon_factors", lambda v: factors.horizon_factors(v("daily_bars")), "daily_bars", f"WITH {HZ} SELECT * FROM hx", "symbol date", "ret_21d rs_sector sharpe_momentum vwap_ratio macro_spread", 4)
HS = f"""h1 AS (SELECT *, close / lag(close, 21) OVER ({BY}) - 1 AS ret_21d FROM daily_bars), h2 AS (SELECT *, quantile_cont(ret_21d, 0.5) OVER (PARTITION BY date) AS macro_spread, quantile_cont(ret_21d, 0.5) OVER (PARTITION BY date, symbol % 7) AS ms,
{full('avg(close)', 'close', 21, 21)} / {full('avg(close)', 'close', 63, 63)} - 1 AS vwap_ratio FROM h1)"""
add("h02_h04_sector_strength", lambda v: factors.horizon_factors(v("daily_bars").drop("volume").withColumn("sector", F.col("symbol") % 7), sector="sector"), "daily_bars", f"WITH {HS} SELECT symbol, date, symbol % 7 AS sector, ret_21d - ms AS rs_sector, vwap_ratio, macro_spread FROM h2", "symbol date sector", "rs_sector vwap_ratio macro_spread", 4)
TG = f"tg AS (SELECT symbol, date, asset_type, CASE WHEN {NAV} THEN (lead(close, 22) OVER ({BY}) - lead(close, 1) OVER ({BY})) / (lead(close, 1) OVER ({BY}) + 1e-5) ELSE (lead(close, 21) OVER ({BY}) - close) / (close + 1e-5) END / (coalesce({full('stddev_samp(r)', 'r', 21, 21)}, 0.01) + 1e-5) AS target FROM (SELECT *, close / lag(close) OVER ({BY}) - 1 AS r FROM daily_bars) b)"
add("h06_risk_adjusted_target", lambda v: factors.risk_adjusted_target(v("daily_bars")), "daily_bars", f"WITH {TG} SELECT * FROM tg", "symbol date", "target", 3)
CZ = "CASE WHEN n = 1 THEN {c} WHEN {s} <= 1e-7 THEN {f} ELSE least(3, greatest(-3, ({c} - {m}) / {s})) END AS {c}"
add("h07_rolling_dataset", lambda v: factors.rolling_dataset(v("daily_bars"), calendar=v("lineitem").select(F.col("l_shipdate").cast("date").alias("date"))), "daily_bars", f"""WITH {HZ}, {TG}, j AS (SELECT hx.symbol, hx.date, hx.asset_type, coalesce(ret_21d, 0) AS ret_21d, coalesce(rs_sector, 0) AS rs_sector, coalesce(sharpe_momentum, 0) AS sharpe_momentum, coalesce(vwap_ratio, 0) AS vwap_ratio, coalesce(target, 0) AS target FROM hx JOIN tg ON tg.symbol = hx.symbol AND tg.date = hx.date),
k AS (SELECT *, count(*) OVER w AS n, {', '.join(f'avg({c}) OVER w AS m_{c}, stddev_pop({c}) OVER w AS s_{c}' for c in ('ret_21d', 'rs_sector', 'sharpe_momentum', 'vwap_ratio', 'target'))} FROM j WINDOW w AS (PARTITION BY date, asset_type)),
ix AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () - 1 AS top FROM (SELECT DISTINCT date FROM daily_bars) d)
SELECT symbol, date, {', '.join(CZ.format(c=c, s=f's_{c}', m=f'm_{c}', f='0' if c != 'target' else f'{c} - m_{c}') for c in ('ret_21d', 'rs_sector', 'sharpe_momentum', 'vwap_ratio', 'target'))} FROM k JOIN ix USING (date) WHERE i >= 63 AND i <= top - 22""", "symbol date", "ret_21d rs_sector sharpe_momentum vwap_ratio target", 3)

# -- cross-section --------------------------------------------------------------------------------------------------
add("n01_pct_rank_min", lambda v: crosssec.pct_rank_min(v("panel_returns").withColumn("k", F.floor(F.col("volume") / 10)), ["k", "ret"]).select("symbol", "date", "k_ranked", F.col("ret_ranked").isNull().alias("no_ret")), "panel_returns", "SELECT symbol, date, (rank() OVER (PARTITION BY date ORDER BY floor(volume / 10)) - 1) / greatest(count(*) OVER (PARTITION BY date) - 1, 1) AS k_ranked, ret IS NULL AS no_ret FROM panel_returns", "symbol date no_ret", "k_ranked")
add("n01_n02_wide_ranks", lambda v: crosssec.pct_rank_avg(crosssec.pct_rank_min(v("panel_returns").withColumn("k", F.floor(F.col("volume") / 10)), ["k", "ret"], pieces=8), "k", pieces=8), "panel_returns", "SELECT symbol, date, (k1 - 1) / greatest(n - 1, 1) AS k_ranked, CASE WHEN ret IS NOT NULL THEN (r1 - 1) / greatest(n - 1, 1) END AS ret_ranked, CASE WHEN n <= 1 THEN 0.5 ELSE round((k1 + (t - 1) / 2.0 - 1) / (n - 1), 4) END AS pct_rank FROM (SELECT symbol, date, ret, rank() OVER (PARTITION BY date ORDER BY floor(volume / 10)) AS k1, count(*) OVER (PARTITION BY date, floor(volume / 10)) AS t, rank() OVER (PARTITION BY date ORDER BY ret NULLS LAST) AS r1, count(*) OVER (PARTITION BY date) AS n FROM panel_returns) x", "symbol date", {"k_ranked": 6, "ret_ranked": 6, "pct_rank": 3})
add("n02_pct_rank_avg", lambda v: crosssec.pct_rank_avg(v("monthly_panel").withColumn("k", F.floor(F.col("volume") / 20)), "k"), "monthly_panel", "SELECT symbol, date, CASE WHEN n <= 1 THEN 0.5 ELSE round((rk + (t - 1) / 2.0 - 1) / (n - 1), 4) END AS pct_rank FROM (SELECT symbol, date, rank() OVER (PARTITION BY date ORDER BY floor(volume / 20)) AS rk, count(*) OVER (PARTITION BY date, floor(volume / 20)) AS t, count(*) OVER (PARTITION BY date) AS n FROM monthly_panel) x", "symbol date", "pct_rank", 3)
_CZ = lambda flat: f"SELECT symbol, date, CASE WHEN n = 1 THEN volume WHEN s <= 1e-7 THEN {flat} ELSE least(3, greatest(-3, (volume - m) / s)) END AS volume FROM (SELECT symbol, date, volume, count(*) OVER w AS n, avg(volume) OVER w AS m, stddev_pop(volume) OVER w AS s FROM monthly_panel WINDOW w AS (PARTITION BY date, asset_type)) t"
add("n03_class_zscore", lambda v: crosssec.class_zscore(v("monthly_panel"), ["volume"]), "monthly_panel", _CZ("0"), "symbol date", "volume")
add("n04_class_zscore_target", lambda v: crosssec.class_zscore(v("monthly_panel"), ["volume"], is_target=True), "monthly_panel", _CZ("volume - m"), "symbol date", "volume")
add("n05_date_zscore", lambda v: crosssec.date_zscore(v("monthly_panel"), "volume"), "monthly_panel", "SELECT symbol, date, least(3, greatest(-3, (volume - avg(volume) OVER w) / (stddev_samp(volume) OVER w + 1e-6))) AS zscore FROM monthly_panel WINDOW w AS (PARTITION BY date)", "symbol date", "zscore", 4)
add("n06_alpha_normalise", lambda v: crosssec.alpha_normalise(v("panel_returns"), "ret"), "panel_returns", f"WITH a AS (SELECT symbol, date, asset_type, coalesce(ret, quantile_cont(ret, 0.5) OVER (PARTITION BY date), 0) AS x FROM panel_returns), b AS (SELECT *, avg(x) OVER (PARTITION BY date) AS m, stddev_pop(x) OVER (PARTITION BY date) AS s FROM a) SELECT symbol, date, CASE WHEN s < 1e-6 THEN 0 ELSE (x - m) / s END * 0.02 * CASE WHEN {NAV} THEN 0.8 ELSE 1 END AS alpha, -CASE WHEN s < 1e-6 THEN 0 ELSE (x - m) / s END * 0.02 * CASE WHEN {NAV} THEN 0.8 ELSE 1 END AS q FROM b", "symbol date", "alpha q")
add("n07_winsorize", lambda v: crosssec.winsorize(v("panel_returns"), "ret"), "panel_returns", "WITH a AS (SELECT symbol, date, coalesce(ret, quantile_cont(ret, 0.5) OVER (PARTITION BY date), 0) AS ret FROM panel_returns), b AS (SELECT *, quantile_cont(ret, 0.025) OVER (PARTITION BY date) AS lower, quantile_cont(ret, 0.975) OVER (PARTITION BY date) AS upper FROM a) SELECT symbol, date, lower, upper, greatest(least(ret, upper), lower) AS winsorized FROM b", "symbol date", "lower upper winsorized", 4)
add("n07_f20_wide_quantiles", lambda v: factors.date_median(crosssec.winsorize(v("panel_returns"), "ret", pieces=8), "ret", "median", pieces=8), "panel_returns", "WITH a AS (SELECT symbol, date, coalesce(ret, quantile_cont(ret, 0.5) OVER (PARTITION BY date), 0) AS ret FROM panel_returns), b AS (SELECT *, quantile_cont(ret, 0.025) OVER w AS lower, quantile_cont(ret, 0.975) OVER w AS upper, quantile_cont(ret, 0.5) OVER w AS median FROM a WINDOW w AS (PARTITION BY date)) SELECT symbol, date, count(*) FILTER (ret < lower) OVER (PARTITION BY date) AS n_low, count(*) FILTER (ret > upper) OVER (PARTITION BY date) AS n_high, lower, upper, median, greatest(least(ret, upper), lower) AS winsorized FROM b", "symbol date n_low n_high", "lower upper median winsorized", 4)
add("n08_delist_decouple", lambda v: crosssec.delist_decouple(v("panel_returns").where("ret is not null"), crash=-0.5), "panel_returns", "WITH a AS (SELECT symbol, date, ret, ret <= -0.5 AS is_delisted, quantile_cont(CASE WHEN ret > -0.5 THEN ret END, 0.025) OVER (PARTITION BY date) AS lo, quantile_cont(CASE WHEN ret > -0.5 THEN ret END, 0.975) OVER (PARTITION BY date) AS hi FROM panel_returns WHERE ret IS NOT NULL) SELECT symbol, date, is_delisted, CASE WHEN is_delisted THEN -2 ELSE greatest(least(ret, hi), lo) END AS target, hi - lo AS spread FROM a", "symbol date is_delisted", "target spread", 4)
add("n08_delist_flag", lambda v: crosssec.delist_decouple(v("panel_returns").where("ret is not null").withColumn("gone", F.expr("CASE WHEN month(date) = 3 THEN true WHEN symbol % 5 = 0 THEN true WHEN symbol % 5 = 1 THEN NULL ELSE false END")), flag="gone"), "panel_returns", "WITH a AS (SELECT symbol, date, ret, month(date) = 3 OR symbol % 5 = 0 AS is_delisted FROM panel_returns WHERE ret IS NOT NULL), b AS (SELECT *, quantile_cont(ret, 0.025) FILTER (NOT is_delisted) OVER (PARTITION BY date) AS lo, quantile_cont(ret, 0.975) FILTER (NOT is_delisted) OVER (PARTITION BY date) AS hi FROM a) SELECT symbol, date, is_delisted, CASE WHEN is_delisted THEN -2 ELSE greatest(least(ret, hi), lo) END AS target, coalesce(hi - lo, 0) AS spread FROM b", "symbol date is_delisted", "target spread", 4)
add("n09_sector_median", lambda v: crosssec.sector_median(v("fundamentals"), "revenue"), "fundamentals", "SELECT ticker, as_of, quantile_cont(revenue, 0.5) OVER (PARTITION BY as_of, sector) AS sector_revenue FROM fundamentals", "ticker as_of", "sector_revenue", 2)
add("n10_history_zscore", lambda v: crosssec.history_zscore(v("fundamentals"), "revenue"), "fundamentals", "SELECT ticker, as_of, CASE WHEN s > 1e-9 THEN (revenue - m) / s ELSE 0 END AS revenue_z FROM (SELECT ticker, as_of, revenue, stddev_samp(revenue) OVER w AS s, avg(revenue) OVER w AS m FROM fundamentals WINDOW w AS (PARTITION BY ticker ORDER BY date_diff('day', DATE '1970-01-01', as_of) RANGE BETWEEN 1825 PRECEDING AND CURRENT ROW)) t", "ticker as_of", "revenue_z", 4)

# -- labels ---------------------------------------------------------------------------------------------------------
FWD = f"fw AS (SELECT * FROM (SELECT symbol, date, close, lead(close, 20) OVER ({BY}) / close - 1 AS fwd FROM daily_bars) t WHERE fwd IS NOT NULL), lb AS (SELECT *, CASE WHEN fwd >= 0.075 THEN 1 WHEN fwd <= -0.04 THEN -1 ELSE 0 END AS label FROM fw)"


def labelled(v):
    return labels.barrier_label(labels.forward_return(v("daily_bars")))


add("l01_l02_barrier_label", labelled, "daily_bars", f"WITH {FWD} SELECT symbol, date, label, fwd FROM lb", "symbol date label", "fwd")
add("l03_path_barrier_outcome", lambda v: labels.path_barrier_outcome(dealt_as_bars(v("cards"), v.sf_dir, "symbol").select("card_id", "symbol", "issue_date", F.date_add("issue_date", 30).alias("due_date"), (F.col("price") * 1.1).alias("target"), (F.col("price") * 0.95).alias("stop")), v("daily_bars")), "daily_bars cards", "SELECT c.card_id, c.symbol, max(b.high) AS max_price, min(b.low) AS min_price, CASE WHEN max(b.high) >= max(c.price) * 1.1 THEN 'SUCCESS' WHEN min(b.low) <= max(c.price) * 0.95 THEN 'FAILURE' ELSE 'EXPIRED' END AS outcome FROM cards c LEFT JOIN daily_bars b ON b.symbol = c.symbol AND b.date BETWEEN c.issue_date AND c.issue_date + 30 GROUP BY 1, 2", "card_id symbol outcome", "max_price min_price", 8)
add("l04_horizon_outcome_audit", lambda v: labels.horizon_outcome_audit(v("daily_bars")), "daily_bars", f"SELECT symbol, exit_date, entry, exit, exit / entry - 1 AS ret, CASE WHEN exit / entry - 1 >= 0.075 THEN 'TARGET' WHEN exit / entry - 1 <= -0.04 THEN 'STOP' ELSE 'OPEN' END AS verdict FROM (SELECT symbol, min_by(close, n) AS entry, max_by(close, n) AS exit, max(date) AS exit_date FROM (SELECT *, row_number() OVER ({BY}) AS n FROM daily_bars) a WHERE n <= 21 GROUP BY symbol) b", "symbol exit_date verdict", "entry exit ret", 8)
add("l05_l07_l08_sample_weights", lambda v: labels.sample_weights(labels.date_uniqueness(labelled(v))), "daily_bars", f"WITH {FWD}, u AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY date) AS uniqueness FROM lb) SELECT symbol, date, uniqueness, (1 + abs(fwd)) * uniqueness AS opportunity, (1 + abs(fwd)) * uniqueness * CASE WHEN label = 0 THEN 0.5 WHEN abs(fwd) >= 0.15 THEN 3 ELSE 1 END AS weight FROM u", "symbol date", "uniqueness opportunity weight")
add("l06_label_uniqueness", lambda v: labels.label_uniqueness(v("label_spans")), "label_spans", "WITH p AS (SELECT symbol, start_t, end_t, ret, unnest(range(start_t, end_t + 1)) AS t FROM label_spans), c AS (SELECT symbol, t, count(*) AS c FROM p GROUP BY 1, 2) SELECT symbol, start_t, end_t, ret, avg(1.0 / c) AS uniqueness, avg(1.0 / c) * abs(ret) AS weight FROM p JOIN c USING (symbol, t) GROUP BY 1, 2, 3, 4", "symbol start_t", "ret uniqueness weight", 5)
add("l09_blended_sample", lambda v: labels.blended_sample(v("monthly_panel")).select("symbol", "date", "is_new"))
