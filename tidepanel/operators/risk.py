"""Returns, volatility, covariance and liquidity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import tiles
from tidepanel.functions.windows import cascade, clip, correlation, dates_indexed, finite, ln, ratio, series
from tidepanel.operators.ingest import INTRADAY, NAV

YEAR = 252.0
INTRADAY_FLOOR, NAV_FLOOR = 1e-4, 0.005
DECAY, UP, DOWN = 0.94, 0.8, 1.2


def log_returns(df: DataFrame, price: str = "close", ts: str = "date", key: str = "symbol") -> DataFrame:
    """ln(P_t / P_t-1) per symbol; the first row has none and goes. A price of zero gives -infinite and then infinite returns."""
    out = df.withColumn("ret", ln(ratio(F.col(price), F.lag(price).over(series(key, ts)))))
    return out.where("ret is not null")


def daily_close(df: DataFrame, price: str = "price", ts: str = "ts") -> DataFrame:
    """Last price of each symbol and day; rows without one do not count. (symbol, ts) is a key."""
    there = F.when(F.col(price).isNotNull(), F.col(ts))
    return df.groupBy("symbol", "asset_type", F.to_date(ts).alias("date")).agg(F.max_by(price, there).alias("close"))


def daily_close_returns(df: DataFrame) -> DataFrame:
    return log_returns(daily_close(df))


def simple_returns(df: DataFrame, k: int, price: str = "close") -> DataFrame:
    """P_t / P_t-k - 1, zero where there is no earlier row."""
    return df.withColumn(f"ret_{k}", F.coalesce(F.col(price) / F.lag(price, k).over(series()) - 1, F.lit(0.0)))


def auction_ratio_daily(df: DataFrame) -> DataFrame:
    s = df.groupBy("symbol", "asset_type", "date").agg(F.sum("auction_volume").alias("a"), F.sum("volume").alias("v"))
    return s.select("symbol", "asset_type", "date", F.when(F.col("v") > 0, clip(F.col("a") / F.col("v"), 0, 1)).otherwise(0.0).alias("ratio"))


def auction_ratio_ma20(df: DataFrame, n: int = 20, floor: float = 1e-6) -> DataFrame:
    """Mean of the last daily ratios per symbol with a floor; NAV classes count as 1 with no days used."""
    latest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    own = auction_ratio_daily(df).withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n)
    out = own.groupBy("symbol", "asset_type").agg(F.avg("ratio").alias("mean"), F.count("*").alias("days"))
    nav = F.col("asset_type").isin(*NAV)
    return out.select("symbol", "asset_type", F.when(nav, 1.0).otherwise(F.greatest("mean", F.lit(floor))).alias("auction_ratio"), F.when(nav, 0).otherwise(F.col("days")).alias("days_used"), (~nav & (F.col("mean") < floor)).alias("is_floored"))


def parkinson_vol(df: DataFrame) -> DataFrame:
    """Range volatility per symbol from the highest high and lowest low of each day."""
    daily = df.groupBy("symbol", "asset_type", "date").agg(F.max("high").alias("h"), F.min("low").alias("l")).where("h > 0 and l > 0 and h >= l")
    out = daily.groupBy("symbol", "asset_type").agg(F.avg(F.pow(F.log(F.col("h") / F.col("l")), 2)).alias("m"))
    return out.select("symbol", "asset_type", F.greatest(F.sqrt(F.col("m") / (4 * math.log(2))) * math.sqrt(YEAR), F.lit(INTRADAY_FLOOR)).alias("parkinson"))


def ewma_asym_vol(returns: DataFrame, floor: float = INTRADAY_FLOOR) -> DataFrame:
    """Exponentially weighted deviations from the plain mean, losses weighing more; the floor below 5 returns."""
    latest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    x = returns.select("symbol", "ret", F.pow(F.lit(DECAY), F.row_number().over(latest) - 1).alias("w"), F.avg("ret").over(Window.partitionBy("symbol")).alias("m"))
    term = F.col("w") * F.pow(F.col("ret") - F.col("m"), 2) * F.when(F.col("ret") < 0, DOWN).otherwise(UP)
    out = x.groupBy("symbol").agg((F.sum(term) / F.sum("w")).alias("v"), F.count("*").alias("n_returns"))
    return out.select("symbol", "n_returns", F.when(F.col("n_returns") < 5, F.lit(floor)).otherwise(F.greatest(F.sqrt("v") * math.sqrt(YEAR), F.lit(floor))).alias("ewma"))


def hybrid_vol(df: DataFrame) -> DataFrame:
    """Half range, half weighted volatility of the intraday classes; the floor and a flag where there is too little."""
    own = df.where(F.col("asset_type").isin(*INTRADAY))
    ewma = ewma_asym_vol(log_returns(own))
    points = own.groupBy("symbol", "asset_type").agg(F.count("*").alias("n"))
    out = points.join(parkinson_vol(own), ["symbol", "asset_type"], "left").join(ewma, "symbol", "left")
    low = F.lit(INTRADAY_FLOOR)
    both = 0.5 * F.coalesce("ewma", low) + 0.5 * F.coalesce("parkinson", low)
    short = F.col("n") < 2
    return out.select("symbol", "asset_type", F.when(short, low).otherwise(F.greatest(both, low)).alias("vol"), short.alias("is_fallback"))


def nav_vol(df: DataFrame, n: int = 30) -> DataFrame:
    """Half deviation of the last 30 returns, half weighted volatility of the NAV classes; floors by class."""
    own = df.where(F.col("asset_type").isin(*NAV))
    returns = log_returns(own)
    latest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    recent = returns.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n)
    std = recent.groupBy("symbol").agg(F.stddev_samp("ret").alias("s"))
    out = own.select("symbol", "asset_type").distinct().join(std, "symbol", "left").join(ewma_asym_vol(returns), "symbol", "left")
    floor = F.when(F.col("asset_type") == "TEFAS_FREE", NAV_FLOOR).otherwise(INTRADAY_FLOOR)
    short = F.coalesce("n_returns", F.lit(0)) < 10
    vol = 0.5 * F.col("s") * math.sqrt(YEAR) + 0.5 * F.col("ewma")
    return out.select("symbol", "asset_type", F.when(short, floor).otherwise(F.greatest(vol, floor)).alias("vol"), short.alias("is_fallback"))


def snapshot_volatility(df: DataFrame) -> DataFrame:
    return hybrid_vol(df).unionByName(nav_vol(df))


def newey_west_kappa(returns: DataFrame, max_lag: int = 4, n: int = 175) -> DataFrame:
    """Autocorrelation scale of a return panel (symbol, ts, ret) in which absent returns are zero: one row (kappa, avg_rho).

    Moments of the two slices of each lag come from sums over the present returns; zeros enter through the grid size. All
    lags share one window and one aggregation per symbol; (symbol, ts) is a key.
    """
    grid = returns.select("ts").distinct().withColumn("idx", F.row_number().over(Window.orderBy("ts")) - 1)
    size = grid.agg(F.count("*").alias("g"))
    x = returns.select("symbol", "ts", "ret").join(grid, "ts").join(size)
    # the last max_lag rows of a symbol hold every earlier return that is at most max_lag grid steps away
    w = Window.partitionBy("symbol").orderBy("idx")
    x = x.withColumns({f"_{c}{j}": F.lag(c, j).over(w) for j in range(1, max_lag + 1) for c in ("idx", "ret")})
    part = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    sums = [F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"), F.max("g").alias("g")]
    for k in range(1, max_lag + 1):
        head, tail = F.col("idx") < F.col("g") - k, F.col("idx") >= k
        product = sum((F.when(F.col(f"_idx{j}") == F.col("idx") - k, F.col(f"_ret{j}") * F.col("ret")).otherwise(0.0) for j in range(1, k + 1)), F.lit(0.0))
        sums += [part(head, F.col("ret")).alias(f"sx{k}"), part(head, F.col("ret") ** 2).alias(f"qx{k}"), part(tail, F.col("ret")).alias(f"sy{k}"), part(tail, F.col("ret") ** 2).alias(f"qy{k}"), F.sum(product).alias(f"xy{k}")]
    own = x.groupBy("symbol").agg(*sums).where((F.col("q") - F.col("s") * F.col("s") / F.col("g")) / F.greatest(F.col("g") - 1, F.lit(1)) >= 1e-16)
    total = F.lit(0.0)
    for k in range(1, max_lag + 1):
        m = F.greatest(F.col("g") - k, F.lit(1))
        vx, vy = F.col(f"qx{k}") - F.col(f"sx{k}") ** 2 / m, F.col(f"qy{k}") - F.col(f"sy{k}") ** 2 / m
        rho = (F.col(f"xy{k}") - F.col(f"sx{k}") * F.col(f"sy{k}") / m) / F.sqrt(vx * vy)
        total = total + F.when((F.col("g") > k) & (vx > 1e-18) & (vy > 1e-18), rho).otherwise(0.0) * (1 - k / (max_lag + 1.0))
    out = own.agg(F.avg(total).alias("avg_rho"))
    return out.select("avg_rho", F.coalesce(clip(n * (1 + 2 * F.col("avg_rho")), 30, 75), F.lit(45.0)).alias("kappa"))


def pair_covariance(returns: DataFrame) -> DataFrame:
    """(sym_i, sym_j, cov) for i <= j of a return panel (symbol, ts, ret) in which absent returns are zero.

    Pairs are made tile by tile (see functions/tiles.py) and never shuffled; (symbol, ts) is a key.
    """
    return tiles.covariances(returns)


def variances(returns: DataFrame) -> DataFrame:
    """(sym_i, sym_j, cov): the diagonal of pair_covariance alone, from sums of each symbol; zeros enter through the grid size."""
    g = returns.agg(F.count_distinct("ts").alias("g"))
    own = returns.groupBy("symbol").agg(F.avg("ret").alias("_m"), F.count("ret").alias("_k"), F.var_pop("ret").alias("_v")).join(F.broadcast(g))
    # squares about the mean of all grid points: within the present returns, and between these and the zeros
    squares = F.col("_k") * F.col("_v") + F.col("_k") * F.col("_m") * F.col("_m") * (F.col("g") - F.col("_k")) / F.col("g")
    return own.select(F.col("symbol").alias("sym_i"), F.col("symbol").alias("sym_j"), F.when(F.col("g") > 1, squares / F.greatest(F.col("g") - 1, F.lit(1))).alias("cov"))


def bitemporal_cov(intraday: DataFrame, daily: DataFrame, kappa: DataFrame) -> DataFrame:
    """Weekly covariance: the block of intraday symbols from bar returns times kappa, all others from daily ones times 5.

    intraday holds the bar returns of the intraday classes, daily the daily returns of all classes.
    """
    fast = pair_covariance(intraday).join(F.broadcast(kappa.select("kappa"))).select("sym_i", "sym_j", (F.col("cov") * F.col("kappa")).alias("cov"))
    members = intraday.select("symbol", F.lit(True).alias("_fast")).distinct()
    own = daily.join(members, "symbol", "left").withColumn("_fast", F.col("_fast").isNotNull())
    slow = tiles.covariances(own, but="_fast").select("sym_i", "sym_j", (F.col("cov") * 5).alias("cov"))
    return fast.unionByName(slow)


def rolling_cov(returns: DataFrame, n: int = 20, ridge: float = 1e-5) -> DataFrame:
    """Covariance of the last n common returns per date and pair i <= j of (symbol, date, ret); ridge on the diagonal.

    Running sums within pairs of tiles (see functions/tiles.py); (symbol, date) is a key, rows without a return are left out.
    """
    x = tiles.rolling_pairs(returns.where("ret is not null").withColumnRenamed("date", "ts"), n)
    return x.select(F.col("ts").alias("date"), "sym_i", "sym_j", (F.col("cov") + F.when(F.col("sym_i") == F.col("sym_j"), ridge).otherwise(0.0)).alias("cov"))


def cov_vols(cov: DataFrame) -> DataFrame:
    return cov.where("sym_i = sym_j").select(F.col("sym_i").alias("symbol"), F.sqrt("cov").alias("vol"))


def mirrored(cov: DataFrame) -> DataFrame:
    return cov.unionByName(cov.where("sym_i < sym_j").select(F.col("sym_j").alias("sym_i"), F.col("sym_i").alias("sym_j"), "cov"))


def cov_bounds(cov: DataFrame) -> DataFrame:
    """Bounds of all eigenvalues from row sums, and what follows for condition and definiteness: one row."""
    diag = F.when(F.col("sym_i") == F.col("sym_j"), F.col("cov")).otherwise(0.0)
    off = F.when(F.col("sym_i") != F.col("sym_j"), F.abs("cov")).otherwise(0.0)
    rows = mirrored(cov).groupBy("sym_i").agg(F.sum(diag).alias("d"), F.sum(off).alias("r"))
    return _bounds(rows)


def _bounds(rows: DataFrame) -> DataFrame:
    out = rows.agg(F.min(F.col("d") - F.col("r")).alias("lower"), F.max(F.col("d") + F.col("r")).alias("upper"))
    return out.withColumns({"condition_bound": F.when(F.col("lower") > 0, F.col("upper") / F.col("lower")), "surely_definite": F.col("lower") > 0})


def panel_bounds(returns: DataFrame) -> DataFrame:
    """cov_bounds of pair_covariance, whose pairs are added up inside their tiles."""
    return _bounds(tiles.row_sums(returns))


def cov_condition(cov: DataFrame, floor: float = 1e-6, most: float = 1e4, bounds: DataFrame | None = None) -> DataFrame:
    """The matrix with a shift on its diagonal so that the least eigenvalue and the condition number keep their limits.

    bounds: one row (lower, upper), by default from row sums; those of spectrum.cov_spectrum give a smaller shift.
    """
    eps = F.greatest(floor - F.col("lower"), (F.col("upper") - most * F.col("lower")) / (most - 1), F.lit(0.0))
    shift = (cov_bounds(cov) if bounds is None else bounds).select(eps.alias("eps"))
    return cov.join(F.broadcast(shift)).select("sym_i", "sym_j", (F.col("cov") + F.when(F.col("sym_i") == F.col("sym_j"), F.col("eps")).otherwise(0.0)).alias("cov"), "eps")


def conditioned_covariance(returns: DataFrame) -> DataFrame:
    """cov_condition of pair_covariance with the bounds of panel_bounds; both read tiles that are written once."""
    tiled = tiles.on_grid(returns)
    return cov_condition(tiles.covariances(returns, tiled=tiled), bounds=_bounds(tiles.row_sums(returns, tiled)))


def adv20(df: DataFrame, n: int = 20) -> DataFrame:
    """Mean traded value of the last 20 days."""
    daily = df.groupBy("symbol", "asset_type", "date").agg(F.sum(F.col("close") * F.col("volume")).alias("v"))
    latest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    recent = daily.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n)
    return recent.groupBy("symbol", "asset_type").agg(F.avg("v").alias("adv"))


def penalties(df: DataFrame, capital: float = 1e6) -> DataFrame:
    """Effective daily value, impact and settlement penalties per symbol."""
    ratio = auction_ratio_ma20(df).select("symbol", "auction_ratio")
    latest = df.groupBy("symbol").agg(F.max_by("settlement_days", "date").alias("s"))
    x = adv20(df).join(ratio, "symbol", "left").join(snapshot_volatility(df).select("symbol", "vol"), "symbol", "left").join(latest, "symbol", "left")
    days = F.coalesce("s", cascade((F.col("asset_type") == "EQUITY", 2), (F.col("asset_type") == "TEFAS_LIQUID", 0), otherwise=1))
    x = x.withColumn("adv_effective", F.greatest(F.col("adv") * F.coalesce(finite(F.col("auction_ratio")), F.lit(1.0)), F.lit(1e-6)))
    impact = F.when(F.col("asset_type").isin(*NAV), 0.0).otherwise(F.coalesce(finite(0.01 * F.col("vol") * capital * capital / (F.col("adv_effective") * F.col("adv_effective"))), F.lit(0.0)))
    return x.select("symbol", "asset_type", "adv", "adv_effective", "vol", impact.alias("impact"), (0.001 * days).alias("settlement"))


def total_penalty(penalty: DataFrame, bounds: DataFrame) -> DataFrame:
    """Impact plus settlement, at most a hundred times the largest eigenvalue bound."""
    return penalty.join(F.broadcast(bounds.select("upper"))).select("symbol", F.least(F.col("impact") + F.col("settlement"), 100 * F.col("upper")).alias("penalty"))


def risk_report(df: DataFrame, cov: DataFrame) -> DataFrame:
    """One row per symbol: auction ratio, volatility and conditioned variance."""
    variance = cov.where("sym_i = sym_j").select(F.col("sym_i").alias("symbol"), F.col("cov").alias("variance"))
    return auction_ratio_ma20(df).join(snapshot_volatility(df).select("symbol", "vol"), "symbol", "left").join(variance, "symbol", "left")


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope over the rows where both are there."""
    return F.regr_slope(y, x)


def beta_table(returns: DataFrame, market: DataFrame, debt: Column | None = None, tax: float = 0.2) -> DataFrame:
    """Beta per symbol (symbol, date, ret) against a market (date, mkt): raw, adjusted, unlevered, up and down market."""
    x = returns.join(market, "date")
    de = F.lit(0.5) if debt is None else debt
    out = x.groupBy("symbol").agg(slope(F.col("ret"), F.col("mkt")).alias("beta"), correlation("ret", "mkt").alias("corr"), slope(F.when(F.col("mkt") > 0, F.col("ret")), F.when(F.col("mkt") > 0, F.col("mkt"))).alias("up"), slope(F.when(F.col("mkt") < 0, F.col("ret")), F.when(F.col("mkt") < 0, F.col("mkt"))).alias("down"), F.count("*").alias("n"))
    out = out.where("n >= 3").withColumn("blume", 0.67 * F.col("beta") + 0.33)
    return out.select("symbol", "beta", "corr", "blume", (F.col("beta") / (1 + (1 - tax) * de)).alias("unlevered"), "up", "down", F.when(F.col("down") > 0, F.col("up") / F.col("down")).otherwise(1.0).alias("asymmetry"), F.when(F.col("blume") > 1.2, 0.80).otherwise(0.50).alias("score"), cascade((F.col("blume") > 1.2, "OVERWEIGHT_IN_BULL_MARKET"), (F.col("blume") < 0.7, "DEFENSIVE_SAFE_HAVEN"), otherwise="NEUTRAL_MARKET_PERFORMANCE").alias("label"))


def sharpe_table(returns: DataFrame, per_year: float = 252.0, rf: float = 0.05, trials: int = 10) -> DataFrame:
    """Sharpe ratio per symbol, corrected for autocorrelation (lag one), for skew and kurtosis, and for trials."""
    x = returns.withColumn("_prev", F.lag("ret").over(series()))
    m = x.groupBy("symbol").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.count("ret").alias("n"), F.avg(F.col("ret") ** 2).alias("m2"), F.avg(F.col("ret") ** 3).alias("m3"), F.avg(F.col("ret") ** 4).alias("m4"), correlation("ret", "_prev").alias("rho"))
    m = m.where("n >= 3 and s > 1e-12")
    var = F.col("m2") - F.col("m") ** 2
    skew = (F.col("m3") - 3 * F.col("m") * F.col("m2") + 2 * F.col("m") ** 3) / F.pow(var, 1.5)
    kurt = (F.col("m4") - 4 * F.col("m") * F.col("m3") + 6 * F.col("m") ** 2 * F.col("m2") - 3 * F.col("m") ** 4) / (var * var)
    m = m.withColumns({"sharpe": (F.col("m") - rf / 252.0) * per_year / (F.col("s") * math.sqrt(per_year)), "skew": skew, "kurt": kurt, "deflated": F.lit(max(0.0, 1 - 0.005 * trials))})
    lo = F.col("sharpe") / F.sqrt(1 + 2 * F.coalesce(F.greatest("rho", F.lit(-0.45)), F.lit(0.0)))
    sr = F.col("sharpe")
    return m.select("symbol", "sharpe", lo.alias("lo_sharpe"), (sr * (1 + F.col("skew") / 6 * sr - (F.col("kurt") - 3) / 24 * sr * sr)).alias("adjusted_sharpe"), "skew", "kurt", "deflated", (F.col("skew") < -0.5).alias("tail_risk"), F.when(F.col("deflated") < 0.85, 0.64).otherwise(0.85).alias("score"))


def free_float_table(df: DataFrame) -> DataFrame:
    """Float share, value, rotation, cornering index and the block on micro floats, from shares and price columns."""
    pct = F.col("free_float_shares") / F.col("total_shares") * 100
    value = F.col("free_float_shares") * F.col("price")
    x = df.withColumns({"float_pct": pct, "float_value": value})
    size = F.when(F.col("float_value") > 1, F.log10("float_value")).otherwise(1.0)
    x = x.withColumn("cri", F.when(F.col("float_pct") > 0, 1 / (size * F.col("float_pct") / 100)).otherwise(99.0))
    x = x.withColumn("blocked", (F.col("float_pct") < 10) | (F.col("cri") > 8))
    return x.withColumns({"rotation": F.when(F.col("free_float_shares") > 0, F.col("volume") / F.col("free_float_shares")).otherwise(0.0), "risk_score": clip(F.col("cri") / 10, 0, 1)})


def slippage_table(orders: DataFrame, alpha: float = 0.6, gamma: float = 0.5) -> DataFrame:
    """Executed price and slippage of orders (order_volume, adv, daily_vol, price, limit_down)."""
    adv = F.when(F.col("adv") > 0, F.col("adv")).otherwise(1.0)
    slip = F.greatest(F.lit(0.001), gamma * F.pow(F.col("order_volume") / adv, alpha) * F.col("daily_vol"))
    slip = F.when(F.col("limit_down"), 0.20).otherwise(slip)
    return orders.withColumn("slippage", slip).withColumns({"executed_price": F.col("price") * (1 - F.col("slippage")), "feasible": ~F.col("limit_down")})
