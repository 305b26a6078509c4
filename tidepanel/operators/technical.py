"""Technical indicators per symbol over time (T1 to T14). Recursive averages are scans of affine maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scan import affine_scan
from tidepanel.functions.windows import cascade, last_rows, rolled, running, series


def moving_stats(df: DataFrame, n: int = 20, at_least: int = 5) -> DataFrame:
    """sma, std (ddof 1) and z-score of close, z-score of volume."""
    out = df.withColumns({"sma": rolled(F.avg, "close", n, at_least), "std": rolled(F.stddev_samp, "close", n, at_least), "_vm": rolled(F.avg, "volume", n, at_least), "_vs": rolled(F.stddev_samp, "volume", n, at_least)})
    low = lambda c: F.when(F.col(c) < 1e-5, 1e-5).otherwise(F.col(c))
    return out.withColumns({"zscore_price": (F.col("close") - F.col("sma")) / low("std"), "zscore_volume": (F.col("volume") - F.col("_vm")) / low("_vs")}).drop("_vm", "_vs")


def ema(df: DataFrame, spans: dict[str, int], column: str = "close", key: str = "symbol", order: str = "date") -> DataFrame:
    """(key, order, averages): exponential averages seeded with the first value, alpha 2 / (span + 1); spans by name of the
    result. Rows without a value are left out."""
    x = df.where(F.col(column).isNotNull()).select(key, order, F.col(column).alias("_x"))
    alpha = {name: 2.0 / (n + 1) for name, n in spans.items()}
    return affine_scan(x, {name: (F.lit(1 - al), al * F.col("_x")) for name, al in alpha.items()}, dict.fromkeys(spans, F.col("_x")), key, order, seeded=True).drop("_x")


def ppo_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, adx: float = 25.0) -> DataFrame:
    """Percentage oscillator, signal line, histogram and its differences, zero-line state, cross and its age, score, label."""
    x = ema(df, {"_fast": fast, "_slow": slow})
    low = F.greatest("_slow", F.lit(0.001))
    x = x.select("symbol", "date", ((F.col("_fast") - F.col("_slow")) / low * 100).alias("ppo"))
    alpha = 2.0 / (signal + 1)
    x = affine_scan(x, {"signal": (F.lit(1 - alpha), alpha * F.col("ppo"))}, {"signal": F.col("ppo")}, seeded=True)
    w = series()
    x = x.withColumn("hist", F.col("ppo") - F.col("signal"))
    x = x.withColumn("delta", F.col("hist") - F.lag("hist").over(w)).withColumn("accel", F.col("delta") - F.lag("delta").over(w))
    x = x.withColumn("bullish_cross", F.col("ppo") > F.col("signal"))
    change = (F.col("bullish_cross") != F.lag("bullish_cross").over(w)).cast("int")
    x = x.withColumn("_run", F.sum(F.coalesce(change, F.lit(0))).over(running()))
    x = x.withColumn("cross_age", F.row_number().over(series(["symbol", "_run"])) - 1).drop("_run")
    above = F.col("ppo") > 0
    return x.select("symbol", "date", "ppo", "signal", "hist", "delta", "accel", F.when(above, "ABOVE_ZERO_BULLISH").otherwise("BELOW_ZERO_BEARISH").alias("zero_line"), "bullish_cross", "cross_age", cascade((F.col("bullish_cross") & above, 0.85), (F.col("bullish_cross"), 0.65), otherwise=0.25).alias("score"), cascade((F.col("bullish_cross") & above, "BULLISH_ACCELERATION"), (F.col("bullish_cross"), "BEAR_MARKET_RALLY_BOUNCE"), otherwise="BEARISH_MOMENTUM").alias("label"), F.coalesce((F.col("hist") > 0) & (F.col("delta") < 0), F.lit(False)).alias("decelerating"), F.lit(adx < 18).alias("whipsaw"))


def rsi_wilder(df: DataFrame, n: int = 14) -> DataFrame:
    """RSI with the first n changes averaged and Wilder's smoothing after; null before, and its change from row to row."""
    w = series()
    change = F.col("close") - F.lag("close").over(w)
    x = df.select("symbol", "date", change.alias("_d"), F.count("*").over(last_rows(n + 2)).alias("_row"))
    seed, later = F.col("_row") == n + 1, F.col("_row") > n + 1
    sides = {"_gain": F.greatest(F.col("_d"), F.lit(0.0)), "_loss": F.greatest(-F.col("_d"), F.lit(0.0))}
    x = x.withColumns({f"{name}0": F.avg(side).over(last_rows(n)) for name, side in sides.items()})
    maps = {name: (F.when(later, 1 - 1.0 / n).otherwise(0.0), F.when(later, side / n).when(seed, F.col(f"{name}0")).otherwise(0.0)) for name, side in sides.items()}
    x = affine_scan(x, maps, dict.fromkeys(sides, F.lit(0.0)))
    x = x.withColumn("rsi", F.when(seed | later, 100 - 100 / (1 + F.col("_gain") / F.greatest("_loss", F.lit(0.0001)))))
    return x.select("symbol", "date", "rsi", (F.col("rsi") - F.lag("rsi").over(w)).alias("velocity"))


def rsi_simple(df: DataFrame, n: int = 20, at_least: int = 5) -> DataFrame:
    """RSI from rolling mean gain and loss; the first row counts as no change."""
    d = F.coalesce(F.col("close") - F.lag("close").over(series()), F.lit(0.0))
    x = df.withColumn("_d", d)
    gain, loss = rolled(F.avg, F.greatest(F.col("_d"), F.lit(0.0)), n, at_least), rolled(F.avg, F.greatest(-F.col("_d"), F.lit(0.0)), n, at_least)
    low = F.when(loss < 1e-5, 1e-5).otherwise(loss)
    return x.withColumn("rsi_simple", 100 - 100 / (1 + gain / low)).drop("_d")


def rsi_signal(rsi: DataFrame, adx: float = 25.0) -> DataFrame:
    """Thresholds by trend strength, override, divergence against the first bar, score and label (needs rsi and close)."""
    high, low = (80, 40) if adx > 35 else (60, 20) if adx < 20 else (75, 32)
    over, under = F.col("rsi") > high, F.col("rsi") < low
    override = F.lit(adx > 35) & (F.col("rsi") > 70)
    divergent = F.col("close") > F.first("close").over(running())
    case = lambda *v: cascade((override, v[0]), (divergent, v[1]), (over, v[2]), (under, v[3]), otherwise=v[4])
    x = rsi.where("rsi is not null")
    return x.select("symbol", "date", "rsi", over.alias("is_overbought"), under.alias("is_oversold"), override.alias("trend_override"), divergent.alias("bearish_divergence"), case(0.90, 0.35, 0.25, 0.75, 0.50).alias("score"), case("BULLISH_MOMENTUM_SURF", "BEARISH_REVERSAL_RISK", "OVERBOUGHT_SELL_SIGNAL", "OVERSOLD_BUY_SIGNAL", "NEUTRAL_MOMENTUM").alias("label"))


def atr(df: DataFrame, n: int = 20, at_least: int = 5) -> DataFrame:
    """Mean of the larger of range and move from the previous close; the first row has no true range."""
    prev = F.lag("close").over(series())
    x = df.withColumn("_tr", F.when(prev.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("close") - prev))))
    return x.withColumn("atr", rolled(F.avg, "_tr", n, at_least)).drop("_tr")


def ma_cross(df: DataFrame, short: int = 50, long: int = 200, adx: float = 25.0) -> DataFrame:
    """Two averages over partial windows, spread, slope, state, age of the state, distance, flags, score and label."""
    w = series()
    x = df.withColumns({"ma_short": F.avg("close").over(last_rows(short)), "ma_long": F.avg("close").over(last_rows(long)), "_n": F.row_number().over(w), "_first": F.first("close").over(running())})
    x = x.withColumns({"spread": (F.col("ma_short") / F.col("ma_long") - 1) * 100, "slope": (F.col("ma_long") - F.col("_first")) / F.col("_n"), "golden": F.col("ma_short") > F.col("ma_long"), "distance": F.col("close") / F.col("ma_long") - 1})
    x = x.withColumn("_run", F.sum(F.coalesce((F.col("golden") != F.lag("golden").over(w)).cast("int"), F.lit(0))).over(running()))
    x = x.withColumns({"cross_age": F.row_number().over(series(["symbol", "_run"])) - 1, "distance_z": F.col("distance") / 0.119})
    whip = F.lit(adx < 18)
    over = F.abs("distance_z") > 2.5
    case = lambda *v: cascade((whip, v[0]), (over, v[1]), (F.col("golden") & (F.col("slope") >= 0), v[2]), (~F.col("golden") & (F.col("slope") <= 0), v[3]), otherwise=v[4])
    return x.select("symbol", "date", "ma_short", "ma_long", "spread", "slope", "golden", "cross_age", "distance", "distance_z", over.alias("overextended"), case(0.50, 0.20, 0.88, 0.15, 0.50).alias("score"), case("NEUTRAL_WHIPSAW_RISK", "MEAN_REVERSION_OVEREXTENDED", "STRONG_BULLISH_TREND", "STRONG_BEARISH_TREND", "NEUTRAL_TREND").alias("label"))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, adx: float = 25.0) -> DataFrame:
    """Bands with population deviation, bandwidth and its rolling z, %b, squeeze and its length, direction, score, label.

    Rows before the first full window are left out.
    """
    x = df.withColumns({"mid": rolled(F.avg, "close", n, n), "_s": rolled(F.stddev_pop, "close", n, n)}).where("mid is not null")
    x = x.withColumns({"upper": F.col("mid") + k * F.col("_s"), "lower": F.col("mid") - k * F.col("_s")})
    x = x.withColumns({"bandwidth": (F.col("upper") - F.col("lower")) / F.greatest(F.lit(0.001), F.col("mid")), "pct_b": (F.col("close") - F.col("lower")) / F.greatest(F.lit(0.001), F.col("upper") - F.col("lower"))})
    sd = rolled(F.stddev_samp, "bandwidth", n, 5)
    x = x.withColumn("bandwidth_z", F.when(sd > 1e-9, (F.col("bandwidth") - rolled(F.avg, "bandwidth", n, 5)) / sd).otherwise(0.0))
    x = x.withColumn("squeeze", F.col("bandwidth_z") < -1.5)
    x = x.withColumn("_run", F.sum((~F.col("squeeze")).cast("int")).over(running()))
    x = x.withColumn("squeeze_run", F.sum(F.col("squeeze").cast("int")).over(running(["symbol", "_run"])))
    above, strong, weak = F.col("pct_b") > 1, F.lit(adx > 30), F.lit(adx < 20)
    case = lambda *v: cascade((above & strong, v[0]), (above & weak, v[1]), (above, v[2]), (F.col("pct_b") < 0, v[3]), otherwise=v[4])
    return x.select("symbol", "date", "upper", "mid", "lower", "bandwidth", "pct_b", "bandwidth_z", "squeeze", "squeeze_run", F.when(F.col("pct_b") > 0.5, "UPWARD_EXPANSION").otherwise("DOWNWARD_EXPANSION").alias("direction"), case(0.93, 0.15, 0.70, 0.10, 0.50).alias("score"), case("STRONG_BULLISH_BREAKOUT", "MEAN_REVERSION_OVERBOUGHT", "MODERATE_UPWARD_EXPANSION", "BEARISH_BAND_WALKING_DOWN", "NEUTRAL_IN_BAND").alias("label"))


def obv(df: DataFrame, start: float = 1_000_000.0) -> DataFrame:
    """Cumulative signed volume and its mean over the last 20 rows."""
    move = F.coalesce(F.signum(F.col("close") - F.lag("close").over(series())), F.lit(0.0)) * F.col("volume")
    x = df.withColumn("_m", move).withColumn("obv", start + F.sum("_m").over(running())).drop("_m")
    return x.withColumn("obv_mean", F.avg("obv").over(last_rows(20)))


def rvol_flow(df: DataFrame) -> DataFrame:
    """Volume against its mean so far, bid-ask delta, spike and illiquidity flags, divergence of price and flow, score, label.

    The delta is what buyers took less what sellers gave (bid_volume, ask_volume, if df has them); 0 where that is unknown.
    """
    sides = {"bid_volume", "ask_volume"} <= set(df.columns)
    delta = F.coalesce("bid_volume", F.lit(0.0)) - F.coalesce("ask_volume", F.lit(0.0)) if sides else F.lit(0.0)
    x = obv(df).withColumns({"rvol": F.col("volume") / F.greatest(F.lit(1.0), F.avg("volume").over(running())), "_dp": F.col("close") - F.first("close").over(running()), "_do": F.col("obv") - F.first("obv").over(running())})
    hidden = (F.col("_dp") < 0) & (F.col("_do") > 0)
    case = lambda *v: cascade((hidden, v[0]), ((F.col("_dp") > 0) & (F.col("rvol") < 0.6), v[1]), (F.col("rvol") > 2, v[2]), otherwise=v[3])
    return x.select("symbol", "date", "obv", "obv_mean", "rvol", delta.alias("delta"), (F.col("rvol") > 2).alias("is_spike"), (F.col("rvol") < 0.5).alias("is_illiquid"), hidden.alias("accumulation"), case(0.90, 0.18, 0.85, 0.50).alias("score"), case("SMART_MONEY_ACCUMULATION", "UNSUPPORTED_VOLUME_TRAP", "STRONG_VOLUME_BREAKOUT", "NEUTRAL_VOLUME_FLOW").alias("label"))


RETRACEMENTS = {"level_236": 0.236, "level_382": 0.382, "level_500": 0.5, "level_618": 0.618, "level_650": 0.65, "level_786": 0.786}


def fib_levels(df: DataFrame, lookback: int = 60, tolerance: float = 0.02) -> DataFrame:
    """Retracements of the swing over the look-back, zone of the close, invalidation, confluence with the 20-row mean and
    the previous swing low."""
    w = last_rows(lookback)
    x = df.withColumns({"swing_high": F.max(F.when(F.col("high") > 0, F.col("high")).otherwise(F.col("close"))).over(w), "swing_low": F.min(F.when(F.col("low") > 0, F.col("low")).otherwise(F.col("close"))).over(w), "_mean": F.avg("close").over(last_rows(20))})
    diff = F.col("swing_high") - F.col("swing_low")
    x = x.withColumns({name: F.col("swing_high") - diff * share for name, share in RETRACEMENTS.items()})
    near = lambda a, b: (F.abs(a - b) <= tolerance * F.abs(F.col("close"))).cast("int")
    x = x.withColumn("confluence", sum((near(F.col("close"), F.col(name)) for name in RETRACEMENTS), F.lit(0)) + near(F.col("close"), F.col("_mean")))
    broken = F.col("close") < F.col("level_786")
    zone = cascade((broken, "BELOW_0786_BROKEN"), (F.col("close") < F.col("level_618"), "LEVEL_0786"), (F.col("close") < F.col("level_500"), "LEVEL_0618"), (F.col("close") < F.col("level_382"), "LEVEL_0500"), (F.col("close") < F.col("level_236"), "LEVEL_0382"), otherwise="ABOVE_0236")
    return x.select("symbol", "date", "swing_high", "swing_low", *RETRACEMENTS, zone.alias("zone"), broken.alias("invalidated"), F.when(broken, 0).otherwise(F.col("confluence")).alias("confluence"), F.when(broken, 0.12).otherwise(0.85).alias("score"), F.when(broken, "MARKET_STRUCTURE_INVALIDATION").otherwise("SUPPORT_REVERSAL_ZONE").alias("label"))
