"""Factor library: the periodic set of twenty (F1 to F23) and the horizon set (H1 to H7).

All per-symbol windows come first, then all per-date ones, so that a whole set costs two shuffles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import wide
from tidepanel.functions.windows import average_rank, clip, cross_section, dates_indexed, last_rows, longer, series
from tidepanel.operators.ingest import NAV


def date_median(df: DataFrame, column: str, name: str, date: str = "date", pieces: int = 1) -> DataFrame:
    """df with the median of a column per date; grouped and joined back, since medians have no sliding form.

    pieces: tasks that may share one date (functions/wide.py).
    """
    if pieces > 1:
        return df.join(wide.quantiles(df, column, [0.5], date, pieces).withColumnRenamed("q0", name), date)
    medians = df.groupBy(date).agg(F.percentile(column, 0.5).alias(name))
    return df.join(medians, date)


def period_factors(df: DataFrame) -> DataFrame:
    """F1 to F20, the last three returns and the next return, for a panel (symbol, date, close, high, low, volume)."""
    w = series()
    x = df.withColumn("ret_1", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)))
    over = lambda fn, c, n: fn(c).over(last_rows(n))
    gain, loss = F.greatest("ret_1", F.lit(0.0)), F.greatest(-F.col("ret_1"), F.lit(0.0))
    mean20, max20, min20 = over(F.avg, "close", 20), over(F.max, "close", 20), over(F.min, "close", 20)
    x = x.withColumns(
        {
            "mom_4": over(F.sum, "ret_1", 4),
            "mom_12": over(F.sum, "ret_1", 12),
            "rsi_4": 1 - 1 / (1 + over(F.avg, gain, 4) / (over(F.avg, loss, 4) + 1e-6)),
            "vol_accel": F.when(over(F.avg, "volume", 4) > 0, F.col("volume") / over(F.avg, "volume", 4)).otherwise(1.0),
            "ma20_dist": F.col("close") / (mean20 + 1e-6) - 1,
            "high12_dist": F.col("close") / (over(F.max, "close", 12) + 1e-6) - 1,
            "vol_5": F.coalesce(over(F.stddev_samp, "ret_1", 5), F.lit(0.01)),
            "trend_slope": (F.col("ret_1") + F.lag("ret_1", 1).over(w)) / 2 - (F.lag("ret_1", 3).over(w) + F.lag("ret_1", 4).over(w)) / 2,
            "bb_bandwidth": (max20 - min20) / (mean20 + 1e-6 + 1e-5),
            "stoch_k": (F.col("close") - min20) / (max20 - min20 + 1e-5),
            "lag_1": F.lag("ret_1", 1).over(w),
            "lag_2": F.lag("ret_1", 2).over(w),
            "next_return": F.lead("ret_1").over(w),
        }
    )
    x = x.withColumns(
        {
            "stoch_d": over(F.avg, "stoch_k", 3),
            "vol_ratio": F.abs("ret_1") / (F.col("vol_5") + 1e-5),
            "mfi_proxy": F.col("ret_1") * F.col("vol_accel"),
            "macd_hist": F.col("mom_4") - F.col("mom_12") / 3,
            "sharpe_ratio": F.col("mom_12") / (F.col("vol_5") + 1e-5),
            "trend_slope": F.coalesce("trend_slope", F.lit(0.0)),
        }
    )
    day = cross_section()
    n = F.count("*").over(day)
    x = x.withColumns({"mkt_climate": F.avg("ret_1").over(day), "rank_mom4": 2 * average_rank("mom_4", "date") / n - 1})
    x = date_median(x.withColumn("rel_alpha", F.col("ret_1") - F.col("mkt_climate")), "ret_1", "_median")
    return x.withColumn("sector_rel_mom", F.col("ret_1") - F.col("_median")).drop("_median")


FACTORS = ("ret_1", "mom_4", "mom_12", "rsi_4", "vol_accel", "ma20_dist", "high12_dist", "vol_5", "rank_mom4", "trend_slope", "rel_alpha", "vol_ratio", "mkt_climate", "mfi_proxy", "bb_bandwidth", "macd_hist", "stoch_k", "stoch_d", "sharpe_ratio", "sector_rel_mom")


def clean(c: Column) -> Column:
    """NaN and null 0, infinities +-3."""
    return F.when(c.isNull() | F.isnan(c), 0.0).when(c == float("inf"), 3.0).when(c == float("-inf"), -3.0).otherwise(c)


def clean_features(df: DataFrame, columns=FACTORS, skip_dates: int = 5) -> DataFrame:
    """Features without NaN and infinities, without the first dates of the calendar, and the vector of the last returns."""
    idx = dates_indexed(df)
    x = df.join(idx, "date").where(F.col("idx") >= skip_dates)
    return x.withColumns({c: clean(F.col(c)) for c in columns}).withColumn("last3", F.array("lag_2", "lag_1", "ret_1")).drop("idx")


def _steps(n: int) -> dict[str, Column]:
    """Return of a row and the closes that the target of H6 looks ahead to."""
    w = series()
    lead = lambda k: F.lead("close", k).over(w)
    return {"_r": F.col("close") / F.lag("close").over(w) - 1, "_next": lead(1), "_later": lead(n), "_later_next": lead(n + 1)}


def _deviation(n: int) -> dict[str, Column]:
    return {"_k": F.count("_r").over(last_rows(n)), "_dev": F.stddev_samp("_r").over(last_rows(n))}


def _target(n: int) -> Column:
    vol = F.coalesce(F.when(F.col("_k") >= n, F.col("_dev")), F.lit(0.01)) + 1e-5
    ahead = lambda now, later: (F.col(later) - F.col(now)) / (F.col(now) + 1e-5)
    return F.when(F.col("asset_type").isin(*NAV), ahead("_next", "_later_next")).otherwise(ahead("close", "_later")) / vol


HELPERS = ("_r", "_next", "_later", "_later_next", "_k", "_dev", "_mean", "_pv", "_v", "_full", "_pv_short", "_v_short", "_pv_long", "_v_long")


def _histories(df: DataFrame, short: int, long: int) -> DataFrame:
    """df with what H1, H3, H5 and H6 take from the history of a symbol, and their helpers: windows over one sort, each window
    function once; sums over the long span are made of those over the short one where it is a multiple."""
    w, near, far = series(), last_rows(short), last_rows(long)
    pv, v = (F.col("close") * F.col("volume"), F.col("volume")) if "volume" in df.columns else (F.col("close"), F.lit(1.0))
    x = df.withColumns({"ret_21d": F.col("close") / F.lag("close", short).over(w) - 1, **_steps(short), "_pv": pv, "_v": v})
    x = x.withColumns({**_deviation(short), "_mean": F.avg("_r").over(near), "_full": F.count("_pv").over(near), "_pv_short": F.sum("_pv").over(near), "_v_short": F.sum("_v").over(near)})
    x = x.withColumns({c: F.when(F.col("_full") >= short, F.col(c)) for c in ("_pv_short", "_v_short")})
    over = lambda c: longer(f"{c}_short", short, long // short) if long % short == 0 else F.when(F.count("_pv").over(far) >= long, F.sum(c).over(far))
    x = x.withColumns({"_pv_long": over("_pv"), "_v_long": over("_v")})
    sharpe = F.when(F.col("_k") >= short, F.col("_mean") / (F.col("_dev") + 1e-5) * math.sqrt(252.0))
    return x.withColumns({"sharpe_momentum": sharpe, "vwap_ratio": F.col("_pv_short") / F.col("_v_short") / (F.col("_pv_long") / F.col("_v_long")) - 1})


def _against_medians(x: DataFrame, sector: str | None = None) -> DataFrame:
    median = lambda *keys: F.percentile("ret_21d", 0.5).over(Window.partitionBy(*keys))
    x = x.withColumn("macro_spread", median("date"))
    return x.withColumn("rs_sector", F.col("ret_21d") - (median("date", sector) if sector else F.col("macro_spread")))


def horizon_factors(df: DataFrame, short: int = 21, long: int = 63, sector: str | None = None) -> DataFrame:
    """H1 to H5: 21-row return, strength against the median of the date (of its sector, if a sector column is named), Sharpe
    momentum, ratio of volume-weighted means (of plain means, where df has no volume), the median of the date."""
    return _against_medians(_histories(df, short, long).drop(*HELPERS), sector)


def risk_adjusted_target(df: DataFrame, n: int = 21) -> DataFrame:
    """H6: return over the next 21 rows, one row later for NAV classes, divided by the 21-row deviation."""
    return df.withColumns(_steps(n)).withColumns(_deviation(n)).withColumn("target", _target(n)).drop(*HELPERS)


HORIZON = ("ret_21d", "rs_sector", "sharpe_momentum", "vwap_ratio", "macro_spread")


def rolling_dataset(df: DataFrame, warmup: int = 63, tail: int = 22, calendar: DataFrame | None = None) -> DataFrame:
    """H7: horizon factors and target, z-scored per date and class, without the warm-up and the tail of the calendar.

    calendar: the dates of df, repeated or not, where they are at hand in a form that costs less than df itself. All windows by
    symbol come first, then rows are dealt and sorted by date and class once: medians and z-scores are windows over that.
    """
    from tidepanel.operators.crosssec import class_zscores

    idx = dates_indexed(df if calendar is None else calendar)
    kept = idx.withColumn("_last", F.max("idx").over(Window.partitionBy())).where((F.col("idx") >= warmup) & (F.col("idx") <= F.col("_last") - tail)).select("date")
    x = _histories(df, 21, 63).withColumn("target", _target(21)).drop(*HELPERS)
    x = x.join(kept, "date", "left_semi").repartition("date").sortWithinPartitions("date", "asset_type")
    return class_zscores(_against_medians(x).fillna(0.0, [*HORIZON, "target"]), list(HORIZON), ["target"])


def clipped(c: Column) -> Column:
    return clip(c, -3, 3)
