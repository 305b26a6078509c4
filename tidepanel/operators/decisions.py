"""Fusion, decisions and signal queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.windows import cascade, clip, running, series

PARTS = {
    "fundamental": ("pe", "pb", "ebitda", "ev", "roe", "liquidity"),
    "technical": ("rsi", "ma", "macd", "bollinger", "volume", "fib"),
    "microstructure": ("book", "broker", "custody", "flow"),
    "risk": ("beta", "float_liquidity", "sharpe"),
}
SHARES = {"fundamental": 0.30, "technical": 0.25, "microstructure": 0.25, "risk": 0.20}


def master_fusion(df: DataFrame) -> DataFrame:
    """Composite of nineteen sub-scores (column <part>_score, missing or null 0.5), block, penalties, reasons, label, weight.

    Optional columns: cri, blocked, double_negative, distress, invalidated, tail_risk, stealth, confluence, accumulation.
    """
    has = set(df.columns)
    score = lambda p: F.coalesce(F.col(f"{p}_score"), F.lit(0.5)) if f"{p}_score" in has else F.lit(0.5)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in has else F.lit(False)
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in has else F.lit(0.0)
    x = df.withColumns({f"{g}_part": sum((score(p) for p in parts), F.lit(0.0)) / len(parts) for g, parts in PARTS.items()})
    raw = sum((SHARES[g] * F.col(f"{g}_part") for g in PARTS), F.lit(0.0))
    part = lambda c, v: F.when(flag(c), v).otherwise(1.0)
    composite = raw * part("double_negative", 0.5) * part("distress", 0.7) * part("invalidated", 0.8)
    blocked = flag("blocked") | (number("cri") > 8)
    x = x.withColumns({"hard_block": blocked, "composite": F.when(blocked, 0.0).otherwise(composite)})
    reasons = lambda *v: F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in v]))
    live = ~F.col("hard_block")
    x = x.withColumns(
        {
            "warnings": reasons((F.col("hard_block"), "low float block"), (live & flag("double_negative"), "double negative equity"), (live & flag("distress"), "liquidity distress"), (live & flag("invalidated"), "structure broken"), (live & flag("tail_risk"), "tail risk")),
            "drivers": reasons((live & flag("stealth"), "stealth accumulation"), (live & (number("confluence") >= 3), "level confluence"), (live & flag("accumulation"), "institutional accumulation")),
        }
    )
    c = F.col("composite")
    pick = lambda *v: cascade((F.col("hard_block"), v[0]), (c >= 0.80, v[1]), (c >= 0.65, v[2]), (c >= 0.40, v[3]), otherwise=v[4])
    return x.withColumns({"label": pick("REJECTED_LOW_FLOAT_CORNERING_RISK", "STRONG_BUY_INSTITUTIONAL_CONFLUENCE", "BUY_ACCUMULATE", "NEUTRAL_HOLD", "STRONG_SELL_REDUCE_EXPOSURE"), "weight_pct": pick(0.0, 12.5, 8.0, 4.0, 0.0)})


def meta_label(df: DataFrame) -> DataFrame:
    """Success probability, size and approval from (side, win_rate, spread, obi, volatility)."""
    penalty = F.least(F.lit(0.15), F.col("spread") * 10)
    boost = clip(F.col("obi") * 0.25, -0.15, 0.20) + clip((0.02 - F.col("volatility")) * 5, -0.10, 0.15)
    p = F.when(F.col("side") == 0, 0.5).otherwise(clip(F.col("win_rate") + boost - penalty, 0, 1))
    return df.withColumn("p_success", p).withColumns({"p_size": 2 * F.col("p_success") - 1, "approved": (F.col("side") != 0) & (F.col("p_success") >= 0.55)})


def engine_signals(df: DataFrame) -> DataFrame:
    """Engine A from (p_bull, p_bear), engine B from p_success."""
    a = cascade(((F.col("p_bull") > F.col("p_bear")) & (F.col("p_bull") >= 0.35), 1), (F.col("p_bear") > 0.45, -1), otherwise=0)
    b = cascade((F.col("p_success") >= 0.52, 1), (F.col("p_success") < 0.40, -1), otherwise=0)
    return df.withColumns({"engine_a": a, "engine_b": b})


# Name and advice for each pair of engine B and engine A.
MATRIX = (
    (1, 1, "AGRESIF FIRSAT KARTI", "Tam Kapasite Boga Firsati"),
    (1, 0, "MOMENTUM POZISYON", "Trend Guclu, Ek Alim Yapma"),
    (1, -1, "TREND KORU / DUZELTME", "Pozisyonu Koru, Yeni Alim Yapma"),
    (0, 1, "SCALPING FIRSATI", "5 Gunluk Kisa Vadeli Alim (Siki Stop)"),
    (0, 0, "NOTR / NAKIT", "Islemsiz Bekle (Nakit)"),
    (0, -1, "KISA VADELI BASKI", "Uzak Dur / Satis Baskisi Var"),
    (-1, 1, "TEPKI YUKSELISI TUZAGI", "ALMA! Olu Kedi Sicramasi Riski"),
    (-1, 0, "ZAYIF TREND / SAT", "Pozisyon Azalt / Cikis Arama"),
    (-1, -1, "TAM NAKIT / DEVRE KESICI", "Tam Kapasite Cikis / Risk Yok"),
)


def matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MATRIX, "engine_b int, engine_a int, signal string, advice string")


def consolidate(df: DataFrame) -> DataFrame:
    """Signal name and advice by a join with the nine-row matrix."""
    return df.join(F.broadcast(matrix(df.sparkSession)), ["engine_a", "engine_b"], "left")


def volatility_factor(atr: Column, price: Column) -> Column:
    return F.greatest(1.5 * atr / price, F.lit(0.04))


def price_targets(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """Low and high target and stop from (close, atr, p_success, code)."""
    v, code, p = volatility_factor(F.col("atr"), F.col("close")), F.col("code"), F.col("p_success")
    x = df.withColumn("_v", v)
    v = F.col("_v")
    low = cascade((code == 1, F.greatest(F.lit(0.045), (p - 0.50) * 0.30 + v)), (code == -1, F.lit(0.0)), otherwise=F.greatest(F.lit(0.015), v * 0.5))
    x = x.withColumn("_low", low)
    high = cascade((code == 1, F.col("_low") + v), (code == -1, F.greatest(F.lit(0.01), v * 0.3)), otherwise=F.col("_low") + v * 0.7)
    stop = cascade((code == -1, F.greatest(F.lit(0.045), v * 1.3)), otherwise=F.greatest(F.lit(0.035), v))
    price = F.col("close") * scale
    return x.withColumns({"target_low": price * (1 + F.col("_low")), "target_high": price * (1 + high), "stop": price * (1 - stop)}).drop("_v", "_low")


def stop_threshold(atr: Column, prev: Column) -> Column:
    return -F.greatest(1.8 * atr / prev, F.lit(0.04))


def eod_state(df: DataFrame) -> DataFrame:
    """Ordered state per symbol from (date, close, atr, p_success): sell, buy, or the state before.

    A row that decides nothing is a null event, and the last event before it holds; 0 before the first.
    """
    w = series()
    prev = F.lag("close").over(w)
    x = df.withColumns({"days_held": F.row_number().over(w) - 1, "p_prev": F.coalesce(F.lag("p_success").over(w), F.col("p_success")), "change": F.col("close") / prev - 1, "_limit": stop_threshold(F.col("atr"), prev)})
    p = F.col("p_success")
    sell = F.coalesce(F.col("change") <= F.col("_limit"), F.lit(False)) | (p < 0.40) | ((p < 0.45) & (F.col("days_held") >= 20))
    x = x.withColumn("_event", F.when(sell, -1).when(p >= 0.52, 1))
    return x.withColumn("code", F.coalesce(F.last("_event", ignorenulls=True).over(running()), F.lit(0))).drop("_event", "_limit")


def latest_signal(df: DataFrame) -> DataFrame:
    """The newest row of each symbol."""
    others = [c for c in df.columns if c != "symbol"]
    got = df.groupBy("symbol").agg(F.max_by(F.struct(*others), "date").alias("x"))
    return got.select("symbol", *[f"x.{c}" for c in others])


def scan_top_k(df: DataFrame, k: int = 5) -> DataFrame:
    """The k latest signals of each code with the highest probability."""
    w = Window.partitionBy("code").orderBy(F.desc("p_success"), "symbol")
    return latest_signal(df).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def watchlist_status(df: DataFrame, watchlist: DataFrame) -> DataFrame:
    return watchlist.join(latest_signal(df), "symbol", "left")


def watchlist_alerts(df: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Rows of watched symbols at which the state turned to buy or sell."""
    x = df.withColumn("code_before", F.coalesce(F.lag("code").over(series()), F.lit(0)))
    return x.where((F.col("code") != F.col("code_before")) & (F.col("code") != 0)).join(watchlist, "symbol", "left_semi")


def opportunity_cards(df: DataFrame, horizon: str = "month") -> DataFrame:
    """Card id, target range, stop, due date and status for (symbol, date, close)."""
    low, high, stop, days = (1.10, 1.15, 0.95, 30) if horizon == "month" else (1.06, 1.09, 0.964, 7)
    return df.select(F.concat(F.lit("REC_"), F.date_format("date", "yyyyMMdd"), F.lit("_"), F.col("symbol").cast("string")).alias("rec_id"), "symbol", "date", (F.col("close") * low).alias("target_low"), (F.col("close") * high).alias("target_high"), (F.col("close") * stop).alias("stop"), F.date_add("date", days).alias("due_date"), F.lit("PENDING").alias("status"))


def advisory_table(df: DataFrame, parts: list[str], k: int = 2) -> DataFrame:
    """Action, confidence, recommended weight, the largest positive and negative contributions of the part scores, sector exposure.

    df: symbol, date, sector, p_success, weight and a column <part>_score per part.
    """
    each = F.array(*[F.struct((F.col(f"{p}_score") - 0.5).alias("v"), F.lit(p).alias("part")) for p in parts])
    up = F.slice(F.reverse(F.array_sort(F.filter(each, lambda s: s.v > 0))), 1, k)
    down = F.slice(F.array_sort(F.filter(each, lambda s: s.v < 0)), 1, k)
    buy = F.col("p_success") > 0.60
    exposure = F.sum("weight").over(Window.partitionBy("date", "sector"))
    return df.select("symbol", "date", F.when(buy, "ACCUMULATE_BUY").otherwise("NEUTRAL_HOLD").alias("action"), (F.col("p_success") * 100).alias("confidence_pct"), (100 * F.col("weight")).alias("weight_pct"), F.concat_ws(",", F.transform(up, lambda s: s.part)).alias("positive"), F.concat_ws(",", F.transform(down, lambda s: s.part)).alias("negative"), exposure.alias("sector_exposure"))


def top_bottom(df: DataFrame, k: int = 3, score: str = "score") -> DataFrame:
    """Rank per date and the first and last k."""
    rank = lambda c: F.row_number().over(Window.partitionBy("date").orderBy(c, "symbol"))
    x = df.withColumns({"rank_top": rank(F.desc(score)), "rank_bottom": rank(F.asc(score))})
    return x.where((F.col("rank_top") <= k) | (F.col("rank_bottom") <= k))


def quota_top_k(df: DataFrame, k: int = 3, max_funds: int = 1, keys: tuple[str, ...] = ("date",), score: str = "score") -> DataFrame:
    """The k best of each date among which at most max_funds are funds."""
    fund = ~F.col("asset_type").isin("EQUITY")
    place = F.row_number().over(Window.partitionBy(*keys, fund).orderBy(F.desc(score), "symbol"))
    x = df.withColumn("_n", place).where(~fund | (F.col("_n") <= max_funds)).drop("_n")
    return x.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), "symbol"))).where(F.col("place") <= k)


def consensus_gate(passes: DataFrame, k: int = 3, least: float = 0.60) -> DataFrame:
    """Votes over stochastic passes (date, pass, symbol, asset_type, score): chosen assets, consensus share, gate."""
    n = passes.groupBy("date").agg(F.count_distinct("pass").alias("passes"))
    votes = quota_top_k(passes, k, keys=("date", "pass")).groupBy("date", "symbol", "asset_type").agg(F.count("*").cast("double").alias("votes"))
    chosen = quota_top_k(votes, k, score="votes").groupBy("date").agg(F.sum("votes").alias("got"), F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("chosen"))
    out = chosen.join(n, "date").withColumn("consensus", F.col("got") / (k * F.col("passes")))
    return out.select("date", "chosen", "consensus", (F.col("consensus") >= least).alias("confident"))


def card_metrics(df: DataFrame) -> DataFrame:
    """Distances in percent from the price to targets and stop (fallbacks where missing), remaining days."""
    price = F.col("close")
    dist = lambda c, share: (F.coalesce(F.col(c), price * share) / price - 1) * 100
    return df.withColumns({"low_pct": dist("target_low", 1.075), "high_pct": dist("target_high", 1.095), "stop_pct": dist("stop", 0.96), "days_left": F.greatest(20 - F.col("days_held"), F.lit(1))})
