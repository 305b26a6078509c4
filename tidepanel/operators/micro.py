"""Microstructure over long tables (M1 to M5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.windows import cascade, rolled


def imbalance(bid: Column, ask: Column) -> Column:
    return F.when(bid + ask > 0, (bid - ask) / (bid + ask)).otherwise(0.0)


def book_imbalance(levels: DataFrame) -> DataFrame:
    """Imbalance per ticker and time, score, label, and the z of the depth change over the last 20 updates."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("volume")).otherwise(0.0))
    x = levels.groupBy("ticker", "ts").agg(side("BID").alias("bid"), side("ASK").alias("ask"))
    x = x.withColumn("obi", imbalance(F.col("bid"), F.col("ask")))
    w = Window.partitionBy("ticker").orderBy("ts")
    depth = F.col("bid") + F.col("ask")
    x = x.withColumn("_d", depth - F.lag(depth).over(w))
    s = rolled(F.stddev_samp, "_d", 20, 5, "ticker", "ts")
    z = F.when(s > 1e-9, (F.col("_d") - rolled(F.avg, "_d", 20, 5, "ticker", "ts")) / s).otherwise(0.0)
    return x.select("ticker", "ts", "bid", "ask", "obi", z.alias("depth_z"), (0.5 + 0.4 * F.col("obi")).alias("score"), cascade((F.col("obi") > 0.2, "BULLISH_ORDER_FLOW"), (F.col("obi") < -0.2, "BEARISH_ORDER_FLOW"), otherwise="NEUTRAL_ORDER_FLOW").alias("label"))


def broker_concentration(flow: DataFrame, k: int = 5) -> DataFrame:
    """Shares of the k largest net buyers and sellers, net concentration, dominant broker, regime, score."""
    key = ["ticker", "as_of"]
    rank = lambda c: F.row_number().over(Window.partitionBy(*key).orderBy(c, "broker"))
    x = flow.withColumns({"_b": rank(F.desc("net_lot")), "_s": rank(F.asc("net_lot"))})
    top = lambda r, ok: F.sum(F.when((F.col(r) <= k) & ok, F.abs("net_lot")).otherwise(0.0))
    out = x.groupBy(*key).agg(top("_b", F.col("net_lot") > 0).alias("b"), top("_s", F.col("net_lot") < 0).alias("s"), F.sum("gross_lot").alias("g"), F.max(F.when((F.col("_b") == 1) & (F.col("net_lot") > 0), F.col("broker"))).alias("dominant_broker"))
    g = F.when(F.col("g") > 0, F.col("g")).otherwise(1.0)
    out = out.select(*key, (F.col("b") / g).alias("buyer_share"), (F.col("s") / g).alias("seller_share"), ((F.col("b") - F.col("s")) / g).alias("concentration"), "dominant_broker")
    strong = F.col("buyer_share") > 0.7
    return out.withColumns({"regime": F.when(strong, "STRONG_INSTITUTIONAL_ACCUMULATION").otherwise("NEUTRAL"), "score": F.when(strong, 0.85).otherwise(0.50)})


def custody_concentration(custody: DataFrame, k: int = 3) -> DataFrame:
    """Share of the k largest custodians, index, tight-float flag and the change of the total from week to week."""
    key = ["ticker", "week"]
    x = custody.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("shares"), "custodian")))
    out = x.groupBy(*key).agg(F.sum(F.when(F.col("_n") <= k, F.col("shares")).otherwise(0.0)).alias("top"), F.sum("shares").alias("all"))
    out = out.withColumns({"top_share": F.col("top") / F.when(F.col("all") > 0, F.col("all")).otherwise(1.0), "weekly_change": F.col("all") - F.lag("all").over(Window.partitionBy("ticker").orderBy("week"))})
    return out.select(*key, "top_share", (1.1 * F.col("top_share")).alias("index"), (F.col("top_share") >= 0.70).alias("tight_float"), "weekly_change", F.when(F.col("top_share") >= 0.70, 0.80).otherwise(0.50).alias("score"))


def money_flow_fusion(df: DataFrame) -> DataFrame:
    """Stealth accumulation, four flow scores, overall signal and label from (obi, concentration, custody, net_flow,
    price_change); custody is the score of custody_concentration, 0.80 where there is none."""
    stealth = (F.col("price_change") < 0) & (F.col("net_flow") > 0)
    return df.withColumns({"regime": F.when(stealth, "STEALTH_ACCUMULATION_DETECTED").otherwise("NEUTRAL"), "order_book_score": 0.5 + 0.4 * F.col("obi"), "broker_score": 0.5 + 0.4 * F.col("concentration"), "custody_score": F.coalesce("custody", F.lit(0.80)), "money_flow_score": F.when(F.col("net_flow") > 0, 0.85).otherwise(0.40), "signal": F.when(stealth, 0.88).otherwise(0.50), "label": F.when(stealth, "STRONG_BULLISH_INSTITUTIONAL_BUY").otherwise("NEUTRAL")})


def macro_regime(df: DataFrame, volatility_limit: float = 30.0) -> DataFrame:
    """Cash state per date from (index, ema, vix, crash)."""
    crash = F.col("crash") | ((F.col("index") < F.col("ema")) & (F.col("vix") > volatility_limit))
    return df.withColumns({"cash": crash, "macro_state": F.when(crash, 0).otherwise(1), "multiplier": F.when(crash, 0.0).otherwise(1.0), "label": F.when(crash, "FORCE_CASH_SYSTEMIC_CRASH_PROTECTION").otherwise("NORMAL_MARKET_REGIME")})
