"""Structured Streaming forms (ST1 to ST7): each takes a streaming (or, for the same result, a batch) table of events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidepanel.functions.windows import cascade
from tidepanel.operators.decisions import stop_threshold
from tidepanel.operators.ingest import INTRADAY, NAV
from tidepanel.streaming.ordered import in_order


def gap_sentinel(ticks: DataFrame, latest: DataFrame) -> DataFrame:
    """Ticks (symbol, ts, price) at or below the stop, or down by more than the threshold, of the latest signals
    (symbol, stop, atr, prev_close), a static table."""
    x = ticks.join(latest, "symbol").withColumn("change", F.col("price") / F.col("prev_close") - 1)
    stop, gap = F.col("price") <= F.col("stop"), F.col("change") <= stop_threshold(F.col("atr"), F.col("prev_close"))
    return x.where(stop | gap).select("symbol", "ts", "price", "change", cascade((stop, "STOP"), otherwise="GAP").alias("alert"))


def _watch(key: tuple, signal: tuple | None, row: Row) -> tuple[tuple | None, list[tuple]]:
    if row.is_signal:
        return (row.stop, row.atr, row.prev_close), []
    if signal is None:
        return None, []
    stop, atr, before = signal
    # as floating point has it: nothing falls from a price of zero
    change = row.price / before - 1 if before else math.copysign(math.inf, row.price) if row.price else math.nan
    if row.price <= stop or (before and change <= -max(1.8 * atr / before, 0.04)):
        return signal, [(key[0], row.ts, row.price, change, "STOP" if row.price <= stop else "GAP")]
    return signal, []


def stream_gap_sentinel(ticks: DataFrame, signals: DataFrame, late: str = "1 hour") -> DataFrame:
    """The sentinel with signals as a second stream: each tick (symbol, ts, price) against the latest signal (symbol, ts, stop,
    atr, prev_close) at or before it, whatever order both arrive in within the watermark. Ticks before the first signal pass."""
    symbol = dict(ticks.dtypes)["symbol"]
    nothing = [F.lit(None).cast("double").alias(c) for c in ("stop", "atr", "prev_close")]
    both = ticks.select("symbol", "ts", F.lit(False).alias("is_signal"), "price", *nothing).unionByName(signals.select("symbol", "ts", F.lit(True).alias("is_signal"), F.lit(None).cast("double").alias("price"), "stop", "atr", "prev_close"))
    out = f"symbol {symbol}, ts timestamp, price double, change double, alert string"
    return in_order(both, "symbol", "ts", late, _watch, "stop double, atr double, prev_close double", out, first=("is_signal",))


def stream_bars(ticks: DataFrame, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time bars of (symbol, ts, price, volume); ties of time by the larger price."""
    x = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    at = F.struct("ts", "price")
    out = x.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_temporal_lock(events: DataFrame, snapshot, nav, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) rows by the cutoffs of their class; both are stateless filters, one sink each."""
    ok = (F.col("asset_type").isin(*INTRADAY) & (F.col(ts) <= snapshot)) | (F.col("asset_type").isin(*NAV) & (F.col(ts) <= nav))
    return events.where(ok), events.where(~ok)


def _decide(key: tuple, state: tuple | None, row: Row) -> tuple[tuple, list[tuple]]:
    code, before, held, prev = state or (0, row.p_success, -1, None)
    held, p = held + 1, row.p_success
    drop = bool(prev) and row.close / prev - 1 <= -max(1.8 * row.atr / prev, 0.04)
    if drop or p < 0.40 or (p < 0.45 and held >= 20):
        code = -1
    elif p >= 0.52:
        code = 1
    return (code, p, held, row.close), [(key[0], row.date, code, before, held)]


def stream_eod_state(rows: DataFrame, late: str = "31 days") -> DataFrame:
    """The state rule of the daily decision with state per symbol (last code, last probability, rows held, last close).

    Rows (symbol, date, close, atr, p_success) may come up to `late` behind the newest date: they wait in the state until the
    watermark has passed and are then decided in the order of their dates.
    """
    symbol = dict(rows.dtypes)["symbol"]
    timed = rows.select("symbol", F.col("date").cast("timestamp").alias("ts"), "date", "close", "atr", "p_success")
    return in_order(timed, "symbol", "ts", late, _decide, "code int, before double, held int, prev double", f"symbol {symbol}, date date, code int, p_prev double, days_held int")


def stream_signal_append(signals: DataFrame, path: str, checkpoint: str, late: str = "1 day"):
    """Writer that keeps one row per (symbol, ts) although the source may repeat it; each batch writes a folder of its own
    number, so a batch that runs again replaces what it had written."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    unique = signals.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])
    return unique.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def stream_imbalance(levels: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Order imbalance over sliding windows of (ticker, ts, side, volume)."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("volume")).otherwise(0.0))
    out = levels.withWatermark("ts", late).groupBy("ticker", F.window("ts", width, slide).alias("w")).agg(side("BID").alias("bid"), side("ASK").alias("ask"))
    total = F.col("bid") + F.col("ask")
    return out.select("ticker", F.col("w.start").alias("ts"), F.when(total > 0, (F.col("bid") - F.col("ask")) / total).otherwise(0.0).alias("obi"))


def stream_metrics(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and mean value per name and window, of (event, ts, value)."""
    out = events.withWatermark("ts", late).groupBy("event", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select("event", F.col("w.start").alias("ts"), "n", "mean_value")
