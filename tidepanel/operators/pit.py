"""Point-in-time filters and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.windows import as_of, cascade, dates_indexed, series
from tidepanel.operators.ingest import INTRADAY, NAV


def _locked(ts: str, snapshot: Column, nav: Column) -> Column:
    """Intraday classes are visible up to the snapshot, NAV classes up to the NAV cutoff, both inclusive."""
    return (F.col("asset_type").isin(*INTRADAY) & (F.col(ts) <= snapshot)) | (F.col("asset_type").isin(*NAV) & (F.col(ts) <= nav))


def temporal_lock(df: DataFrame, snapshot: Column, nav: Column, ts: str = "date") -> DataFrame:
    return df.where(_locked(ts, snapshot, nav))


def lock_violations(df: DataFrame, snapshot: Column, nav: Column, ts: str = "date") -> DataFrame:
    """Rows past their cutoff, with the cutoff and the reason."""
    intraday = F.col("asset_type").isin(*INTRADAY)
    out = df.where(~_locked(ts, snapshot, nav))
    return out.select("symbol", "asset_type", ts, F.when(intraday, snapshot).otherwise(nav).alias("cutoff"), F.when(intraday, F.lit("after snapshot")).otherwise(F.lit("after nav cutoff")).alias("reason"))


def lock_audit(df: DataFrame, snapshot: Column, nav: Column, ts: str = "date") -> DataFrame:
    ok, intraday = _locked(ts, snapshot, nav), F.col("asset_type").isin(*INTRADAY)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = df.agg(F.count("*").alias("checked"), n(~ok).alias("filtered"), n(~ok & intraday).alias("intraday_violations"), n(~ok & ~intraday).alias("nav_violations"))
    return out.withColumn("has_violations", F.col("filtered") > 0)


def assert_snapshot(df: DataFrame, snapshot: Column, nav: Column, ts: str = "date") -> DataFrame:
    """df itself; raises ValueError if a row is past its cutoff (stops at the first found)."""
    bad = df.where(~_locked(ts, snapshot, nav)).limit(1).collect()
    if bad:
        raise ValueError(f"row past its cutoff: {bad[0]}")
    return df


def multi_snapshot(df: DataFrame, snapshots: DataFrame, lookback_days: int, ts: str = "date") -> DataFrame:
    """The lock for many snapshots (snapshot_id, snapshot_time, nav_cutoff) at once, each with its last days only.

    Rows and snapshots meet on the months that a snapshot's look-back touches, not as all pairs.
    """
    months = F.sequence(F.trunc(F.date_sub(F.col("snapshot_time"), lookback_days), "month"), F.trunc("snapshot_time", "month"), F.expr("INTERVAL 1 MONTH"))
    s = snapshots.withColumn("_m", F.explode(months))
    met = df.withColumn("_m", F.trunc(ts, "month")).join(s, "_m").drop("_m")
    return met.where(_locked(ts, F.col("snapshot_time"), F.col("nav_cutoff")) & (F.col(ts) > F.date_sub("snapshot_time", lookback_days)))


def knowledge_lag(df: DataFrame, days: int = 2, ts: str = "date") -> DataFrame:
    return df.withColumn("knowledge_ts", F.date_add(ts, days))


def visible_as_of(facts: DataFrame, probes: DataFrame, values: list[str], key: str = "symbol", knowledge: str = "knowledge_ts", probe: str = "probe_ts") -> DataFrame:
    """Each probe with the latest fact known by then, null if none."""
    return as_of(facts, probes, key, knowledge, probe, values)


def post_listing_filter(df: DataFrame, n: int = 60) -> DataFrame:
    """Without the first n rows of each symbol."""
    return df.withColumn("_n", F.row_number().over(series())).where(F.col("_n") > n).drop("_n")


def exclude_delisted(df: DataFrame, column: str = "symbol", prefix: str = "DELIST") -> DataFrame:
    return df.where(~F.col(column).cast("string").startswith(prefix))


def coverage_guard(df: DataFrame, universe: DataFrame, least: float = 0.95, snapshot: str = "date") -> DataFrame:
    """Per snapshot: members present, expected, share, pass flag and the missing ones."""
    present = df.select(snapshot, "symbol").distinct().join(universe.select("symbol").distinct(), "symbol", "left_semi")
    # absent members are the universe without the collected present ones: nothing is paired per snapshot and member
    members = universe.agg(F.array_sort(F.collect_set("symbol")).alias("_all"))
    got = present.groupBy(snapshot).agg(F.count("*").alias("matched"), F.collect_set("symbol").alias("_own"))
    out = got.join(members).withColumn("expected", F.size("_all").cast("long")).withColumn("coverage", F.col("matched") / F.col("expected"))
    return out.select(snapshot, "matched", "expected", "coverage", (F.col("coverage") >= least).alias("passed"), F.array_except("_all", "_own").alias("missing"))


def purged_split(df: DataFrame, val: int = 252, test: int = 252, embargo: int = 21, date: str = "date") -> DataFrame:
    """Rows tagged train, embargo, val or test by the index of their date; embargoes lie before val and before test."""
    idx = dates_indexed(df, date)
    n = idx.agg(F.count("*").alias("n"))
    back = F.col("n") - F.col("idx")  # 1 for the last date
    tag = cascade((back <= test, "test"), (back <= test + embargo, "embargo"), (back <= test + embargo + val, "val"), (back <= test + 2 * embargo + val, "embargo"), otherwise="train")
    return df.join(idx.join(n).select(date, tag.alias("split")), date)


def walk_forward_schedule(df: DataFrame, warmup: int = 504, embargo: int = 21, step: int = 21, date: str = "date") -> DataFrame:
    """(train_end, predict_date, realize_date): training ends embargo dates before each predicted date."""
    idx = dates_indexed(df, date)
    w = Window.orderBy("idx")
    n = idx.agg(F.least(F.lit(warmup), F.floor(F.count("*") * 0.3)).cast("int").alias("_warm"))
    out = idx.select("idx", F.lag(date, embargo).over(w).alias("train_end"), F.col(date).alias("predict_date"), F.lead(date, embargo).over(w).alias("realize_date"))
    return out.join(n).where((F.col("idx") >= F.col("_warm") + embargo) & ((F.col("idx") - F.col("_warm") - embargo) % step == 0) & F.col("realize_date").isNotNull()).drop("idx", "_warm")


def snapshot_inventory(df: DataFrame, snapshot: str) -> DataFrame:
    """Symbols and rows per snapshot and class, with totals per snapshot and overall (null class, null snapshot)."""
    return df.rollup(snapshot, "asset_type").agg(F.count_distinct("symbol").alias("n_symbols"), F.count("*").alias("n_rows"))


def time_of_week_filter(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Friday 18:10 up to before Saturday 06:00."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return df.where(((F.dayofweek(ts) == 6) & (minute >= 18 * 60 + 10)) | ((F.dayofweek(ts) == 7) & (minute < 6 * 60)))
