"""Shaping of panels on their way in and out (S5 to S15). Tables are long: one row per (symbol, date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import tiles
from tidepanel.functions.windows import cascade, running, series

ASSET_TYPES = ("EQUITY", "ETF", "TEFAS_FREE", "TEFAS_LIQUID")
INTRADAY, NAV = ("EQUITY", "ETF"), ("TEFAS_FREE", "TEFAS_LIQUID")


def watchlist_add(watchlist: DataFrame, new: DataFrame) -> DataFrame:
    """Tickers upper-cased; those already watched stay as they are."""
    fresh = new.select(F.upper("ticker").alias("ticker")).distinct()
    return watchlist.select("ticker").unionByName(fresh.join(watchlist, "ticker", "left_anti"))


def watchlist_remove(watchlist: DataFrame, gone: DataFrame) -> DataFrame:
    return watchlist.join(gone.select(F.upper("ticker").alias("ticker")), "ticker", "left_anti")


def wide_to_long(df: DataFrame, key: str, value: str = "close") -> DataFrame:
    """Columns named after symbols become rows; missing cells are dropped."""
    return df.unpivot([key], [c for c in df.columns if c != key], "symbol", value).where(F.col(value).isNotNull())


def long_to_wide(df: DataFrame, key: str, column: str, value: str, columns: list) -> DataFrame:
    """Export shape with an explicit list of columns, so that no extra pass looks for them."""
    return df.groupBy(key).pivot(column, columns).agg(F.max(value))


def long_to_tiles(df: DataFrame, key: str, column: str, value: str, width: int = tiles.TILE) -> tuple[DataFrame, DataFrame]:
    """(rows (key, tile, c0, c1, ...), names (column, tile, pos)): the wide shape for any number of columns.

    A row holds `width` columns of one key; tile and pos say which, by the dictionary `names`. Of repeated cells the largest
    value is taken, as in long_to_wide; rows with a null in `column` are left out. No list of columns reaches the driver.
    """
    x = df.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), F.col(column).alias("symbol"), F.col(value).alias("v"))
    names = tiles.numbered(x, width).drop("n_tiles")
    cells = [F.max(F.when(F.col("pos") == c, F.col("v"))).alias(f"c{c}") for c in range(width)]
    rows = x.join(names, "symbol").groupBy(F.col("k").alias(key), "tile").agg(*cells)
    return rows, names.withColumnRenamed("symbol", column)


def tiles_to_long(rows: DataFrame, names: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """(key, column, value) of what long_to_tiles made; missing cells are dropped."""
    cells = [c for c in rows.columns if c not in (key, "tile")]
    x = rows.unpivot([key, "tile"], cells, "_cell", value).where(F.col(value).isNotNull())
    x = x.withColumn("pos", F.substring("_cell", 2, 9).cast("int"))
    return x.join(names, ["tile", "pos"]).select(key, column, value)


def align_panels(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer alignment of two panels on their keys."""
    return a.join(b, keys, "full")


def fill_calendar(df: DataFrame, values: list[str], key: str = "symbol", date: str = "date", backward: bool = False) -> DataFrame:
    """Every date of the table for every key, gaps filled with the last value before (and, if backward, else the next).

    The calendar is the distinct dates, sent to the distinct keys; only those two small tables meet.
    """
    grid = df.select(key).distinct().join(df.select(date).distinct())
    full = grid.join(df.select(key, date, *values), [key, date], "left")
    ahead = series(key, date).rowsBetween(0, Window.unboundedFollowing)
    filled = lambda c: F.last(c, ignorenulls=True).over(running(key, date))
    return full.select(key, date, *[(F.coalesce(filled(c), F.first(c, ignorenulls=True).over(ahead)) if backward else filled(c)).alias(c) for c in values])


def dedupe_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in a full order, so that the choice does not depend on partitions."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def validate_points(df: DataFrame) -> DataFrame:
    """Rows with a `reason`, null where valid: missing fields, price, volume, auction volume, settlement days, class."""
    bad = lambda c: F.coalesce(c, F.lit(False))
    reason = cascade(
        (F.col("symbol").isNull() | F.col("asset_type").isNull() | F.col("date").isNull() | F.col("close").isNull(), "missing field"),
        (bad(F.col("close") <= 0), "price"),
        (bad(F.col("volume") < 0), "volume"),
        (bad(F.col("auction_volume") < 0), "auction volume"),
        (bad(F.col("settlement_days") < 0), "settlement days"),
        (~F.col("asset_type").isin(*ASSET_TYPES), "asset type"),
    )
    return df.withColumn("reason", reason)


def default_settlement(asset_type: Column) -> Column:
    return cascade((asset_type == "EQUITY", 2), (asset_type == "TEFAS_LIQUID", 0), otherwise=1)


def apply_defaults(df: DataFrame) -> DataFrame:
    """Types of the canonical bars and their defaults."""
    return df.withColumns(
        {
            "close": F.col("close").cast("double"),
            "volume": F.coalesce(F.col("volume").cast("double"), F.lit(0.0)),
            "auction_volume": F.coalesce(F.col("auction_volume").cast("double"), F.lit(0.0)),
            "settlement_days": F.coalesce(F.col("settlement_days").cast("int"), default_settlement(F.col("asset_type"))),
        }
    )


def resample_month_end(df: DataFrame) -> DataFrame:
    """Last close per symbol and month, then carried forward over the months of the table."""
    ends = df.groupBy("symbol", F.last_day("date").alias("date")).agg(F.max_by("close", "date").alias("close"))
    return fill_calendar(ends, ["close"])


def first_row_per_month(df: DataFrame) -> DataFrame:
    first = df.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.min_by(F.struct("date", "close"), "date").alias("x"))
    return first.select("symbol", "month", "x.date", "x.close")


def emit_json(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """One JSON text per row, doubles rounded."""
    return df.select(F.to_json(F.struct(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])).alias("json"))


def dataset_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count("symbol").alias("n_symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_rows"))
