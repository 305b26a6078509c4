"""Cross-sectional normalisation and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import wide
from tidepanel.functions.windows import clip, cross_section, finite
from tidepanel.operators.ingest import NAV


def pct_rank_min(df: DataFrame, columns: list[str], date: str = "date", pieces: int = 1) -> DataFrame:
    """(least rank - 1) / (rows of the date - 1) per column as <column>_ranked; nulls stay null but count as rows.

    pieces: tasks that may share one date (functions/wide.py).
    """
    if pieces > 1:
        for c in columns:
            x = wide.ranked(df, c, date, pieces)
            df = x.withColumn(f"{c}_ranked", (F.col("_rank") - 1) / F.greatest(F.col("_all") - 1, F.lit(1))).drop("_rank", "_place", "_ties", "_n", "_all")
        return df
    n = F.count("*").over(Window.partitionBy(date))
    rank = lambda c: F.rank().over(Window.partitionBy(date).orderBy(F.col(c).asc_nulls_last()))
    return df.withColumns({f"{c}_ranked": F.when(F.col(c).isNotNull(), (rank(c) - 1) / F.greatest(n - 1, F.lit(1))) for c in columns})


def pct_rank_avg(df: DataFrame, column: str, date: str = "date", pieces: int = 1) -> DataFrame:
    """Mean rank of ties, (r - 1) / (n - 1) to 4 decimals, 0.5 for a single row; the column has no nulls.

    pieces: tasks that may share one date (functions/wide.py).
    """
    if pieces > 1:
        x = wide.ranked(df, column, date, pieces)
        rank = (F.col("_rank") + (F.col("_ties") - 1) / 2.0 - 1) / F.greatest(F.col("_all") - 1, F.lit(1))
        return x.withColumn("pct_rank", F.when(F.col("_all") <= 1, 0.5).otherwise(F.round(rank, 4))).drop("_rank", "_place", "_ties", "_n", "_all")
    n = F.count("*").over(Window.partitionBy(date))
    r = F.rank().over(Window.partitionBy(date).orderBy(column)) + (F.count("*").over(Window.partitionBy(date, column)) - 1) / 2.0
    return df.withColumn("pct_rank", F.when(n <= 1, 0.5).otherwise(F.round((r - 1) / (n - 1), 4)))


def class_zscores(df: DataFrame, columns: list[str], targets: list[str], date: str = "date") -> DataFrame:
    """class_zscore of columns and of targets in one pass; mean and deviation of each are asked for once."""
    w = cross_section(date, "asset_type")
    both = [*columns, *targets]
    x = df.withColumns({"_n": F.count("*").over(w), **{f"_m_{c}": F.avg(c).over(w) for c in both}, **{f"_s_{c}": F.stddev_pop(c).over(w) for c in both}})
    x = x.withColumns({f"_z_{c}": F.when(F.col(f"_s_{c}") > 1e-7, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in both})

    def z(c: str) -> Column:
        flat = (F.col(c) - F.col(f"_m_{c}")) if c in targets else F.lit(0.0)
        return F.when(F.col("_n") <= 1, F.col(c)).when(F.col(f"_s_{c}") <= 1e-7, flat).otherwise(clip(F.col(f"_z_{c}"), -3, 3))

    return x.withColumns({c: z(c) for c in both}).select(*df.columns)


def class_zscore(df: DataFrame, columns: list[str], date: str = "date", is_target: bool = False) -> DataFrame:
    """z per date and class (ddof 0), clipped to +-3; single members unchanged; a flat class gives 0, for a target the
    difference from its mean."""
    return class_zscores(df, *([[], columns] if is_target else [columns, []]), date)


def date_zscore(df: DataFrame, column: str, date: str = "date") -> DataFrame:
    w = cross_section(date)
    return df.withColumn("zscore", clip((F.col(column) - F.avg(column).over(w)) / (F.stddev_samp(column).over(w) + 1e-6), -3, 3))


def finite_or_median(df: DataFrame, column: str, date: str = "date", pieces: int = 1) -> DataFrame:
    x = df.withColumn(column, finite(F.col(column)))
    if pieces > 1:
        m = wide.quantiles(x, column, [0.5], date, pieces).withColumnRenamed("q0", "_med")
    else:
        m = x.groupBy(date).agg(F.percentile(column, 0.5).alias("_med"))
    return x.join(m, date).withColumn(column, F.coalesce(column, "_med", F.lit(0.0))).drop("_med")


def alpha_normalise(df: DataFrame, column: str = "score", scale: float = 0.02, nav_scale: float = 0.8, date: str = "date") -> DataFrame:
    """Signals with gaps at the date's median, z-scored (ddof 0), scaled, damped for NAV classes; q is the negative."""
    w = cross_section(date)
    x = finite_or_median(df, column, date)
    s = F.stddev_pop(column).over(w)
    z = F.when(s < 1e-6, 0.0).otherwise((F.col(column) - F.avg(column).over(w)) / s)
    x = x.withColumn("alpha", z * scale * F.when(F.col("asset_type").isin(*NAV), nav_scale).otherwise(1.0))
    return x.withColumn("q", -F.col("alpha"))


def winsorize(df: DataFrame, column: str, low: float = 0.025, high: float = 0.975, date: str = "date", pieces: int = 1) -> DataFrame:
    """Values clipped at interpolated quantiles of their date, and how many were clipped on each side.

    pieces: tasks that may share the quantiles of one date (functions/wide.py); counts are sums that combine before they meet.
    """
    x = finite_or_median(df, column, date, pieces)
    if pieces > 1:
        q = wide.quantiles(x, column, [low, high], date, pieces)
        x = x.join(q.select(date, F.col("q0").alias("lower"), F.col("q1").alias("upper")), date)
        side = lambda c: F.sum(F.when(c, 1).otherwise(0))
        n = x.groupBy(date).agg(side(F.col(column) < F.col("lower")).alias("n_low"), side(F.col(column) > F.col("upper")).alias("n_high"))
        return x.join(n, date).withColumn("winsorized", F.greatest(F.least(F.col(column), F.col("upper")), F.col("lower")))
    q = x.groupBy(date).agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("_q"))
    x = x.join(q, date).withColumns({"lower": F.col("_q")[0], "upper": F.col("_q")[1]})
    w = cross_section(date)
    side = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(w)
    out = x.withColumns({"n_low": side(F.col(column) < F.col("lower")), "n_high": side(F.col(column) > F.col("upper"))})
    return out.withColumn("winsorized", F.greatest(F.least(F.col(column), F.col("upper")), F.col("lower"))).drop("_q")


def delist_decouple(df: DataFrame, column: str = "ret", crash: float = -0.90, target: float = -2.0, low: float = 0.025, high: float = 0.975, date: str = "date", flag: str | None = None) -> DataFrame:
    """Delisted rows get a fixed target and stay out of the quantiles by which the others are clipped.

    A boolean column flag, if named, says which rows are delisted (null: not); else those are that fell to crash or below. The
    spread of the others is 0 on a date on which all are delisted.
    """
    gone = F.col(flag) if flag else F.col(column) <= crash
    x = df.withColumn("is_delisted", F.coalesce(gone, F.lit(False)))
    healthy = F.when(~F.col("is_delisted"), F.col(column))
    q = x.groupBy(date).agg(F.percentile(healthy, F.array(F.lit(low), F.lit(high))).alias("_q"))
    x = x.join(q, date)
    t = F.when(F.col("is_delisted"), target).otherwise(F.greatest(F.least(F.col(column), F.col("_q")[1]), F.col("_q")[0]))
    return x.withColumns({"target": t, "spread": F.coalesce(F.col("_q")[1] - F.col("_q")[0], F.lit(0.0))}).drop("_q")


def sector_median(df: DataFrame, metric: str, sector: str = "sector", date: str = "as_of") -> DataFrame:
    m = df.groupBy(date, sector).agg(F.percentile(metric, 0.5).alias(f"sector_{metric}"))
    return df.join(m, [date, sector])


def history_zscore(df: DataFrame, metric: str, key: str = "ticker", date: str = "as_of", years: int = 5) -> DataFrame:
    """z against the mean and deviation of the last five years, the row included; 0 where they do not vary."""
    w = Window.partitionBy(key).orderBy(F.datediff(date, F.lit("1970-01-01"))).rangeBetween(-365 * years, 0)
    s = F.stddev_samp(metric).over(w)
    return df.withColumn(f"{metric}_z", F.when(s > 1e-9, (F.col(metric) - F.avg(metric).over(w)) / s).otherwise(0.0))
