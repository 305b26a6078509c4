"""Ranks and quantiles of dates that are too wide for one task.

The values of a date are cut into pieces by a monotone rule that depends on the least and the largest value only. Windows run
within pieces; how many rows lie in the pieces before is a small table, one row for each piece of a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _scale(x: Column) -> Column:
    """Monotone, and gentle to long tails; null for values that are not finite."""
    return F.when(F.abs(x) < float("inf"), F.signum(x) * F.log1p(F.abs(x)))


def in_pieces(df: DataFrame, column: str, date: str, pieces: int) -> DataFrame:
    """df with _piece, which does not fall as the column grows; null for nulls, own pieces for infinities and NaN."""
    x = F.col(column).cast("double")
    ends = df.groupBy(date).agg(F.min(_scale(x)).alias("_low"), F.max(_scale(x)).alias("_high"))
    width = F.col("_high") - F.col("_low")
    part = F.when(width > 0, F.least(F.floor((_scale(x) - F.col("_low")) / width * pieces), F.lit(pieces - 1))).otherwise(0)
    piece = F.when(F.abs(x) < float("inf"), part).when(x < 0, -1).when(x.isNotNull(), pieces)
    return df.join(ends.withColumnRenamed(date, "_date"), F.col(date).eqNullSafe(F.col("_date"))).withColumn("_piece", piece).drop("_date", "_low", "_high")


def ranked(df: DataFrame, column: str, date: str = "date", pieces: int = 64) -> DataFrame:
    """df with _rank (least rank), _ties, _place (place in order, ties in any order), _n (rows of the date with a value) and
    _all (its rows); the first three are null where the column is."""
    x = in_pieces(df, column, date, pieces)
    sizes = x.groupBy(date, "_piece").agg(F.count("*").alias("_size"))
    of_date = Window.partitionBy(date)
    there = F.col("_piece").isNotNull()
    before = F.sum(F.when(there, F.col("_size")).otherwise(0)).over(of_date.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col(date).alias("_date"), F.col("_piece").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum(F.when(there, F.col("_size")).otherwise(0)).over(of_date).alias("_n"), F.sum("_size").over(of_date).alias("_all"))
    x = x.join(sizes, F.col(date).eqNullSafe(F.col("_date")) & F.col("_piece").eqNullSafe(F.col("_p"))).drop("_date", "_p")
    w = Window.partitionBy(date, "_piece").orderBy(column)
    own = lambda c: F.when(there, c)
    x = x.withColumns({"_rank": own(F.col("_before") + F.rank().over(w)), "_place": own(F.col("_before") + F.row_number().over(w)), "_ties": own(F.count("*").over(Window.partitionBy(date, "_piece", column)))})
    return x.drop("_piece", "_before")


def quantiles(df: DataFrame, column: str, shares: list[float], date: str = "date", pieces: int = 64) -> DataFrame:
    """(date, q0, q1, ...): quantiles of the values of each date, linear between neighbours; null without a value."""
    x = ranked(df.select(date, column), column, date, pieces)
    at = [(F.col("_n") - 1) * q for q in shares]
    pick = lambda place: F.max(F.when(F.col("_place") == place + 1, F.col(column)))
    found = x.groupBy(date).agg(*[pick(F.floor(h)).alias(f"_l{k}") for k, h in enumerate(at)], *[pick(F.ceil(h)).alias(f"_h{k}") for k, h in enumerate(at)], F.max("_n").alias("_n"))
    part = lambda k: at[k] - F.floor(at[k])
    return found.select(date, *[(F.col(f"_l{k}") + part(k) * (F.col(f"_h{k}") - F.col(f"_l{k}"))).alias(f"q{k}") for k in range(len(shares))])
